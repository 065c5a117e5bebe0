"""Memory, resolution, layers, evaluation, similarity of documents: small fixtures with NULL, blank, tied and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import shown
from quillmesh.operators import affinity as D
from quillmesh.operators import assessment as Q
from quillmesh.operators import entities as E
from quillmesh.operators import knowledge as K
from quillmesh.operators import layers as Y

ORG = "array<struct<name:string,acronym:string,context:string,char_start:int,char_end:int>>"
OFFICE = "array<struct<name:string,parent_org:string,context:string,char_start:int,char_end:int>>"
ROLE = "array<struct<title:string,org:string,context:string,char_start:int,char_end:int>>"
SCHEMA = f"record_id bigint, doc_id string, organizations {ORG}, offices {OFFICE}, roles {ROLE}, disambiguation_updates map<string,string>, oddity string, ord int"
REGISTRY = "ord bigint, entity_id string, entity_type string, canonical_name string, acronym string, aliases array<string>, confidence double"


def e(name, other=None):
    return (name, other, "about " + "x" * 300, 0, 4)


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        (1, "1", [e("Grid Agency"), e("GA"), e(""), e(None)], [e("Office of Audits", "Grid Agency")], None, {"the Agency": "Refers to the Grid Agency", "x_in_sec_2": "y"}, "first", 1),
        (2, " 1 ", [e("grid agency"), e("the agency")], [], [e("Chair", None)], {"The agency": "Harbor Board", "the board": "not referenced"}, "", 2),
        (3, "2", [e("the board"), e("Harbor Board")], None, [e("Chair", "Harbor Board")], None, "third", 3),
        (4, None, None, None, None, None, None, 4),
        (5, "9", [e("Committee")], None, None, {"board": "Harbor Board"}, "last", 5),
    ]
    records = spark.createDataFrame(rows, SCHEMA)
    registry = spark.createDataFrame([(1, "org:grid", "organizations", "Grid Agency", "GA", ["Agency of the Grid"], 0.9), (2, "org:harbor", "organizations", "Harbor Board", "", None, 0.9)], REGISTRY)
    communities = spark.createDataFrame([("1", "c1"), ("2", "c1")], "doc string, community string")
    return records, registry, communities, E.registry_terms(registry)


def test_names(spark):
    df = spark.createDataFrame([("The Committee ",), ("abc",), ("Federal agencies",), ("Harbor Board",), ("board",)], "n string")
    got = {r.n: (r.g, r.h, r.b) for r in df.select("n", K.is_generic(F.col("n"), F.lit(None)).alias("g"), K.is_generic(F.col("n"), F.array(F.lit("abc"))).alias("h"), K.is_bare(F.col("n"), F.array(F.lit("harbor board"))).alias("b")).collect()}
    assert got == {"The Committee ": (True, True, True), "abc": (True, False, False), "Federal agencies": (True, True, False), "Harbor Board": (False, False, True), "board": (False, False, True)}


def test_three_tiers(world):
    records, registry, communities, terms = world
    phrases = K.community_phrases(records, communities)
    assert {tuple(r) for r in phrases.collect()} == {("c1", "the agency", "Refers to the Grid Agency"), ("c1", "the board", "not referenced")}
    queue = {(r.record_id, r.name): (r.suggestion, r.source, r.community) for r in K.review_queue(records, communities, phrases, terms, registry).collect()}
    # record 2 explains 'the agency' itself; record 3 has no explanation and the community's names nothing
    assert queue == {
        (2, "the agency"): ("Harbor Board", "doc", "c1"), (3, "the board"): (None, "unresolved", "c1"), (5, "Committee"): (None, "unresolved", ""),
        (2, "Chair"): (None, "unresolved", "c1"), (3, "Chair"): (None, "unresolved", "c1"),
    }
    stats = {(r.source, r.kind): r.n for r in K.queue_stats(K.review_queue(records, communities, phrases, terms, registry)).collect()}
    assert stats[None, None] == 5 and stats["doc", None] == 1 and stats[None, "organizations"] == 3


def test_roster(world):
    records, registry, communities, terms = world
    roster = {(r.community, r.kind, r.name): (r.n_mentions, r.first_seen) for r in K.roster(records, communities, terms, registry).collect()}
    # 'GA' came after its canonical name, so it never entered
    assert roster["c1", "organizations", "Grid Agency"] == (2, "1") and not any(n == "GA" for _, _, n in roster)
    assert roster["c1", "roles", "Chair"] == (2, "1") and roster["", "organizations", "Committee"] == (1, "9")
    known = K.roster(records.where("record_id = 1"), communities, terms, registry)
    novel = {(r.record_id, r.name) for r in K.novel(records, known, communities, terms, registry).collect()}
    assert novel == {(2, "the agency"), (2, "Chair"), (3, "the board"), (3, "Harbor Board"), (3, "Chair"), (5, "Committee")}


def test_rules(spark, world):
    records, registry, communities, terms = world
    log = spark.createDataFrame([(i, "1", {"the shop": "grid agency", "GA": "Grid Agency", "it": "No Body"}) for i in range(7)], "record_id bigint, doc_id string, disambiguation_updates map<string,string>")
    assert [tuple(r) for r in K.graduated(log, communities, terms).collect()] == [("c1", "the shop", "grid agency", "org:grid", 7, 0.95)]
    assert K.graduated(log.limit(4), communities, terms).count() == 0
    rules = [("c", i, f"w{i} a b") for i in range(9)] + [("c", 20, "w8 a b c"), ("c", 21, "w8 a"), (None, 1, "x"), ("d", 1, " "), ("d", 2, None)]
    got = {(r.community, r.rule): r.state for r in K.parsing_rules(spark.createDataFrame(rules, "community string, ord int, rule string")).collect()}
    assert got["c", "w0 a b"] == got["c", "w1 a b"] == "archived" and got["c", "w8 a b c"] == "active" and ("c", "w8 a b") not in got
    assert ("c", "w8 a") in got or ("c", "w8 a b c") in got
    assert got["", "x"] == "active" and not any(c == "d" for c, _ in got)
    assert sum(1 for (c, _), s in got.items() if c == "c" and s == "active") <= 7


@pytest.mark.parametrize(
    ("answer", "verdict"),
    [(None, True), ("Nothing here", False), ("Grid Agency (confidence: 0.9)", True), ("grid agency (confidence: 0.9)\n\nX (confidence: 0.2)", True), ("X (confidence: 0.9)\nGrid Agency (confidence: 0.2)", None)],
)
def test_probe(spark, answer, verdict):
    assert spark.createDataFrame([(answer,)], "a string").select(K.probe_verdict(F.col("a"), F.lit("Grid Agency"))).first()[0] is verdict


@pytest.mark.parametrize(("answer", "wanted"), [('```json\n{"a": "1"}\n```', {"a": "1"}), (' {"a": "1"} ', {"a": "1"}), ("[1]", None), ("broken", None), (None, None), ("", None)])
def test_fenced_json(spark, answer, wanted):
    assert spark.createDataFrame([(answer,)], "a string").select(K.parsed_json(F.col("a"))).first()[0] == wanted


def test_context(spark, world):
    records, registry, communities, terms = world
    roster = K.roster(records, communities, terms, registry)
    made = K.disambiguation_context(K.community_phrases(records, communities), roster, K.last_oddities(records, communities), terms, registry)
    got = {r.community: r.context for r in made.collect()}
    assert 'Disambiguation rules: "the agency" = Refers to the Grid Agency' in got["c1"] and "- Grid Agency (GA) [organization]" in got["c1"] and "- Chair [Roles, 2 mentions]" in got["c1"]
    assert got["c1"].rstrip().endswith("- first\n- third") and len(got["c1"]) <= 6000
    many = spark.createDataFrame([("c", "organizations", f"Name number {i}", i % 50, "1") for i in range(3000)], "community string, kind string, name string, n_mentions bigint, first_seen string")
    none = spark.createDataFrame([], "community string, phrase string, meaning string")
    long = K.disambiguation_context(none, many, spark.createDataFrame([], "community string, k int, oddity string"), terms, registry, 1000).first()
    assert 900 < long.n_chars <= 1000 and "49 mentions" in long.context


def test_entity_layer(world):
    records, registry, communities, terms = world
    relations = records.select("record_id", F.explode("offices").alias("o")).select("record_id", F.lit("offices").alias("source_type"), F.col("o.name").alias("source_name"), F.lit("organizations").alias("target_type"), F.col("o.parent_org").alias("target_name"), F.lit("PART_OF").alias("relation_type"), "o.context")
    nodes, edges = Y.entity_layer(records, E.term_map(registry), relations)
    n = {r.node_id: (r.node_type, r.label) for r in nodes.collect()}
    assert n["org:grid"] == ("Org", "Grid Agency") and n["role:chair"] == ("Role", "Chair") and n["document:1"] == ("Document", "document:1") and n["org:the_agency"][1] == "the agency"
    got = [(r.src_id, r.relation, r.dst_id) for r in edges.collect()]
    assert got.count(("document:1", "MENTIONS_ORG", "org:grid")) == 3 and ("office:office_of_audits", "PART_OF", "org:grid") in got
    assert max(len(r.detail) for r in edges.collect() if r.detail) == 200
    late = relations.withColumn("target_name", F.lit("Harbor Board"))  # met in record 3 only
    assert Y.entity_layer(records, E.term_map(registry), late)[1].where("relation = 'PART_OF'").count() == 0


def test_matched_against_brute_force(spark):
    r = random.Random(5)
    names = [a + b for a in ("harbor board", "harbor bored", "grid agency", "audit office") for b in ("", " x", " of one")]
    side = lambda: [(str(d), "organizations", r.choice(names), i) for d in range(30) for i in range(r.randint(0, 6))]
    p, g = side(), side()
    schema = "doc string, kind string, name string, pos int"

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    wanted = {}
    for d in {x[0] for x in p + g}:
        free, tp, partial, mine = [x[2] for x in g if x[0] == d], 0, 0, [x[2] for x in p if x[0] == d]
        for n in mine:
            hit = next((i for i, m in enumerate(free) if n == m or 1 - distance(n, m) / max(len(n), len(m)) >= 0.85), None)
            if hit is not None:
                partial += free.pop(hit) != n
                tp += 1
        wanted[d] = (tp, partial, len(mine) - tp, len(free))
    got = {x.doc: (x.tp, x.partial, x.fp, x.fn) for x in Q.matched(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema)).collect()}
    assert got == wanted
    empty = spark.createDataFrame([], schema)
    assert Q.matched(empty, empty).count() == 0 and Q.macro_f1(Q.by_kind(Q.matched(empty, empty))).first().macro_f1 == 0.0
    assert Q.type_accuracy(empty, empty).first().accuracy == 0.0


def test_document_communities(spark):
    word = lambda i: f"w{i}"
    rows, tags = [], []
    for g in range(3):
        for i in range(8):
            d = g * 100 + i
            rows.append((len(rows), str(d), f"u{d // 2}" if d < 2 else "", " ".join(word(g * 50 + j) for j in range(20)), None, f"t{g}"))
            tags += [(d, f"strategies: {g}"), (d, f"harms: {g}")]
    rows += [(90, "777", " ", None, None, None), (91, " ", "u", "x", None, None), (92, "0.0", "u0", "late", None, None)]
    docs = spark.createDataFrame(rows, "ord bigint, doc_id string, link string, short_summary string, long_summary string, tags string").withColumn("rep", F.lit(1))
    tag_table = spark.createDataFrame(tags, "doc bigint, tag string")
    found = {r.doc: r for r in D.document_communities(docs, tag_table).collect()}
    assert set(found) == {g * 100 + i for g in range(3) for i in range(8)} | {777}
    for g in range(3):
        assert len({found[g * 100 + i].community for i in range(8)}) == 1
    assert found[1].rep == 0 and found[1].centrality == found[0].centrality and found[777].centrality == 1.0
    assert {r.community for r in found.values()} == {f"community:{i:03}" for i in range(1, 5)} and found[777].community == "community:004"
    people = spark.createDataFrame([(1, "0", "P", "R"), (2, "1", "Q", "D"), (3, "2", "S", "D"), (4, "100", "T", "")], "ord bigint, doc_id string, person_id string, party string")
    members = spark.createDataFrame([(d, r.community) for d, r in found.items()], "doc bigint, community string")
    labels = {r.community: (r.label, r.signature, r.dominant_party) for r in D.community_labels(members, tag_table, people).collect()}
    assert labels[found[0].community] == ("harms: 0 | strategies: 0", ["harms: 0", "strategies: 0"], "D") and labels["community:004"] == ("General", [], "")
    members = D.link_members(docs)
    some = D.combined_similarity(D.profile_tags(tag_table, members), D.profile_words(docs, members), queries=spark.createDataFrame([(2,)], "rep bigint"))
    assert {r.dst for r in some.collect()} == {0, 3, 4, 5, 6, 7}
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0])], "rep bigint, vector array<double>")
    with_vectors = {r.dst: r.similarity for r in D.combined_similarity(D.profile_tags(tag_table, members), D.profile_words(docs, members), vectors, spark.createDataFrame([(2,)], "rep bigint")).collect()}
    plain = {r.dst: r.similarity for r in some.collect()}
    assert with_vectors[3] == pytest.approx(plain[3] + 0.2) and with_vectors[4] == pytest.approx(plain[4] - 0.2) and with_vectors[5] == pytest.approx(plain[5])


def test_scalars(spark):
    df = spark.createDataFrame([("Harbor Board, the / x", "2021-02-30", {"a": "", "b": None, "c": "1"})], "t string, d string, m map<string,string>")
    r = df.select(shown.file_stem(F.col("t")).alias("stem"), shown.blank_date(F.col("d")).alias("d"), F.map_keys(shown.truthy_entries(F.col("m"))).alias("m"), shown.plain_reason(F.lit("short_name, odd")).alias("why"), shown.first_counted(F.lit('{"x": 1, "bills": [1, 2]}'), ["amendments", "bills"]).alias("n"), shown.context_of(F.col("t"), F.lit("zzz"), F.lit("Board")).alias("at")).first()
    assert tuple(r) == ("harbor_board_the__x", None, ["c"], "the name is short, odd", 2, 7)
    assert shown.header_preview(list("abcdefg")) == "a, b, c, d, e, … (7 columns)" and shown.header_preview(["a"]) == "a"


def test_labels_of_communities_of_many_edges(spark, monkeypatch):
    from quillmesh.operators import networks as N

    docs = spark.createDataFrame([(d, str(d), "", f"w{d // 10} common", None, None) for d in range(30)], "ord bigint, doc_id string, link string, short_summary string, long_summary string, tags string")
    tags = spark.createDataFrame([(d, f"strategies: {d // 10}") for d in range(30)], "doc bigint, tag string")
    people = spark.createDataFrame([(d, str(d), "P", "RD"[d // 10 % 2]) for d in range(30)], "ord bigint, doc_id string, person_id string, party string")
    monkeypatch.setattr(N, "MOST_EDGES", 100)  # 135 similar pairs were refused
    members = D.document_communities(docs, tags)
    assert {r.centrality for r in members.collect()} == {0.75}
    labels = D.community_labels(members.select("doc", "community"), tags, people).orderBy("community").collect()
    assert [tuple(r) for r in labels] == [(f"community:{i + 1:03}", 10, f"strategies: {i}", [f"strategies: {i}"], "RD"[i % 2]) for i in range(3)]


def test_shared_documents_of_every_person(spark, tmp_path):
    from quillmesh.plans import memories

    rows = [(1, "1", "P100"), (2, "2", "P100"), (3, "1", "P101"), (4, "3", "P101"), (5, "3", " P101 "), (6, "2", "P101"), (7, "4", "P2"), (8, None, "P101"), (9, "5", " "), (10, "6", " ")]
    df = spark.createDataFrame([(*r, False, False) for r in rows] + [(11, "7", "P101", False, True)], "ord bigint, doc_id string, person_id string, is_original boolean, is_withdrawn boolean")
    df.write.parquet(str(tmp_path / "cosponsor_rows.parquet"))
    found = sorted((r.src_id[9:], r.dst_id[9:], r.person) for r in memories.QUERIES["shares_cosponsor_edges"](spark, str(tmp_path)).collect())
    assert found == [("1", "2", "P100"), ("1", "2", "P101"), ("1", "3", "P101"), ("3", "2", "P101")]
