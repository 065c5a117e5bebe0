"""Normalised tables, profiles and subgraphs: small fixtures with NULL, blank, tied and repeated rows, and empty tables."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import alignments as A
from quillmesh.operators import graph as G
from quillmesh.operators import legislators as L
from quillmesh.operators import normalise as R
from quillmesh.operators import profiles as P
from quillmesh.operators import subgraphs as S

ROWS = "ord bigint, doc_id string, person_id string, full_name string, party string, state string, is_withdrawn boolean"


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "1", "A", "Sen. A", "D", "QA", False), (2, "1", "B", "Rep. B", "R", "QB", False), (3, "2", "A", "Sen. A", "R", "QA", None), (4, "2", "C", "C", None, None, False),
        (5, "2", "B", "Rep. B", "R", "QB", False), (6, None, "A", "", "D", "", False), (7, "3", " ", "", "D", "", False), (8, "1", "A", "Sen. A", "D", "QA", True), (9, "4", "E", "E", "I", "QA", False),
    ]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, "1", "Health", "u"), (2, "2", "Grid", " "), (3, "2.0", "Health", "u"), (4, "x", "Grid", None), (5, "3", " ", "u"), (6, "4", "Grid", None)]
    return spark.createDataFrame(rows, "ord bigint, doc_id string, authority string, link string")


def test_documents(spark):
    raw = spark.createDataFrame([(1, "7", "Health", "TRUE", "x", None), (2, "7.0", "None such", "no", None, " "), (3, "", "Health", "", "", "")], "ord bigint, doc_id string, authority string, annotated string, `Harms: A` string, `Strategies: B` string")
    raw = raw.withColumn("Harms: A", F.when(F.col("ord") == 1, "True").otherwise("no"))
    authority = spark.createDataFrame([(10, "Health"), (11, "Health"), (12, None)], "ord bigint, name string")
    got = [tuple(r) for r in R.documents(raw, authority).select("doc_id", "authority_id", "annotated", "official_name", "taxonomy_tags").orderBy("ord").collect()]
    assert got == [(7, 11, True, "", ["Harms: A"]), (7, None, None, "", [])]
    assert R.plain_columns(raw.columns) == ["ord", "doc_id", "authority", "annotated"] and R.colon_columns(["a: b", "c", "d: e"], {"d: e"}) == ["a: b"]
    assert R.documents(raw.limit(0), authority).count() == 0


def test_segments_and_people(spark, documents):
    seg = spark.createDataFrame([(1, "1", "2", "t", "true"), (2, "1", " ", "t", ""), (3, "99", "1", None, None), (4, None, "1", "t", "x"), (5, "2", "3.0", None, "False")], "ord bigint, doc_id string, position string, text string, non_operative string")
    got = [(r.ord, r.document_id, r.segment_position, r.text, r.non_operative, r.taxonomy_tags) for r in R.segments(seg, documents).orderBy("ord").collect()]
    assert got == [(1, 1, 2, "t", True, []), (5, 2, 3, "", None, [])]
    cos = spark.createDataFrame([(1, "1", "P", "2020-01-02", "TRUE"), (2, "1", "", "", ""), (3, "1", "Q", " ", None), (4, "1", "R", "no date", "x")], "ord bigint, doc_id string, person_id string, sponsorship_date string, is_original string")
    assert [(r.person_id, str(r.sponsorship_date), r.is_original, r.is_withdrawn) for r in R.cosponsors(cos, documents).orderBy("ord").collect()] == [("P", "2020-01-02", True, False), ("Q", "None", False, False), ("R", "None", False, False)]
    skipped = {tuple(r) for r in R.skipped({"segments": (seg, documents), "cosponsors": (cos, documents)}).collect()}
    assert skipped == {("segments", "no position", 1), ("segments", "unknown document", 1), ("segments", "no document id", 1), ("cosponsors", "no person", 1)}
    spon = spark.createDataFrame([(1, "1", "3", '[{"id": "P"}]'), (2, "1", "x", "broken"), (3, "1", None, None)], "ord bigint, doc_id string, n_cosponsors string, people_json string")
    assert [(r.n_cosponsors, r.people) for r in R.sponsors(spon, documents).orderBy("ord").collect()] == [(3, [{"id": "P"}]), (0, None), (0, None)]


def test_profiles(spark, people, documents):
    tags = spark.createDataFrame([(1, "harms: a"), (1, "risk factors: x: y"), (2, "harms: a"), (2, "risk factors: z"), (9, "harms: b")], "doc bigint, tag string")
    p = {(r.person, r.tag): (r.n, r.share) for r in P.person_profile(people, tags).collect()}
    assert p["A", "harms: a"] == (3, 0.5) and p["C", "harms: a"] == (1, 0.5) and not any(k[0] == "E" for k in p)
    assert {r.person for r in P.most_active_profiles(people, P.person_profile(people, tags), 2).collect()} == {"A", "B"}
    champions = [(r.tag, r["rank"], r.person) for r in P.champions(people, tags, "risk factors", 1).orderBy("tag").collect()]
    assert champions == [("risk factors: x: y", 1, "A"), ("risk factors: z", 1, "A")]
    assert {tuple(r) for r in P.totals_with_parent(tags, "risk factors").collect()} == {("x: y", "x", 1), ("z", "risk factors", 1)}
    assert P.tags_per_document(spark.createDataFrame([(1,), (2,), (3,)], "doc bigint"), tags).first().n_without == 1
    counts = spark.createDataFrame([("harms: a", 3), ("harms: b: c", 5)], "tag string, n bigint")
    assert {r.tag for r in P.top_labels(counts, "harms", least=1).collect()} == {"harms: a"} and {r.tag for r in P.top_labels(counts, "harms", least=2, fallback=1).collect()} == {"harms: b: c"}
    groups = spark.createDataFrame([("g", "A"), ("g", "B"), ("g", "nobody"), ("h", "E")], "grp string, person string")
    profile = {r.grp: r for r in P.group_profile(groups, people, documents).collect()}
    assert (profile["g"]["size"], profile["g"].d_pct, profile["g"].senate, profile["g"].n_states, profile["g"].top_1) == (3, 33.3, 1, 2, "Health (3)")
    assert P.group_tags(groups, people, tags, "harms").count() == 0
    nets = {r.area: (r.n_rows, r.n_nodes, r.n_edges) for r in P.area_networks(people, documents, 1, 1).collect()}
    assert nets == {"Health": (2, 2, 1), "Grid": (4, 4, 3)}
    assert P.binary_matrix(tags, "harms", ["a", "b"]).orderBy("doc").collect()[0].asDict() == {"doc": 1, "a": 1, "b": 0}
    assert P.person_profile(people.limit(0), tags).count() == 0


def test_subgraphs(spark, people):
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 1), ("c", "d", 1), ("x", "y", 9), ("a", "a", 1)], "src string, dst string, weight bigint")
    nodes, inside = S.ego(edges, "a", 2)
    assert {tuple(r) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2)} and {(r.src, r.dst) for r in inside.collect()} == {("a", "b"), ("b", "c"), ("a", "a")}
    assert [tuple(r) for r in S.ego(edges, "lone", 1)[0].collect()] == [("lone", 0)]
    assert [r.node for r in S.largest_component(edges).orderBy("node").collect()] == ["a", "b", "c", "d"]
    who = spark.createDataFrame([("a", "D"), ("b", "R"), ("c", ""), ("d", "R"), ("z", "D")], "node string, party string")
    _, crossing = S.cross_party_graph(who, edges)
    assert [(r.src, r.dst) for r in crossing.collect()] == [("a", "b")]
    assert {r.node: (r.cross_degree, r.total_degree) for r in S.bridges(who, edges.where("src <> dst")).collect()} == {"a": (5, 5), "b": (5, 6)}
    assert {r.node: r.degree for r in S.with_isolated(who, edges.where("src <> dst")).collect()} == {"a": 1, "b": 2, "c": 2, "d": 1, "z": 0}
    assert {(r.src, r.dst) for r in S.by_attribute(who, edges, "party", "R")[1].collect()} == set()
    assert {(r.src, r.dst) for r in S.strongest_edges(edges, 0.0, 3).collect()} == {("x", "y"), ("a", "b"), ("a", "a")}
    assert S.strongest_edges(edges.limit(0)).count() == 0
    b = {(r.doc, r.person): (r.party, r.n) for r in S.bipartite(people).collect()}
    assert b[1, "A"] == ("D", 2) and b[2, "C"] == (None, 1)


def test_walks_against_a_queue(spark):
    """Paths and ranks of a walk in both directions, with parallel edges, loops and a cycle."""
    import random
    from collections import deque

    r = random.Random(8)
    links = sorted({(f"n{r.randint(0, 25)}", r.choice(["HAS_TAG", "HAS_TOPIC"]), f"n{r.randint(0, 25)}") for _ in range(45)})
    r.shuffle(links)
    edges = spark.createDataFrame([(a, k, b, (0, i, 0)) for i, (a, k, b) in enumerate(links)], "src_id string, relation string, dst_id string, edge_order struct<stage:int,ord:bigint,sub:int>")
    nodes = spark.createDataFrame([(f"n{i}", "N", f"label {i}") for i in range(26)], "node_id string, node_type string, label string")
    seed = links[0][0]
    out: dict[str, list] = {}
    back: dict[str, list] = {}
    for a, k, b in links:
        out.setdefault(a, []).append((k, b))
        back.setdefault(b, []).append((k, a))
    path, queue = {seed: []}, deque([seed])
    while queue:
        v = queue.popleft()
        for k, u in [*out.get(v, []), *back.get(v, [])]:
            if u not in path and len(path[v]) < 3:
                path[u] = [*path[v], (v, k, u)]
                queue.append(u)
    got = {x.node_id: [tuple(s) for s in x.path] for x in G.neighborhood(nodes, edges, seed, max_hops=3, limit=100, direction="both").collect()}
    assert got == {k: v for k, v in path.items() if k != seed}


def test_hot_keys(spark):
    """One person on a third of all rows, one link on a third of all documents, one long context."""
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("P"), F.col("id") % 50)).alias("person_id"), F.lit("Rep. X").alias("full_name"), F.lit("D").alias("party"), F.lit("QA").alias("state"), F.lit(False).alias("is_withdrawn"))
    docs = spark.range(n).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("doc_id"), F.lit("Area").alias("authority"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("link"), F.concat(F.lit("t"), F.col("id") % 7).alias("tags"))
    assert {r.person: r.n_bills for r in A.sponsor_summary(rows, docs).collect()}["HOT"] == n // 3
    assert [tuple(r) for r in A.link_groups(docs).collect()] == [("hot", 0, n // 3, 7)]
    lines = spark.range(20_000).select(F.lit("g").alias("g"), F.concat(F.lit("line "), "id").alias("line"), F.col("id").alias("o"))
    wanted, total = 0, 0
    for i in range(20_000):
        total += len(f"line {i}") + 1
        if total > 6000:
            break
        wanted += 1
    assert A.budgeted_context(lines, "g", "line", "o").first().n_lines == wanted
    assert L.shares_counts(rows).where("person = 'HOT'").first().n_pairs == (n // 3) * (n // 3 - 1) // 2
