import pytest
from pyspark.sql import functions as F

from quillmesh.functions import ids, text, truth
from quillmesh.operators import assessment as Q
from quillmesh.operators import entities as E
from quillmesh.operators import taxonomy as T
from quillmesh.plans import records
from quillmesh.sources import readers, writers


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "wanted"), [("6.0", "6"), ("nan", ""), ("", ""), ("12", "12"), (None, ""), (" AL ", "AL")])
def test_district(spark, raw, wanted):
    assert one(spark, raw, text.clean_district) == wanted


def test_slugs(spark):
    assert one(spark, "AI: Policy", ids.safe_id) == "ai__policy"
    assert one(spark, "", ids.safe_id) == "unknown"
    assert one(spark, "U.S.C.", ids.dropping_slug) == "usc"
    assert one(spark, "U.S.C.", ids.collapsed_slug) == "u_s_c"
    assert one(spark, None, ids.layer_slug) == "unknown"


def test_truth(spark):
    row = spark.createDataFrame([("yes",), ("TRUE",), ("True",), (None,)], "v string").select(truth.graph_flag(F.col("v")).alias("g"), truth.exact_flag(F.col("v")).alias("e"), truth.sync_optional(F.col("v")).alias("o")).collect()
    assert [tuple(r) for r in row] == [(True, False, None), (True, False, True), (True, True, True), (False, False, None)]


def test_jaccard_and_ratio(spark):
    j = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(text.jaccard(F.col("a"), F.col("b"))).first()[0]
    assert (j(["a"], ["a"]), j(["a"], ["b"]), j([], [])) == (1, 0, 0)
    assert j(["a", "b"], ["b", "c"]) == pytest.approx(1 / 3)
    r = spark.createDataFrame([("", ""), ("a", ""), ("abc", "abd")], "a string, b string").select(text.edit_ratio(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [1.0, 0.0, pytest.approx(2 / 3)]


def test_sections(spark):
    body = "SEC. 1. One\n" + "x" * 50 + "\nSEC. 2. Two\n" + "y" * 50
    df = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "short"), (5, "z" * 10_000)], "id int, text string")
    got = {}
    for r in E.sections(df, "id", "text", 80).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.text)
    assert [t[:6] for t in got[1]] == ["SEC. 1", "SEC. 2"] and not any(t != t.strip() for t in got[1])
    assert got[4] == ["short"] and 2 not in got and 3 not in got
    assert "".join(got[5]) == "z" * 10_000 and max(map(len, got[5])) == 80


def test_fuzzy_evaluation_takes_the_first_alike(spark):
    schema = "doc string, kind string, name string, pos int"
    gold = spark.createDataFrame([("1", "organizations", "abcdefghix", 0), ("1", "organizations", "abcdefghij", 1)], schema)
    predicted = spark.createDataFrame([("1", "organizations", "Abcdefghij", 0), ("1", "organizations", "zzz", 1)], schema)
    assert tuple(Q.matched(predicted, gold).first())[1:] == ("organizations", 1, 1, 1, 1)


def test_texts_within_the_limit_stay_whole(spark):
    short = "SEC. 1. One text of some length.\n SEC. 2. Another text of length. "
    packed = "SEC. 1. Long.\n" + "".join(f"  ({c}) part {c} " + "w" * 30 + "\n" for c in "abcd")
    giant = "intro\n(a) " + "x" * 200 + "\n(b) y"
    df = spark.createDataFrame([(1, short), (2, packed), (3, giant)], "id int, text string")
    got: dict[int, list[str]] = {}
    for r in E.sections(df, "id", "text", 120).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got[1] == [short]
    assert [t.splitlines()[0] for t in got[2]] == ["SEC. 1. Long.", "(c) part c " + "w" * 30] and all(len(t) <= 120 for t in got[2])
    # a sub-section beyond the limit is not cut
    assert got[3] == ["intro", "(a) " + "x" * 200, "(b) y"]


def test_confidence(spark):
    registry = spark.createDataFrame([(1, "o1", "organizations", "Agency", "", None, 0.9), (2, "o2", "organizations", "Harbor Safety Board", "HSB", None, 0.9), (3, "r1", "roles", "Chief of Harbors", "", None, 0.9)], "ord bigint, entity_id string, entity_type string, canonical_name string, acronym string, aliases array<string>, confidence double")
    e = lambda n: (n, None, None, 0, 1)
    org = "array<struct<name:string,acronym:string,context:string,char_start:int,char_end:int>>"
    office = "array<struct<name:string,parent_org:string,context:string,char_start:int,char_end:int>>"
    role = "array<struct<title:string,org:string,context:string,char_start:int,char_end:int>>"
    rows = [(1, "1", [e("Agency"), e("HSB"), e("harbor safety board"), e("Nobody At All"), e("Old"), e("the port lead")], None, [])]
    records = spark.createDataFrame(rows, f"record_id bigint, doc_id string, organizations {org}, offices {office}, roles {role}")
    roster = spark.createDataFrame([("organizations", "Harbor Safety Board"), ("roles", "Agency")], "kind string, name string")
    rules = spark.createDataFrame([("The port lead", "r1")], "pattern string, entity_id string")
    got = {r.name: (r.confidence, r.reason) for r in E.scored(records, registry, roster, rules).collect()}
    assert got == {
        "Agency": (0.6, None), "HSB": (0.8, None), "harbor safety board": (1.0, None), "Nobody At All": (0.5, None),
        "Old": (0.3, "short_name, not_in_registry"), "the port lead": (0.2, "type_conflict, not_in_registry"),
    }


def test_spans(spark):
    df = spark.createDataFrame([(1, "The Board met. the board's BOARD; boards")], "id int, text string")
    spans = E.soft_aliases(df, "id", "text", "board")
    assert [r.char_start for r in spans.orderBy("char_start").collect()] == [4, 19, 27]
    tagged = spark.createDataFrame([(1, 0, 9)], "id int, char_start int, char_end int")
    assert [r.char_start for r in E.untagged(spans, tagged, "id").orderBy("char_start").collect()] == [19, 27]
    kept = spark.sql("SELECT array(struct(3 AS start, 8 AS end), struct(1 AS start, 5 AS end), struct(6 AS start, 9 AS end)) AS s").select(E.greedy_spans(F.col("s"))).first()[0]
    assert [(k.start, k.end) for k in kept] == [(1, 5), (6, 9)]


def test_cooccurrence_matrix_has_all_harms_that_occur(spark, tmp_path):
    rows = [(i, str(i), ["Strategies: audit", f"Harms: {i:02}"]) for i in range(20)] + [(30, "30", ["Harms: alone"]), (31, "31", ["strategies: none"])]
    spark.createDataFrame(rows, "ord bigint, doc_id string, taxonomy_tags array<string>").write.parquet(str(tmp_path / "segments_raw.parquet"))
    found = records.cooccurrence_matrix(spark, str(tmp_path)).collect()
    assert [r.asDict() for r in found] == [{"src": "strategies: audit"} | {f"harms: {i:02}": 1 for i in range(20)}]


def test_cosine_blocks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (4, None)], "id bigint, e array<double>")
    got = {(r["query"], r["id"]): r["cosine"] for r in T.cosine_to(v, "id", "e", v.where("id < 3"), block=1).collect()}
    assert got == pytest.approx({(1, 2): 0, (1, 3): 1, (2, 1): 0, (2, 3): 0})


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Name,Text\nx,"two\nlines"\ny,\n', encoding="utf-8")
    rows = readers.csv_text(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["Name"], r["Text"]) for r in rows] == [("x", "two\nlines"), ("y", "")]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in readers.json_lines(spark, str(tmp_path / "b.jsonl"), "id int").collect() if r.id) == [1, 2]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "id int").count() == 0
    n = spark.createDataFrame([("a", None), ("b", "x<y")], "node_id string, label string")
    e = spark.createDataFrame([("a", "b", "R"), ("a", "b", "R"), ("a", "a", "S")], "src_id string, dst_id string, relation string")
    writers.graphml(n, e, str(tmp_path / "g.graphml"))
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.node_id: r.props["label"] for r in nodes.collect()} == {"a": "", "b": "x<y"} and edges.count() == 3


def test_sinks(spark, tmp_path):
    import json

    root = str(tmp_path)
    writers.json_document(spark, f"{root}/a.json", {"b": "é", "a": [1]})
    assert (tmp_path / "a.json").read_text() == '{\n  "b": "\\u00e9",\n  "a": [\n    1\n  ]\n}\n'
    for v in ("x", "y"):
        writers.replace_json_lines(spark.createDataFrame([(v,)], "v string"), f"{root}/lines")
        assert [r.v for r in spark.read.json(f"{root}/lines").collect()] == [v]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("lines")] == ["lines"]
    writers.indexed_csv(spark.createDataFrame([(i, f"n{i}") for i in range(50, 0, -1)], "k int, n string").repartition(5), f"{root}/t", ["k"])
    rows = spark.read.csv(f"{root}/t", header=True, inferSchema=True).collect()
    assert {(r["index"], r.k) for r in rows} == {(i, i + 1) for i in range(50)}
    writers.report_document(spark, f"{root}/r.json", spark.createDataFrame([(1,)], "n int"), {"kinds": spark.createDataFrame([("a", 2)], "k string, n int")})
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1, "kinds": [{"k": "a", "n": 2}]}
    n = spark.createDataFrame([("a", None), ("b", "x<y")], "node_id string, label string")
    e = spark.createDataFrame([("a", "b", "R")], "src_id string, dst_id string, relation string")
    for form in ("gexf", "graphml", "png"):
        writers.graph_file(n, e, root, "g", form)
    assert (tmp_path / "g.gexf").exists() and (tmp_path / "g.graphml").exists() and not (tmp_path / "g.png").exists()
    c = spark.createDataFrame([("c1", "L", ["1", "2"], 1), ("c2", "M", ["2"], 2)], "community_id string, label string, members array<string>, ord int")
    assert {tuple(r) for r in readers.community_map(c).collect()} == {("1", "c1"), ("2", "c2")} and {tuple(r) for r in readers.first_community(c).collect()} == {("1", "c1"), ("2", "c1")}
    assert {r.community_id: r.rules for r in readers.memories(spark, f"{root}/none", c).collect()} == {"c1": {}, "c2": {}}
    d = spark.createDataFrame([("1",), ("2",), ("3",)], "doc_id string")
    h, o = (spark.createDataFrame(x, "doc_id string, text string") for x in ([("1", "h"), ("2", None)], [("1", "l"), ("2", "l")]))
    assert {tuple(r) for r in readers.texts_of(d, h, o).collect()} == {("1", "h"), ("2", "l"), ("3", None)}


def test_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, v string")
    assert {tuple(r) for r in writers.merge_by_key(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
