import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quillmesh.operators import graph as G
from quillmesh.operators import layers as Y
from quillmesh.operators import legislators as L
from quillmesh.operators import networks as N
from quillmesh.operators import streamed_louvain as S
from quillmesh.operators.components import connected_components


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("document:1", "Document", "D"), ("segment:1_1", "Segment", "S"), ("topic:t", "Topic", "T"), ("tag:g", "Tag", "G"), ("authority:a", "Authority", "A"), ("collection:c", "Collection", "C")]
    edges = [("document:1", "HAS_SEGMENT", "segment:1_1"), ("document:1", "UNDER_AUTHORITY", "authority:a"), ("document:1", "IN_COLLECTION", "collection:c"), ("segment:1_1", "HAS_TOPIC", "topic:t"), ("segment:1_1", "HAS_TAG", "tag:g")]
    rows = [(*e, (3, i, 0)) for i, e in enumerate(edges)]
    return spark.createDataFrame(nodes, "node_id string, node_type string, label string"), spark.createDataFrame(rows, "src_id string, relation string, dst_id string, edge_order struct<stage:int,ord:bigint,sub:int>")


def walk(small, **options):
    return [(r.node_type, r.rank_score) for r in G.neighborhood(*small, **({"seed": "document:1"} | options)).collect()]


def test_one_hop(small):
    assert walk(small, max_hops=1) == [("Segment", 0.75), ("Collection", 0.65), ("Authority", 0.55)]


def test_two_hops_and_paths(small):
    assert walk(small)[3:] == [("Tag", 0.525), ("Topic", 0.525)]
    path = next(r.path for r in G.neighborhood(*small, seed="document:1").collect() if r.node_id == "topic:t")
    assert [(p["from"], p["relation"], p["to"]) for p in path] == [("document:1", "HAS_SEGMENT", "segment:1_1"), ("segment:1_1", "HAS_TOPIC", "topic:t")]


def test_filters_and_directions(small):
    assert [t for t, _ in walk(small, relations={"HAS_SEGMENT", "HAS_TOPIC"})] == ["Segment", "Topic"]
    assert [t for t, _ in walk(small, node_types={"Topic"})] == ["Topic"]
    assert [t for t, _ in walk(small, limit=2)] == ["Segment", "Collection"]
    assert [t for t, _ in walk(small, max_hops=1, ranked=False)] == ["Authority", "Collection", "Segment"]
    assert [t for t, _ in walk(small, seed="authority:a", direction="in", max_hops=1)] == ["Document"]
    assert {t for t, _ in walk(small, seed="authority:a", direction="both")} >= {"Document", "Segment"}
    with pytest.raises(ValueError, match="seed node not found"):
        walk(small, seed="document:none")


def test_graph_counts(spark):
    docs = spark.createDataFrame([(1, "1", "D", "A", "x; y", "t1; t2"), (2, "", "E", None, None, None)], "ord bigint, doc_id string, official_name string, authority string, collections string, tags string")
    segs = spark.createDataFrame([(1, "1", "1", "g1; g2", ["Strategies: Evaluation", None, ""])], "ord bigint, doc_id string, position string, tags string, taxonomy_tags array<string>")
    auths = spark.createDataFrame([(1, "A")], "ord bigint, name string")
    cols = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "ord bigint, name string")
    rows = G.graph_rows(docs, segs, auths, cols)
    nodes = {r.node_id for r in G.graph_nodes(rows).collect()}
    assert nodes == {"authority:a", "collection:x", "collection:y", "segment:1_1", "document:1", "tag:t1", "tag:t2", "tag:g1", "tag:g2", "topic:strategies__evaluation"}
    assert G.graph_edges(rows).count() == 9


def test_layers_keep_edges(spark):
    n = lambda *r: spark.createDataFrame(r, "node_id string, node_type string, label string, layer int, detail string")
    e = lambda *r: spark.createDataFrame(r, "src_id string, relation string, dst_id string, layer int, detail string")
    one = ("d", "R", "p", 1, None)
    layers = {"a": (n(("d", None, "", 1, None)), e(one, one)), "b": (n(("d", "Document", "D", 2, None), ("p", None, None, None, None)), e(one))}
    nodes, edges = Y.combine(layers)
    # an attribute comes from the first layer that has it, be it empty
    assert {tuple(r)[:4] for r in nodes.collect()} == {("d", "Document", "", 1), ("p", None, None, None)}
    assert edges.count() == 3
    counted = {tuple(r) for r in Y.stats(layers, (nodes, edges)).collect()}
    assert {("b", "nodes", "Unknown", 1), ("a", "edges", "R", 2), ("combined", "nodes", None, 2), ("combined", "edges", None, 3)} <= counted
    made = []
    makers = {name: (lambda name=name: made.append(name)) for name in Y.LAYERS}
    for phase, wanted in ((None, Y.LAYERS), ("all", Y.LAYERS), ("sponsor", ("sponsor", "cosponsor", "withdrawn")), ("ner", ("entity",)), ("other", ())):
        made.clear()
        Y.build(phase, makers)
        assert made == list(wanted)


def test_people(spark):
    rows = [(1, "1", "P1", "Rep. Doe, Ann [D-QA-6]", "D", "QA", "6.0", False), (2, "2", "P1", "Rep. Doe, Anna", "D", "QA", "nan", False), (3, "1", "P2", "Sen. Roe", "R", "QB", None, True), (4, "1", "", "x", "R", "", "", False), (5, None, "P2", "x", "R", "", "", None)]
    df = spark.createDataFrame(rows, "ord bigint, doc_id string, person_id string, full_name string, party string, state string, district string, is_withdrawn boolean")
    first = {r.node_id: r for r in L.person_nodes(df, "first").collect()}
    assert (first["sponsor:P1"].last_name, first["sponsor:P1"].first_name, first["sponsor:P1"].district, first["sponsor:P1"].chamber) == ("Doe", "Ann", "6", "Rep")
    assert {r.node_id: r.full_name for r in L.person_nodes(df, "last").collect()}["sponsor:P1"] == "Rep. Doe, Anna"
    assert [tuple(r) for r in L.shares_edges(df, "SHARES").collect()] == [("document:1", "SHARES", "document:2", "P1")]
    assert L.bipartisanship(df).where("doc = 1").first()["index"] == 0.0


@pytest.fixture(scope="module")
def network(spark):
    r = random.Random(3)
    edges = sorted({tuple(sorted(r.sample(range(14), 2))) for _ in range(26)}) + [(20, 21)]
    named = [(f"n{a:02}", f"n{b:02}", float(1 + (a * b) % 3)) for a, b in edges]
    return named, spark.createDataFrame(named, "src string, dst string, weight double")


def test_components(network):
    named, df = network
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b, _ in named:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {r.node: r.component for r in connected_components(df).collect()} == {n: find(n) for n in list(parent)}


def test_centralities(network):
    named, df = network
    nodes = sorted({x for a, b, _ in named for x in (a, b)})
    near = {n: {b if a == n else a for a, b, _ in named if n in (a, b)} for n in nodes}

    def levels(s):
        d, q = {s: 0}, [s]
        for v in q:
            for u in near[v] - set(d):
                d[u] = d[v] + 1
                q.append(u)
        return d

    def paths(s, t):
        d = levels(s)
        if t not in d:
            return []
        found = [[s]]
        for _ in range(d[t]):
            found = [[*p, u] for p in found for u in near[p[-1]] if d.get(u) == len(p)]
        return [p for p in found if p[-1] == t]

    wanted = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        ps = paths(s, t)
        for p in ps:
            for v in p[1:-1]:
                wanted[v] += 1 / len(ps)
    n = len(nodes)
    got = {r.node: r.betweenness for r in N.betweenness(df).collect()}
    assert got == pytest.approx({v: w / ((n - 1) * (n - 2)) for v, w in wanted.items()})
    close = {r.node: r.closeness for r in N.closeness(df).collect()}
    for v in nodes:
        d = levels(v)
        assert close[v] == pytest.approx((len(d) - 1) / sum(d.values()) * (len(d) - 1) / (n - 1))
    tri = {r.node: r.clustering for r in L.clustering(df).collect()}
    for v in nodes:
        k = len(near[v])
        links = sum(1 for a, b in itertools.combinations(near[v], 2) if b in near[a])
        assert tri[v] == pytest.approx(2 * links / (k * (k - 1)) if k > 1 else 0.0)
    x = {r.node: r.eigenvector for r in N.eigenvector(df).collect()}
    assert sum(v * v for v in x.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("method", ["louvain", "greedy"])
def test_planted_communities(spark, method):
    groups = [[f"{g}{i}" for i in range(6)] for g in "abc"]
    edges = [(*sorted(p), 1.0) for g in groups for p in itertools.combinations(g, 2)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    found = {r.node: r.community for r in N.communities(spark.createDataFrame(edges, "src string, dst string, weight double"), method).collect()}
    assert len({found[n] for n in found}) == 3
    assert all(len({found[n] for n in g}) == 1 for g in groups)


def test_pairs_of_one_person_are_made_by_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "PART", 50, raising=False)
    rows = [(i, str(i % 300), "P1") for i in range(310)] + [(400, "1", "P2"), (401, "2", "P3"), (402, "5", "P3"), (403, "x", "P1")]
    df = spark.createDataFrame(rows, "ord bigint, doc_id string, person_id string")
    found = L.shares_edges(df, "SHARES", True).withColumn("task", F.spark_partition_id()).collect()
    wanted = [(f"document:{i}", f"document:{j}", "P1") for i in range(300) for j in range(i + 1, 300)] + [("document:2", "document:5", "P3")]
    assert sorted((r.src_id, r.dst_id, r.person) for r in found) == sorted(wanted)
    assert len({r.task for r in found}) > 2
    assert L.shares_edges(df.limit(0), "SHARES", True).count() == 0


def _two_graphs():
    r = random.Random(8)
    return [(f"{p}{a}", f"{p}{b}", 0.25 + r.random() * (0.5 if a // 9 == b // 9 else 0.1), p) for p in "xy" for a in range(60) for b in range(a) if r.random() < (0.7 if a // 9 == b // 9 else 0.15)]


@pytest.mark.parametrize("most", [None, 12])
def test_louvain_of_many_edges_is_streamed(spark, monkeypatch, most):
    df = spark.createDataFrame(_two_graphs(), "src string, dst string, weight double, area string")
    rows = lambda x: {r.node: (r.community, round(r.inside, 9)) for r in N.weighed_communities(x, "louvain", 1.5, most=most, part="area").collect()}
    wanted = rows(df)
    assert len(wanted) == 120 and 2 < len({c for c, _ in wanted.values()}) < 60
    monkeypatch.setattr(N, "MOST_EDGES", 50)  # more were refused
    assert rows(df) == rows(df.orderBy("weight")) == wanted
    assert N.communities(df, "louvain").columns == ["node", "community"]
    with pytest.raises(ValueError, match="more than 50 edges"):
        N.communities(df, "greedy")
    with pytest.raises(Exception, match="has one twice"):
        N.communities(df.union(df.limit(1)), "louvain").collect()


def test_streamed_louvain_in_files_and_stretches(monkeypatch, tmp_path):
    edges = _two_graphs()
    adj = {}
    for a, b, w, _ in edges:
        adj.setdefault(a, {})[b] = adj.setdefault(b, {})[a] = w
    names = pd.Index(sorted(adj))
    ends = np.concatenate(([0], np.cumsum([len(adj[v]) for v in names])))
    monkeypatch.setattr(S, "HELD", 40)
    monkeypatch.setattr(S, "AT_ONCE", 64)
    monkeypatch.setattr(S, "STRETCH", 8)
    columns = [pa.array(c) for c in list(zip(*edges))[:3]]
    batches = pa.RecordBatch.from_arrays(columns, ["src", "dst", "weight"])
    g = S._read((batches.slice(i, 100) for i in range(0, len(edges), 100)), names, ends, S._space(str(tmp_path)))
    assert isinstance(g.near, np.memmap) and len(list(g.stretches())) > 20
    found = S._louvain(g, 1.5)
    assert dict(zip(names, names[found])) == N.louvain(list(names), adj, 1.5)
    assert len(S._louvain(S._Graph(np.zeros(1, np.int64), g.near[:0], g.weight[:0]), 1.5)) == 0
