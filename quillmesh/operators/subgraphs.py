"""Parts of a graph and tables about its nodes. Edges are ``(src, dst, …)``; a graph part is ``(nodes, edges)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import ratio
from quillmesh.operators.components import connected_components
from quillmesh.operators.legislators import degrees, facts
from quillmesh.session import materialize


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """The edges with both ends among the nodes."""
    kept = nodes.select(F.col(node).alias("keep")).distinct()
    inside = edges.join(kept, F.col("src") == F.col("keep"), "left_semi")
    return inside.join(kept, F.col("dst") == F.col("keep"), "left_semi")


def ego(edges: DataFrame, node: str, radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, hops)`` within ``radius`` steps in either direction, and the edges between them. The node itself is
    part of it even without an edge. Every step is written, so the plan does not grow."""
    if radius < 0:
        raise ValueError("radius must not be negative")
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    found = spark.createDataFrame([(node, 0)], "node string, hops int")
    for hop in range(1, radius + 1):
        edge = found.where(F.col("hops") == hop - 1).select(F.col("node").alias("src"))
        fresh = both.join(edge, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        found = materialize(found.unionByName(fresh.withColumn("hops", F.lit(hop))), "ego")
    return found, induced(edges, found)


def by_attribute(nodes: DataFrame, edges: DataFrame, attribute: str, value) -> tuple[DataFrame, DataFrame]:
    """The nodes whose attribute has the value, and the edges between them."""
    kept = nodes.where(F.col(attribute) == F.lit(value))
    return kept, induced(edges, kept)


def cross_party_graph(people: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All people ``(node, party)`` and the edges between people of different known parties."""
    p = people.where("party <> ''")
    a, b = p.toDF("src", "party_src"), p.toDF("dst", "party_dst")
    return people, pairs.join(a, "src").join(b, "dst").where("party_src <> party_dst")


def bridges(people: DataFrame, pairs: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """People with a tie across parties: weighted degrees, cross ratio and, if given, betweenness in the crossing graph."""
    _, crossing = cross_party_graph(people, pairs)
    cross = degrees(crossing.select("src", "dst", "weight")).select("node", F.col("weighted_degree").alias("cross_degree"))
    total = degrees(pairs).select("node", F.col("weighted_degree").alias("total_degree"))
    out = cross.join(total, "node").join(people, "node").select("node", "party", "cross_degree", "total_degree", (F.col("cross_degree") / F.greatest("total_degree", F.lit(1))).alias("cross_ratio"))
    return out if betweenness is None else out.join(betweenness, "node", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))


def largest_component(edges: DataFrame) -> DataFrame:
    """The nodes of the largest component; of equal ones the one with the least node."""
    found = materialize(connected_components(edges), "component-of")
    best = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(F.broadcast(best), "component", "left_semi").select("node")


def top_nodes(measures: DataFrame, measure: str, n: int = 20) -> DataFrame:
    return measures.orderBy(F.desc(measure), "node").limit(n)


def strongest_edges(edges: DataFrame, share: float = 0.2, least: int = 500) -> DataFrame:
    """The top ``share`` of the edges by weight, at least ``least`` of them: those at or above the weight of the last, ties
    by their ends. The cut is found from counts of distinct weights."""
    n = edges.count()
    wanted = max(int(n * share), least)
    counts = edges.groupBy("weight").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0)))
    cut = before.where(F.col("before") < wanted).agg(F.min("weight").alias("cut"), F.max("before").alias("above"))
    marked = edges.join(F.broadcast(cut), F.col("weight") >= F.col("cut"))
    last = marked.where("weight = cut").withColumn("rank", F.row_number().over(Window.partitionBy("weight").orderBy("src", "dst"))).where(F.col("rank") <= wanted - F.col("above"))
    return marked.where("weight > cut").drop("cut", "above").unionByName(last.drop("cut", "above", "rank"))


def undirected_degree(edges: DataFrame) -> DataFrame:
    """``(node, degree)``; parallel edges count, a loop counts twice."""
    ends = edges.select(F.col("src_id").alias("node")).unionAll(edges.select("dst_id"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, node_type: str = "Document", n: int = 10) -> DataFrame:
    """The nodes of a type with most edges."""
    of_type = nodes.where(F.col("node_type") == node_type).select(F.col("node_id").alias("node"), "label")
    return undirected_degree(edges).join(of_type, "node").orderBy(F.desc("degree"), "node").limit(n)


def neighbours_by_type(nodes: DataFrame, edges: DataFrame, node: str, n: int = 12) -> DataFrame:
    """``(node_type, rank, node, degree)``: the neighbours of a node, of every type those with most edges."""
    near = edges.where(F.col("src_id") == node).select(F.col("dst_id").alias("node")).union(edges.where(F.col("dst_id") == node).select("src_id")).distinct().where(F.col("node") != node)
    typed = near.join(nodes.select(F.col("node_id").alias("node"), "node_type"), "node").join(undirected_degree(edges), "node")
    w = Window.partitionBy("node_type").orderBy(F.desc("degree"), "node")
    return typed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("node_type", "rank", "node", "degree")


def cross_cutting(edges: DataFrame, least: int = 10) -> DataFrame:
    """``(node, n_docs)``: what at least ``least`` documents are linked with."""
    document = lambda c: F.col(c).startswith("document:")
    out = edges.where(document("src_id") & ~document("dst_id")).select(F.col("dst_id").alias("node"), F.col("src_id").alias("doc"))
    back = edges.where(document("dst_id") & ~document("src_id")).select(F.col("src_id").alias("node"), F.col("dst_id").alias("doc"))
    return out.union(back).groupBy("node").agg(F.countDistinct("doc").alias("n_docs")).where(F.col("n_docs") >= least)


def around_document(edges: DataFrame, document: str, relations: list[str]) -> DataFrame:
    """``(relation, node)``: what one document is linked with by the given relations, from the document's side."""
    return edges.where((F.col("src_id") == document) & F.col("relation").isin(*relations)).select("relation", F.col("dst_id").alias("node")).distinct()


def related(edges: DataFrame, node: str, relation: str) -> DataFrame:
    """Nodes linked with ``node`` by a relation in either direction."""
    r = edges.where(F.col("relation") == relation)
    return r.where(F.col("src_id") == node).select(F.col("dst_id").alias("node")).union(r.where(F.col("dst_id") == node).select("src_id")).distinct()


def bipartite(rows: DataFrame) -> DataFrame:
    """``(doc, person, party, n)``: one edge a pair with the attributes of its last row."""
    return facts(rows).groupBy("doc", "person").agg(F.max_by("party", "ord").alias("party"), F.count("*").alias("n"))


def projection(edges: DataFrame, keep: str, over: str) -> DataFrame:
    """One-mode projection of ``(keep, over)`` pairs by the number of common neighbours; ``src < dst``."""
    e = edges.select(F.col(keep).alias("k"), F.col(over).alias("o")).distinct()
    return e.toDF("src", "o").join(e.toDF("dst", "o"), "o").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def with_isolated(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """Degree and weighted degree of all people, 0 for those without an edge, over all of them as nodes."""
    d = degrees(pairs).select("node", "degree", "weighted_degree")
    n = people.agg(F.count("*").alias("n"))
    out = people.select("node").join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0)).alias("weighted_degree"))
    return out.join(F.broadcast(n)).select("node", "degree", "weighted_degree", ratio(F.col("degree"), F.col("n") - 1).alias("degree_centrality"))
