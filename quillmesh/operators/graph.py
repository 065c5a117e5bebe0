"""Property graphs of a document collection: nodes and edges, first insertion wins.

Candidates carry the order in which a sequential build would insert them (stage, row, place in the row); the first of
each key is kept by an aggregation, which combines before it shuffles. Blank keys are skipped; NULL counts as blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.ids import node_id
from quillmesh.functions.text import split_list, squeeze
from quillmesh.operators.orphans import id_number
from quillmesh.session import materialize

# fixed values: weights of relations and what a hop costs
DEFAULT_WEIGHTS = {"HAS_TOPIC": 1.0, "HAS_TAG": 0.85, "HAS_SEGMENT": 0.75, "IN_COLLECTION": 0.65, "UNDER_AUTHORITY": 0.55}
HOP_DECAY = 0.7


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _node(kind: str, node_type: str, key: Column, label: Column) -> Column:
    return F.struct(node_id(kind, key).alias("node_id"), F.lit(node_type).alias("node_type"), squeeze(label).alias("label"))


def _link(src: Column, relation: str, dst: Column) -> Column:
    return F.struct(src.alias("src_id"), F.lit(relation).alias("relation"), dst.alias("dst_id"))


def _each(values: Column, make) -> Column:
    return F.transform(values, make)


def _staged(df: DataFrame, stage: int, key: Column, nodes: list[Column], edges: list[Column]) -> DataFrame:
    """Rows with arrays of node and edge candidates in insertion order."""
    none_n = F.array().cast("array<struct<node_id:string,node_type:string,label:string>>")
    none_e = F.array().cast("array<struct<src_id:string,relation:string,dst_id:string>>")
    return df.where(key != "").select(
        F.lit(stage).alias("stage"), F.col("ord"), F.concat(none_n, *nodes).alias("nodes"), F.concat(none_e, *edges).alias("edges")
    )


def graph_rows(documents: DataFrame, segments: DataFrame, authorities: DataFrame, collections: DataFrame) -> DataFrame:
    topics = F.filter(
        F.transform(F.coalesce(F.col("taxonomy_tags"), F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != ""
    )
    name = _blank("name")
    doc = F.coalesce(id_number(F.col("doc_id")).cast("string"), F.lit(""))
    position = _blank("position")
    document = node_id("document", doc)
    segment = node_id("segment", F.concat_ws(":", doc, position))
    tags = split_list(F.col("tags"))
    tag_nodes = _each(tags, lambda t: _node("tag", "Tag", t, t))
    packed = split_list(F.col("collections"))
    authority = _blank("authority")
    one_authority = F.filter(F.array(authority), lambda a: a != "")
    parts = [
        _staged(authorities, 1, name, [F.array(_node("authority", "Authority", name, name))], []),
        _staged(collections, 2, name, [F.array(_node("collection", "Collection", name, name))], []),
        _staged(
            segments,
            3,
            F.when((doc != "") & (position != ""), doc).otherwise(""),
            [
                F.array(_node("segment", "Segment", F.concat_ws(":", doc, position), F.concat(F.lit("Segment "), position))),
                tag_nodes,
                _each(topics, lambda t: _node("topic", "Topic", t, t)),
            ],
            [
                F.array(_link(document, "HAS_SEGMENT", segment)),
                _each(tags, lambda t: _link(segment, "HAS_TAG", node_id("tag", t))),
                _each(topics, lambda t: _link(segment, "HAS_TOPIC", node_id("topic", t))),
            ],
        ),
        _staged(
            documents,
            4,
            doc,
            [
                F.array(_node("document", "Document", doc, F.when(_blank("official_name") != "", _blank("official_name")).otherwise(F.concat(F.lit("Document "), doc)))),
                _each(one_authority, lambda a: _node("authority", "Authority", a, a)),
                _each(packed, lambda c: _node("collection", "Collection", c, c)),
                tag_nodes,
            ],
            [
                _each(one_authority, lambda a: _link(document, "UNDER_AUTHORITY", node_id("authority", a))),
                _each(packed, lambda c: _link(document, "IN_COLLECTION", node_id("collection", c))),
                _each(tags, lambda t: _link(document, "HAS_TAG", node_id("tag", t))),
            ],
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_nodes(rows: DataFrame) -> DataFrame:
    flat = rows.select("stage", "ord", F.posexplode("nodes").alias("sub", "n"))
    order = F.struct("stage", "ord", "sub")
    return flat.groupBy("n.node_id").agg(F.min_by("n.node_type", order).alias("node_type"), F.min_by("n.label", order).alias("label"))


def graph_edges(rows: DataFrame) -> DataFrame:
    """With ``edge_order``, the place of the first insertion."""
    flat = rows.select("stage", "ord", F.posexplode("edges").alias("sub", "e"))
    return flat.groupBy("e.src_id", "e.relation", "e.dst_id").agg(F.min(F.struct("stage", "ord", "sub")).alias("edge_order"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(what, kind, n)``: counts by node type and relation, and the totals (kind NULL)."""
    n = nodes.rollup("node_type").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), F.col("node_type").alias("kind"), "n")
    e = edges.rollup("relation").agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.col("relation").alias("kind"), "n")
    return n.unionByName(e)


def neighborhood(
    nodes: DataFrame,
    edges: DataFrame,
    seed: str,
    max_hops: int = 2,
    limit: int = 50,
    direction: str = "out",
    relations: set[str] | None = None,
    node_types: set[str] | None = None,
    weights: dict[str, float] | None = None,
    hop_decay: float = HOP_DECAY,
    ranked: bool = True,
) -> DataFrame:
    """Nodes within ``max_hops`` of ``seed``: hop, first relation of the path, score and path.

    The relation filter prunes the walk, the type filter only the output. Of several shortest paths the one a
    first-in-first-out walk meets first is kept: paths carry the order of their steps, so no global numbering is needed.
    """
    if max_hops < 1 or limit < 1 or hop_decay < 0 or direction not in ("out", "in", "both"):
        raise ValueError("max_hops and limit must be positive, hop_decay not negative, direction out, in or both")
    if not nodes.where(F.col("node_id") == seed).take(1):
        raise ValueError(f"seed node not found: {seed}")
    relations = {r.strip() for r in relations or () if r.strip()}
    node_types = {t.strip() for t in node_types or () if t.strip()}
    used = edges.where(F.col("relation").isin(*relations)) if relations else edges
    forward = used.select(F.col("src_id").alias("at"), "relation", F.col("dst_id").alias("to"), F.lit(0).alias("turn"), "edge_order")
    backward = used.select(F.col("dst_id").alias("at"), "relation", F.col("src_id").alias("to"), F.lit(1).alias("turn"), "edge_order")
    steps = {"out": forward, "in": backward, "both": forward.unionByName(backward)}[direction]
    order_type = "array<struct<turn:int,edge_order:struct<stage:int,ord:bigint,sub:int>>>"
    steps = steps.where("at <> to")
    frontier = nodes.where(F.col("node_id") == seed).select(F.col("node_id").alias("at"), F.array().cast(order_type).alias("trail"), F.lit(None).cast("string").alias("via"))
    reached = []
    for hop in range(1, max_hops + 1):
        # only the node before and the relation travel with a step; paths are put together for the rows that are kept
        onward = frontier.join(steps, "at").select(
            "to", F.col("at").alias("before"), "relation", F.coalesce("via", "relation").alias("via"),
            F.concat("trail", F.array(F.struct("turn", F.col("edge_order").cast("struct<stage:int,ord:bigint,sub:int>").alias("edge_order")))).alias("trail"),
        )
        for earlier in reached:
            onward = onward.join(earlier.select("to"), "to", "left_anti")
        step = F.struct("before", "relation", "via")
        here = onward.where(F.col("to") != seed).groupBy("to").agg(F.min_by(step, "trail").alias("s"), F.min("trail").alias("trail"))
        here = materialize(here.select("to", "s.before", "s.relation", "s.via", "trail").withColumn("hop_distance", F.lit(hop)), "hop")
        reached.append(here)
        frontier = here.select(F.col("to").alias("at"), "trail", "via")
    found = reached[0]
    for here in reached[1:]:
        found = found.unionByName(here)
    via = F.col("via")
    base = F.lit(0.5)
    for relation, w in (DEFAULT_WEIGHTS | (weights or {})).items():
        base = F.when(via == relation, w).otherwise(base)
    rows = found.join(nodes, found["to"] == nodes["node_id"], "left").select(
        F.col("to").alias("node_id"),
        F.trim(F.coalesce("node_type", F.lit(""))).alias("node_type"),
        F.trim(F.coalesce("label", F.lit(""))).alias("label"),
        "hop_distance",
        via.alias("via_relation"),
        F.round(base * F.pow(F.lit(hop_decay), F.col("hop_distance") - 1), 8).alias("rank_score"),
        "before", F.col("relation").alias("last_relation"),
    )
    if node_types:
        rows = rows.where(F.col("node_type").isin(*node_types))
    keys = ["hop_distance", "node_type", "node_id"]
    order = [*([F.desc("rank_score")] if ranked else []), *keys]
    # at most `limit` rows: their paths are followed back, one small join a hop
    kept = rows.orderBy(*order).limit(limit)
    last = F.struct(F.col("before").alias("from"), F.col("last_relation").alias("relation"), F.col("node_id").alias("to"))
    kept = kept.withColumn("path", F.array(last)).withColumn("at", F.when(F.col("hop_distance") > 1, F.col("before")))
    for hop in range(max_hops - 1, 0, -1):
        back = reached[hop - 1].select(F.col("to").alias("b_to"), F.col("before").alias("b_from"), F.col("relation").alias("b_relation"))
        due = F.col("at").isNotNull() & (F.size("path") == F.col("hop_distance") - hop)
        kept = kept.join(back, due & (F.col("at") == F.col("b_to")), "left")
        one = F.struct(F.col("b_from").alias("from"), F.col("b_relation").alias("relation"), F.col("b_to").alias("to"))
        kept = kept.withColumn("path", F.when(F.col("b_to").isNotNull(), F.concat(F.array(one), "path")).otherwise(F.col("path"))).withColumn("at", F.coalesce("b_from", "at")).drop("b_to", "b_from", "b_relation")
    return kept.drop("before", "last_relation", "at").orderBy(*order)


def hop_counts(neighbors: DataFrame) -> DataFrame:
    return neighbors.groupBy("hop_distance").agg(F.count("*").alias("n"))
