"""The layers of the multiplex graph: sponsors, cosponsors, withdrawn cosponsors, communities, entities.

A layer is a pair of tables: nodes ``(node_id, node_type, label, layer, detail)``, one row a node, and edges ``(src_id,
relation, dst_id, layer, detail)``, parallel edges kept. A node that only edges name has NULL attributes, a document such
a node is labelled with its id. Rows with a blank id or end are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.ids import layer_slug

NODE = ("node_id", "node_type", "label", "layer", "detail")
EDGE = ("src_id", "relation", "dst_id", "layer", "detail")

# fixed values: of each entity list the relation, the name field, the prefix of its ids and the field kept as detail;
# phases with the layers they build; characters kept of a context
ENTITIES = {
    "organizations": ("MENTIONS_ORG", "name", "org", "acronym"),
    "offices": ("MENTIONS_OFFICE", "name", "office", "parent_org"),
    "roles": ("INVOLVES_ROLE", "title", "role", "org"),
    "legislation_refs": ("REFERENCES_LEGISLATION", "name", "legislation", "citation"),
    "named_docs": ("INVOLVES_NAMED_DOC", "name", "named_doc", "doc_type"),
}
PHASES = {"sponsor": ("sponsor", "cosponsor", "withdrawn"), "cosponsor": ("cosponsor", "withdrawn"), "community": ("community",), "ner": ("entity",)}
LAYERS = ("sponsor", "cosponsor", "withdrawn", "community", "entity")
CONTEXT = 200


def _filled(nodes: DataFrame, edges: DataFrame, layer: int) -> DataFrame:
    """The nodes with those that only edges name."""
    ends = edges.select(F.col("src_id").alias("node_id")).union(edges.select("dst_id")).distinct().join(nodes.select("node_id"), "node_id", "left_anti")
    document = F.col("node_id").startswith("document:")
    bare = ends.select("node_id", F.when(document, "Document").alias("node_type"), F.when(document, F.col("node_id")).alias("label"), F.when(document, F.lit(layer)).alias("layer"), F.lit(None).cast("string").alias("detail"))
    return nodes.select(*NODE).unionByName(bare)


def people_layer(people: DataFrame, edges: DataFrame, node_type: str, layer: int) -> tuple[DataFrame, DataFrame]:
    """Of person nodes and sponsorship edges; the last row of a node counts. The stored layer of both cosponsor layers is 2."""
    nodes = people.where("node_id <> ''").select("node_id", F.lit(node_type).alias("node_type"), F.col("full_name").alias("label"), F.lit(layer).alias("layer"), F.concat_ws("|", "party", "state", "district", "chamber").alias("detail"))
    kept = edges.where("src_id <> '' AND dst_id <> ''").select("src_id", "relation", "dst_id", F.lit(layer).alias("layer"), F.lit(None).cast("string").alias("detail"))
    return _filled(nodes, kept, layer), kept


def community_layer(labels: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``(community, size, label, dominant_party)`` and ``(doc, community, centrality)``: documents IN_COMMUNITY."""
    nodes = labels.where("community <> ''").select(F.col("community").alias("node_id"), F.lit("Community").alias("node_type"), "label", F.lit(2).alias("layer"), F.concat_ws("|", "dominant_party", F.col("size").cast("string")).alias("detail"))
    edges = members.where("community <> ''").select(
        F.concat(F.lit("document:"), F.col("doc").cast("string")).alias("src_id"), F.lit("IN_COMMUNITY").alias("relation"), F.col("community").alias("dst_id"),
        F.lit(2).alias("layer"), F.coalesce("centrality", F.lit(0.0)).cast("string").alias("detail"),
    )
    return _filled(nodes, edges, 2), edges


def entity_mentions(records: DataFrame) -> DataFrame:
    """``(record_id, doc, list, pos, kind, name, detail, context)`` of the entity lists a table has; empty names dropped."""
    out = None
    for i, (kind, (_, field, _, detail)) in enumerate(ENTITIES.items()):
        if kind not in records.columns:
            continue
        fields = records.schema[kind].dataType.elementType.fieldNames()
        has = lambda f: F.col(f"e.{f}") if f in fields else F.lit(None).cast("string")
        part = records.select("record_id", F.trim(F.coalesce("doc_id", F.lit(""))).alias("doc"), F.posexplode(kind).alias("pos", "e")).where("doc <> ''")
        part = part.select("record_id", "doc", F.lit(i).alias("list"), "pos", F.lit(kind).alias("kind"), has(field).alias("name"), has(detail).alias("detail"), has("context").alias("context"))
        out = part if out is None else out.unionByName(part)
    return out.where("name <> ''")


def _prefixes(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, (_, _, prefix, _) in ENTITIES.items():
        out = F.when(kind == k, prefix).otherwise(out)
    return out


def _with_ids(df: DataFrame, terms: DataFrame, name: str, kind: str, out: str) -> DataFrame:
    """With the entry of the lower-case name in the canonical map, else prefix and slug."""
    t = terms.select(F.col("term").alias("map_term"), F.col("entity_id").alias("map_id"))
    j = df.join(t, F.lower(F.trim(name)) == F.col("map_term"), "left")
    return j.withColumn(out, F.coalesce("map_id", F.concat(_prefixes(F.col(kind)), F.lit(":"), layer_slug(F.col(name))))).drop("map_term", "map_id")


def entity_layer(records: DataFrame, terms: DataFrame, relationships: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with the entities all their records mention, and relations between entities.

    ``terms`` is ``(term, entity_id)``. An entity keeps the attributes of its first mention. ``relationships`` ``(record_id,
    doc, source_type, source_name, target_type, target_name, relation_type, context)`` count where all parts are given, both
    types are known, and both entities were mentioned in the same record or an earlier one.
    """
    m = _with_ids(entity_mentions(records), terms, "name", "kind", "node")
    order = F.struct("record_id", "list", "pos")
    words = {k: p.replace("_", " ").title() for k, (_, _, p, _) in ENTITIES.items()}
    node_type, relation = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (r, *_) in ENTITIES.items():
        node_type, relation = F.when(F.col("kind") == k, words[k]).otherwise(node_type), F.when(F.col("kind") == k, r).otherwise(relation)
    first = m.groupBy(F.col("node").alias("node_id")).agg(F.min_by(F.struct(node_type.alias("t"), "name", F.coalesce("detail", F.lit("")).alias("d")), order).alias("a"), F.min("record_id").alias("since"))
    nodes = first.select("node_id", F.col("a.t").alias("node_type"), F.col("a.name").alias("label"), F.lit(3).alias("layer"), F.col("a.d").alias("detail"))
    edges = m.select(F.concat(F.lit("document:"), "doc").alias("src_id"), relation.alias("relation"), F.col("node").alias("dst_id"), F.lit(3).alias("layer"), F.substring("context", 1, CONTEXT).alias("detail"))
    if relationships is not None:
        filled = " AND ".join(f"{c} <> ''" for c in ("source_type", "source_name", "target_type", "target_name", "relation_type"))
        kinds = ", ".join(repr(k) for k in ENTITIES)
        r = relationships.where(f"{filled} AND source_type IN ({kinds}) AND target_type IN ({kinds})")
        r = _with_ids(_with_ids(r, terms, "source_name", "source_type", "src_id"), terms, "target_name", "target_type", "dst_id")
        for end in ("src_id", "dst_id"):
            r = r.join(first.select(F.col("node_id").alias(end), F.col("since").alias(f"since_{end}")), end).where(F.col(f"since_{end}") <= F.col("record_id"))
        edges = edges.unionByName(r.select("src_id", F.col("relation_type").alias("relation"), "dst_id", F.lit(3).alias("layer"), F.substring("context", 1, CONTEXT).alias("detail")))
    documents = records.select(F.trim(F.coalesce("doc_id", F.lit(""))).alias("doc")).where("doc <> ''").distinct().select(F.concat(F.lit("document:"), "doc").alias("node_id"))
    documents = documents.select("node_id", F.lit("Document").alias("node_type"), F.col("node_id").alias("label"), F.lit(3).alias("layer"), F.lit(None).cast("string").alias("detail"))
    return nodes.unionByName(documents), edges


def combine(layers: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes of all layers merged, an attribute from the first layer that has it; all edges."""
    nodes = edges = None
    for i, (n, e) in enumerate(layers.values()):
        n, e = n.select(*NODE).withColumn("rank", F.lit(i)), e.select(*EDGE)
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c)
    return nodes.groupBy("node_id").agg(*[first(c) for c in NODE[1:]]), edges


def build(phase: str | None, makers: dict[str, object]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The layers of a phase, made by ``makers`` ``{layer: () -> (nodes, edges)}``: all of them for None or 'all', none for a
    phase not known."""
    wanted = LAYERS if phase in (None, "all") else PHASES.get(phase, ())
    return {name: makers[name]() for name in LAYERS if name in wanted and name in makers}


def stats(layers: dict[str, tuple[DataFrame, DataFrame]], combined: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``(layer, what, kind, n)``: nodes by type and edges by relation with totals (kind NULL) of every layer, and the totals
    of the combination; a node without a type counts as Unknown."""

    def of(name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        n = nodes.select(F.coalesce("node_type", F.lit("Unknown")).alias("kind")).rollup("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes"))
        e = edges.select(F.coalesce("relation", F.lit("Unknown")).alias("kind")).rollup("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("edges"))
        return n.unionByName(e).select(F.lit(name).alias("layer"), "what", "kind", "n")

    out = of("combined", *combined).where("kind IS NULL")
    for name, (nodes, edges) in layers.items():
        out = out.unionByName(of(name, nodes, edges))
    return out
