"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.bpe import encode
from quillmesh.llm.canonical_map import load_reference, map_names, misses
from quillmesh.llm.containers import fill_containers
from quillmesh.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from quillmesh.llm.private_data import find_private, redact
from quillmesh.llm.setjoin import similar_sets
from quillmesh.llm.split import LIMIT, OVERLAP, pieces, section_openings
from quillmesh.llm.variants import variant_keys, variant_pairs
from quillmesh.sources.tables import table


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = encode(table(spark, sf, "documents"), "doc_id", "text", ids=False)
    return fill_containers(sizes, "doc_id")


def p9_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The same texts in containers of four context sizes."""
    sizes = encode(table(spark, sf, "documents"), "doc_id", "text", ids=False)
    return fill_containers(sizes, "doc_id", windows=(256, 512, 1024, 2048))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return section_openings(table(spark, sf, "documents"), "doc_id", "text")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces(table(spark, sf, "documents"), "doc_id", "text").drop("openings")


def p1_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the pieces of every text: they reach its end, keep the limit and the overlap, and are its characters."""
    d = table(spark, sf, "documents")
    p = pieces(d, "doc_id", "text").withColumn("next_start", F.lead("char_start").over(Window.partitionBy("doc_id").orderBy("piece")))
    p = p.join(d.select("doc_id", F.col("text").alias("whole")), "doc_id")
    same = F.expr("substring(whole, cast(char_start + 1 as int), cast(char_end - char_start as int))") == F.col("text")
    return p.groupBy("doc_id").agg(
        F.min("char_start").alias("first_start"), F.max("char_end").alias("last_end"), F.every(F.length("text") <= LIMIT).alias("within"),
        F.every(F.col("next_start").isNull() | (F.col("next_start") == F.col("char_end") - OVERLAP)).alias("overlapping"), F.every(same).alias("unchanged"),
    )


def _reference(spark: SparkSession, sf: str):
    registry = table(spark, sf, "registry").where("entity_type = 'organizations'")
    return load_reference(registry, "entity_id", "canonical_name", "acronym", "aliases")


_ANNOTATION = ("annotation_id", "doc_id", "entity_type", "name", "title", "acronym")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = _reference(spark, sf).common.frequency
    return variant_pairs(table(spark, sf, "manual_annotations"), vocabulary, *_ANNOTATION)


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = _reference(spark, sf).common.frequency
    keys = variant_keys(table(spark, sf, "manual_annotations"), vocabulary, *_ANNOTATION)
    size = F.count("*").alias("n_rows")
    return keys.join(keys.groupBy("entity").agg(size, F.min("id").alias("first_id")), "entity").select(
        F.col("id").alias("annotation_id"), "first_id", "n_rows"
    )


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    reference = _reference(spark, sf)
    entries = table(spark, sf, "entity_record").select("record_id", F.posexplode("organizations").alias("at", "o"))
    entries = entries.select("record_id", F.col("at").cast("bigint").alias("org_pos"), F.col("o.name").alias("name"))
    return map_names(entries, "name", reference)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("record_id", "org_pos", "entity_id")


def p3_misses(spark: SparkSession, sf: str) -> DataFrame:
    return misses(_mapped(spark, sf), "name")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_sets(table(spark, sf, "segments_raw"), "ord", "taxonomy_tags", threshold=0.7, min_size=6)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf, "documents"), "doc_id", "title", "text", threshold=0.6, shingle=3)


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf, "documents"), "doc_id", "title", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_private(table(spark, sf, "documents"), "doc_id", "text", "lang")


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redact(table(spark, sf, "documents"), "doc_id", "text", "lang")


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_misses": p3_misses, "p10_found": p10_found, "p10_redacted": p10_redacted, "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_bounds": p1_bounds, "p9_windows": p9_windows, "p4_found": p4_found, "p5_found": p5_found, "p5_groups": p5_groups, "p8_ids": p8_ids, "p9_containers": p9_containers}
SQL: dict[str, str] = {
    "p5_groups": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT doc_id, md5(array_to_string(w, ' ')) AS d, w FROM w WHERE len(w) >= 40), r AS (SELECT d, min(doc_id) AS rep, any_value(w) AS w FROM c GROUP BY d),
s AS (SELECT rep, list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) AS s FROM r),
u AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n + b.n) AS n FROM u a JOIN u b ON a.t = b.t AND a.rep <> b.rep GROUP BY ALL HAVING count(*) / CAST(any_value(a.n + b.n) - count(*) AS DOUBLE) >= 0.8),
g AS (SELECT rep AS node, rep AS comp FROM r UNION SELECT p.b, g.comp FROM g JOIN p ON p.a = g.node),
k AS (SELECT node, min(comp) AS comp FROM g GROUP BY node), l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT d.doc_id, coalesce(k.comp, d.doc_id) AS group_id, coalesce(l.n, 0) AS n_links FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN r ON r.d = c.d LEFT JOIN k ON k.node = r.rep LEFT JOIN l ON l.a = r.rep""",
    "p1_bounds": "SELECT doc_id, CAST(0 AS BIGINT) AS first_start, length(text) AS last_end, true AS within, true AS overlapping, true AS unchanged FROM documents WHERE length(text) > 6000",
    "p4_found": """
WITH r AS (SELECT ord, list_distinct(list_filter(list_transform(taxonomy_tags, lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))),
                                                 lambda x: x IS NOT NULL AND x <> '')) AS s FROM segments_raw),
u AS (SELECT ord, len(s) AS n, unnest(s) AS t FROM r WHERE len(s) >= 6),
p AS (SELECT a.ord AS ord_a, b.ord AS ord_b, count(*) AS i, any_value(a.n + b.n) AS n FROM u a JOIN u b ON a.t = b.t AND a.ord < b.ord GROUP BY ALL)
SELECT ord_a, ord_b FROM p WHERE i / CAST(n - i AS DOUBLE) >= 0.7""",
    "p5_found": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 40),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS i, any_value(a.n + b.n) AS n FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_id_a, doc_id_b FROM p WHERE i / CAST(n - i AS DOUBLE) >= 0.6""",
}
