"""Tags of documents and segments: totals, co-occurrence, signatures, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.blocks import packed, similar_pairs
from quillmesh.operators.orphans import id_number


def clean_tags(c: Column) -> Column:
    """Distinct lower-case tags of an array; NULL and blanks dropped."""
    low = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(F.trim(F.coalesce(t, F.lit("")))))
    return F.array_sort(F.array_distinct(F.filter(low, lambda t: t != "")))


def segment_tags(segments: DataFrame) -> DataFrame:
    """``(ord, doc, tag)``."""
    return segments.select("ord", id_number(F.col("doc_id")).alias("doc"), F.explode(clean_tags(F.col("taxonomy_tags"))).alias("tag"))


def group_of(tag: Column) -> Column:
    return F.trim(F.substring_index(tag, ":", 1))


def hierarchy(taxonomy: DataFrame) -> DataFrame:
    """Label, group, parent and whether the label is at the top of its group."""
    parts = F.split(F.trim("name"), ": ")
    return taxonomy.where(F.trim(F.coalesce("name", F.lit(""))) != "").select(
        F.trim("name").alias("name"),
        parts[0].alias("grp"),
        F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ": ")).alias("parent"),
        (F.size(parts) <= 2).alias("is_top"),
    )


def tag_totals(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n_segments"), F.countDistinct("doc").alias("n_docs"))


def group_totals(tags: DataFrame) -> DataFrame:
    return tags.groupBy(group_of(F.col("tag")).alias("grp")).agg(F.count("*").alias("n"), F.countDistinct("tag").alias("n_tags"))


def cooccurrence(tags: DataFrame, left: str, right: str, min_support: int = 1) -> DataFrame:
    """``(src, dst, weight)``: tags of one group with tags of another by documents with both."""
    docs = tags.where("doc IS NOT NULL").select("doc", "tag").distinct()
    a = docs.where(group_of(F.col("tag")) == left).toDF("doc", "src")
    b = docs.where(group_of(F.col("tag")) == right).toDF("doc", "dst")
    return a.join(b, "doc").groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_support)


def matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Co-occurrence as a matrix with the given, sorted columns; zero rows do not occur."""
    return pairs.groupBy("src").pivot("dst", sorted(columns)).sum("weight").na.fill(0)


def segments_per_document(segments: DataFrame) -> DataFrame:
    n = segments.select(id_number(F.col("doc_id")).alias("doc")).where("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_segments"), F.max("n").alias("max_n"), F.percentile("n", F.lit(0.5)).alias("median_n"))


def coverage(documents: DataFrame) -> DataFrame:
    """How many catalogue rows have a value in each field."""
    has = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "")
    fields = ["casual_name", "authority", "collections", "tags", "short_summary", "long_summary", "proposed_date"]
    return documents.agg(F.count("*").alias("n"), *[has(c).alias(f"with_{c}") for c in fields])


def signature(grouped: DataFrame, share: float = 0.4, label: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """Of groups ``(grp, member, tag)``: the ``label`` most frequent tags and the tags of at least ``share`` of the members.

    ``sizes`` ``(grp, size)`` also counts members without a tag."""
    size = grouped.groupBy("grp").agg(F.countDistinct("member").alias("size")) if sizes is None else sizes
    n = grouped.groupBy("grp", "tag").agg(F.countDistinct("member").alias("n"))
    w = Window.partitionBy("grp").orderBy(F.desc("n"), "tag")
    r = n.join(size, "grp").withColumn("rank", F.row_number().over(w))
    by_tag = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "tag")))), lambda x: x["tag"])
    return r.groupBy("grp").agg(F.first("size").alias("size"), F.coalesce(F.nullif(F.array_join(by_tag(F.col("rank") <= label), " | "), F.lit("")), F.lit("General")).alias("label"), by_tag(F.col("n") >= share * F.col("size")).alias("signature"))


def jaccard_pairs(members: DataFrame, threshold: float = 0.25, queries: str | None = None) -> DataFrame:
    """``(src, dst, similarity)`` of ``(item, tag)`` sets with more than ``threshold`` in common, met in blocks.

    Pairs ``src < dst`` of all items, or with ``queries``, a condition on ``item``, of these items with all others. Items are
    numbers. The pairs themselves grow with the square of a tag's items; the join of sets by prefixes is made for those.
    """
    asked = None if queries is None else members.where(queries).select(F.col("item").cast("bigint").alias("id"))
    return similar_pairs(packed(members.select("item", "tag")), threshold, queries=asked)


def tfidf(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, token, weight)``: raw counts times ln((N + 1) / (df + 1)) of the lower-case words."""
    words = texts.select(F.col(key), F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))).alias("token"))
    tf = words.groupBy(key, "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n_docs"))
    return tf.join(df, "token").join(F.broadcast(n)).select(key, "token", (F.col("tf") * F.log((F.col("n_docs") + 1) / (F.col("df") + 1))).alias("weight"), "tf", "df")


def cosine_to(vectors: DataFrame, key: str, vector: str, queries: DataFrame, block: int = 4096) -> DataFrame:
    """``(query, key, cosine)`` of a stated query set to every vector, the queries sent in blocks of bounded size.

    NULL vectors and those of length 0 are left out; all vectors must have one dimension.
    """
    import numpy as np
    import pandas as pd

    def of(m):
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    usable = F.col(vector).isNotNull() & (F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.abs(x).cast("double")) > 0)
    base = vectors.where(usable).select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"))
    schema, out = "query bigint, k bigint, cosine double", None
    rows = queries.where(usable).select(F.col(key).cast("bigint"), vector).orderBy(key).toLocalIterator()
    while part := [r for _, r in zip(range(block), rows)]:
        ids = np.array([r[0] for r in part])
        q = vectors.sparkSession.sparkContext.broadcast((ids, of(np.array([r[1] for r in part], float))))

        def run(batches, q=q):
            ids, m = q.value
            for pdf in batches:
                if len(pdf):
                    c = of(np.stack(pdf.v.to_numpy()).astype(float)) @ m.T
                    k = np.repeat(pdf.k.to_numpy(), len(ids))
                    found = pd.DataFrame({"query": np.tile(ids, len(pdf)), "k": k, "cosine": c.ravel()})
                    yield found[found["query"] != found["k"]]

        each = base.mapInPandas(run, schema)
        out = each if out is None else out.unionByName(each)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    return out.select("query", F.col("k").alias(key), "cosine")
