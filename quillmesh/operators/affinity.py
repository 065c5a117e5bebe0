"""Similarity of documents from tags, words and vectors, and the communities of documents it makes.

1. Catalogue rows of one link are one group; its first row stands for it, with the tags of all members.
2. Two groups are compared by 0.50 x Jaccard of their tags + 0.25 x cosine of their TF-IDF words + 0.20 x dot of their
   vectors. A sum above 0.25 needs a common tag or a common word; pairs are met in blocks (``blocks``).
3. Louvain on the similarities; communities of more than 80 groups are split again; members of a group follow the
   row that stands for it.

Whole graphs of similar documents grow with the square of a tag's documents: ``combined_similarity`` can take a stated query
set against all rows; ``document_communities`` has all pairs, which it streams to its kernel once they are many.

Defined results: a document without tags and words is a community of its own; NULL and blank ids are left out; of
repeated deliveries of a document the first counts; groups without common tags and words have no similarity row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.blocks import packed, similar_pairs
from quillmesh.operators.networks import weighed_communities
from quillmesh.operators.orphans import id_number
from quillmesh.session import materialize

# fixed values: weights of the signals, least similarity, resolution, size and resolution of the second pass
WEIGHTS = {"tags": 0.50, "words": 0.25, "vectors": 0.20}
THRESHOLD = 0.25
RESOLUTION, LARGE, FINER = 1.5, 80, 2.5


def link_members(documents: DataFrame) -> DataFrame:
    """``(doc, rep, ord)``: the first delivery of every document and the document that stands for its link's group."""
    first = documents.select(id_number(F.col("doc_id")).alias("doc"), "ord", F.trim(F.coalesce("link", F.lit(""))).alias("link")).where("doc IS NOT NULL")
    first = first.groupBy("doc").agg(F.min("ord").alias("ord"), F.min_by("link", "ord").alias("link"))
    linked = first.where("link <> ''").groupBy("link").agg(F.min_by("doc", "ord").alias("rep"))
    return first.join(linked, "link", "left").select("doc", F.coalesce("rep", "doc").alias("rep"), "ord")


def profile_words(documents: DataFrame, members: DataFrame) -> DataFrame:
    """``(rep, token, weight)``: TF-IDF of summaries and tags of the rows that stand for a group, of unit length."""
    from quillmesh.operators.taxonomy import tfidf

    profile = F.concat_ws(" ", *[F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in ("short_summary", "long_summary", "tags")])
    texts = documents.select("ord", profile.alias("profile")).join(members.where("doc = rep"), "ord").select("rep", "profile")
    w = tfidf(texts, "rep", "profile").where("weight > 0").select("rep", "token", "weight")
    norm = w.groupBy("rep").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return w.join(norm, "rep").select("rep", "token", (F.col("weight") / F.col("norm")).alias("weight"))


def profile_tags(tags: DataFrame, members: DataFrame) -> DataFrame:
    """``(rep, tag)``: the tags ``(doc, tag)`` of all members of a group."""
    return tags.select("doc", "tag").join(members.select("doc", "rep"), "doc").select("rep", "tag").distinct()


def combined_similarity(tags: DataFrame, words: DataFrame, vectors: DataFrame | None = None, queries: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(src, dst, similarity)`` above the threshold: all pairs ``src < dst``, or with ``queries`` ``(rep)`` these against all.

    ``vectors`` are ``(rep, vector)`` of unit length.
    """
    # without the vectors' share a pair may still be this far below
    least = threshold if vectors is None else threshold - WEIGHTS["vectors"]
    asked = None if queries is None else queries.select(F.col("rep").cast("bigint").alias("id"))
    total = similar_pairs(packed(tags.select("rep", "tag"), words.select("rep", "token", "weight")), least, WEIGHTS["tags"], WEIGHTS["words"], asked)
    if vectors is not None:
        v = vectors.select("rep", F.col("vector").cast("array<double>").alias("v"))
        dot = F.aggregate(F.zip_with("v_src", "v_dst", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        total = total.join(v.toDF("src", "v_src"), "src", "left").join(v.toDF("dst", "v_dst"), "dst", "left")
        total = total.select("src", "dst", (F.col("similarity") + F.coalesce(WEIGHTS["vectors"] * dot, F.lit(0.0))).alias("similarity"))
    return total.where(F.col("similarity") > threshold)


def document_communities(documents: DataFrame, tags: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """``(doc, rep, community, size, centrality)`` of every document; communities are numbered from the largest.

    ``centrality`` is the similarity to the groups of the community over their number less one, 1 for a group alone.
    """
    members = materialize(link_members(documents), "members")
    edges = combined_similarity(profile_tags(tags, members), profile_words(documents, members), vectors)
    edges = materialize(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("similarity").alias("weight")), "similarity")
    sizes = members.groupBy(F.col("rep").cast("string").alias("node")).agg(F.count("*").alias("mass"))
    found = weighed_communities(edges, "louvain", RESOLUTION, most=LARGE, finer=FINER)
    home = materialize(sizes.join(found, "node", "left").select("node", F.coalesce("community", "node").alias("c"), "mass", "inside"), "homes")
    whole = home.groupBy("c").agg(F.count("*").alias("n_groups"), F.sum("mass").alias("size"), F.min(F.col("node").cast("bigint")).alias("least"))
    # one row a community: numbered in one task
    named = whole.withColumn("no", F.row_number().over(Window.orderBy(F.desc("size"), "least")))
    named = named.withColumn("community", F.concat(F.lit("community:"), F.when(F.col("no") < 1000, F.lpad(F.col("no").cast("string"), 3, "0")).otherwise(F.col("no").cast("string"))))
    central = F.when(F.col("n_groups") == 1, 1.0).otherwise(F.coalesce("inside", F.lit(0.0)) / (F.col("n_groups") - 1))
    by_rep = home.join(named, "c").select(F.col("node").cast("bigint").alias("rep"), "community", "size", F.round(central, 4).alias("centrality"))
    return members.join(by_rep, "rep").select("doc", "rep", "community", "size", "centrality")


def community_labels(members: DataFrame, tags: DataFrame, rows: DataFrame) -> DataFrame:
    """``(community, size, label, signature, dominant_party)`` of ``(doc, community)``.

    The label has the three most frequent tags, 'General' where there is none; the signature those of at least 0.4 of the
    members; the party is the most frequent among the rows of sponsors, of equal ones the first seen.
    """
    from quillmesh.operators.legislators import facts
    from quillmesh.operators.taxonomy import signature

    size = members.groupBy("community").agg(F.count("*").alias("size"))
    tagged = members.join(tags.select("doc", "tag").distinct(), "doc").select(F.col("community").alias("grp"), F.col("doc").alias("member"), "tag")
    signed = signature(tagged, sizes=size.select(F.col("community").alias("grp"), "size"))
    party = F.trim(F.coalesce("party", F.lit("")))
    counts = facts(rows).where(party != "").join(members.select("doc", "community"), "doc").groupBy("community", party.alias("p")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    best = counts.groupBy("community").agg(F.max_by("p", F.struct("n", -F.col("first_ord"))).alias("p"))
    out = size.join(signed.drop("size"), F.col("community") == F.col("grp"), "left").join(best, "community", "left")
    return out.select("community", "size", F.coalesce("label", F.lit("General")).alias("label"), F.coalesce("signature", F.array().cast("array<string>")).alias("signature"), F.coalesce("p", F.lit("")).alias("dominant_party"))


def communities_document(members: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``(community_id, record)`` a community: its record as JSON, members sorted as text."""
    m = members.groupBy("community").agg(
        F.array_sort(F.collect_list(F.col("doc").cast("string"))).alias("member_ids"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("doc").cast("string"), "centrality")))).alias("doc_centrality"),
    )
    r = labels.join(m, "community").select(F.col("community").alias("community_id"), "label", F.col("signature").alias("taxonomy_signature"), "dominant_party", "member_ids", "doc_centrality")
    return r.select("community_id", F.to_json(F.struct(*r.columns)).alias("record"))
