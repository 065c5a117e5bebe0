"""Profiles of people, groups and areas over the taxonomy; all in long form, a row a tag.

``tags`` are distinct ``(doc, tag)``; people are those of the cosponsor table; a group is any ``(grp, person)`` table.
Shares of nothing are 0. A tag is led by its group and a colon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import chamber_long, ratio
from quillmesh.operators.legislators import active, areas, bipartisanship, facts
from quillmesh.operators.taxonomy import group_of

MIN_DOCUMENTS = 5  # fixed value: groups with fewer documents are left out


def in_group(tags: DataFrame, group: str) -> DataFrame:
    return tags.where(group_of(F.col("tag")) == group)


def short_label(tag, group: str):
    """The tag without the name of its group."""
    return F.ltrim(F.trim(F.replace(tag, F.lit(group), F.lit(""))), F.lit(": "))


def binary_matrix(tags: DataFrame, group: str, labels: list[str]) -> DataFrame:
    """A row a document and a 0/1 column for each of a bounded list of short labels."""
    t = in_group(tags, group).select("doc", short_label(F.col("tag"), group).alias("label"), F.lit(1).alias("x"))
    return t.groupBy("doc").pivot("label", sorted(labels)).agg(F.max("x")).na.fill(0)


def tags_per_document(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """Mean, median and number of documents without any, over the documents of the catalogue."""
    n = documents.select("doc").distinct().join(tags.groupBy("doc").agg(F.count("*").alias("n")), "doc", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean_n"), F.percentile("n", F.lit(0.5)).alias("median_n"), F.count_if(F.col("n") == 0).alias("n_without"))


def person_profile(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """``(person, tag, n, share)``: tags by the cosponsor rows of their documents, and their share of the person's."""
    n = facts(rows).groupBy("doc", "person").agg(F.count("*").alias("k")).join(tags, "doc").groupBy("person", "tag").agg(F.sum("k").alias("n"))
    return n.withColumn("share", ratio(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("person"))))


def most_active_profiles(rows: DataFrame, profile: DataFrame, top: int = 30) -> DataFrame:
    """The profiles of the ``top`` people by documents; those without a tag have no row."""
    best = facts(rows).groupBy("person").agg(F.countDistinct("doc").alias("n_docs")).orderBy(F.desc("n_docs"), "person").limit(top)
    return profile.join(F.broadcast(best.select("person")), "person")


def _parties(rows: DataFrame) -> DataFrame:
    """``(person, party, full_name)`` of each person's first row."""
    return facts(rows).groupBy("person").agg(F.min_by(F.struct(F.trim(F.coalesce("party", F.lit(""))).alias("party"), "full_name"), "ord").alias("a")).select("person", "a.party", "a.full_name")


def party_tags(rows: DataFrame, tags: DataFrame, group: str) -> DataFrame:
    """``(party, tag, n, share)`` of one group by the parties of the people behind its documents."""
    p = person_profile(rows, in_group(tags, group)).join(_parties(rows), "person").where("party <> ''")
    n = p.groupBy("party", "tag").agg(F.sum("n").alias("n"))
    return n.withColumn("share", ratio(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("party"))))


def champions(rows: DataFrame, tags: DataFrame, group: str, top: int = 3) -> DataFrame:
    """``(tag, rank, person, party, n)``: the people with most documents of each tag."""
    p = person_profile(rows, in_group(tags, group))
    w = Window.partitionBy("tag").orderBy(F.desc("n"), "person")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(_parties(rows), "person").select("tag", "rank", "person", "party", "n")


def tag_coverage(tags: DataFrame, group: str) -> DataFrame:
    """Documents by tag of one group, the most covered first."""
    return in_group(tags, group).groupBy("tag").agg(F.count("*").alias("n_docs")).orderBy(F.desc("n_docs"), "tag")


def totals_with_parent(tags: DataFrame, group: str) -> DataFrame:
    """Documents by short label with the label above it: its group for one at the top."""
    label = short_label(F.col("tag"), group)
    parent = F.when(label.contains(": "), F.substring_index(label, ": ", 1)).otherwise(group)
    return in_group(tags, group).groupBy(label.alias("label"), parent.alias("parent")).agg(F.count("*").alias("n_docs"))


def top_labels(counts: DataFrame, group: str, least: int = 5, fallback: int = 15) -> DataFrame:
    """``(tag)``: the tags of ``(tag, n)`` at the top of their group; if fewer than ``least``, the ``fallback`` largest."""
    top = counts.where(~short_label(F.col("tag"), group).contains(": ")).select("tag")
    largest = counts.orderBy(F.desc("n"), "tag").limit(fallback).select("tag")
    n = top.agg(F.count("*").alias("n_top"))
    several = top.join(F.broadcast(n), F.col("n_top") >= least).select("tag")
    return several.unionByName(largest.join(F.broadcast(n), F.col("n_top") < least).select("tag"))


def group_documents(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``(grp, doc)``: the documents of each group's people."""
    return facts(rows).select("doc", "person").distinct().join(groups, "person").select("grp", "doc").distinct()


def group_tags(groups: DataFrame, rows: DataFrame, tags: DataFrame, group: str, documents: DataFrame | None = None) -> DataFrame:
    """``(grp, tag, n, share)`` of the groups with at least ``MIN_DOCUMENTS`` documents; ``documents`` ``(doc)`` restricts them."""
    d = group_documents(groups, rows)
    if documents is not None:
        d = d.join(documents.select("doc").distinct(), "doc", "left_semi")
    large = d.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_DOCUMENTS).select("grp")
    n = d.join(large, "grp", "left_semi").join(in_group(tags, group), "doc").groupBy("grp", "tag").agg(F.count("*").alias("n"))
    return n.withColumn("share", ratio(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("grp"))))


def group_profile(groups: DataFrame, rows: DataFrame, documents: DataFrame, top: int = 3) -> DataFrame:
    """Size, shares of the parties in per cent of all listed members, chambers, states and the top areas as ``name (n)``."""
    size = groups.groupBy("grp").agg(F.count("*").alias("size"))
    first = facts(rows).groupBy("person").agg(F.min_by(F.struct("full_name", "party", "state"), "ord").alias("a")).select("person", "a.*")
    m = groups.join(first, "person").withColumn("chamber", chamber_long(F.col("full_name")))
    mix = m.groupBy("grp").agg(
        F.count_if(F.col("party") == "D").alias("n_d"), F.count_if(F.col("party") == "R").alias("n_r"), F.count_if(F.col("chamber") == "Senate").alias("senate"),
        F.count_if(F.col("chamber") == "House").alias("house"), F.countDistinct(F.nullif(F.trim("state"), F.lit(""))).alias("n_states"),
    )
    f = facts(rows).join(groups, "person").join(areas(documents), "doc").where("area IS NOT NULL").groupBy("grp", "area").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp").orderBy(F.desc("n"), "area")
    best = f.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).withColumn("s", F.format_string("%s (%d)", "area", "n"))
    named = best.groupBy("grp").agg(*[F.coalesce(F.max(F.when(F.col("k") == i + 1, F.col("s"))), F.lit("")).alias(f"top_{i + 1}") for i in range(top)])
    pct = lambda c: F.round(100.0 * F.coalesce(c, F.lit(0)) / F.col("size"), 1)
    out = size.join(mix, "grp", "left").join(named, "grp", "left")
    return out.select("grp", "size", pct(F.col("n_d")).alias("d_pct"), pct(F.col("n_r")).alias("r_pct"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("senate", "house", "n_states")], *[F.coalesce(f"top_{i + 1}", F.lit("")).alias(f"top_{i + 1}") for i in range(top)])


def top_area_rows(counts: DataFrame, by: str = "area", n: int = 10) -> DataFrame:
    """The rows of ``(…, area, n)`` whose area is among the ``n`` largest by total."""
    best = counts.groupBy(by).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), by).limit(n)
    return counts.join(F.broadcast(best), by)


def bipartisanship_by_area(rows: DataFrame, documents: DataFrame, top: int = 10) -> DataFrame:
    """Quartiles of the index in the ``top`` areas by documents; a document without an area counts as Unknown."""
    b = bipartisanship(rows).join(areas(documents), "doc", "left").withColumn("area", F.coalesce("area", F.lit("Unknown")))
    best = b.groupBy("area").agg(F.count("*").alias("n_docs")).orderBy(F.desc("n_docs"), "area").limit(top)
    q = lambda p: F.percentile("index", F.lit(p))
    return b.join(F.broadcast(best.select("area")), "area").groupBy("area").agg(F.count("*").alias("n_docs"), q(0.25).alias("low"), q(0.5).alias("median"), q(0.75).alias("high"))


def area_networks(rows: DataFrame, documents: DataFrame, min_rows: int = 3, min_nodes: int = 2) -> DataFrame:
    """``(area, n_rows, n_nodes, n_edges)``: people linked by a common document of the area; small areas are left out.

    Pairs of one document are counted before they are kept: at most people squared rows an area.
    """
    f = facts(active(rows)).join(areas(documents), "doc").where("area IS NOT NULL").select("area", "doc", "person")
    n = f.groupBy("area").agg(F.count("*").alias("n_rows"), F.countDistinct("person").alias("n_nodes"))
    d = f.distinct()
    pairs = d.toDF("area", "doc", "a").join(d.toDF("area", "doc", "b"), ["area", "doc"]).where("a < b").select("area", "a", "b").distinct()
    e = pairs.groupBy("area").agg(F.count("*").alias("n_edges"))
    kept = n.where((F.col("n_rows") >= min_rows) & (F.col("n_nodes") >= min_nodes))
    return kept.join(e, "area", "left").select("area", "n_rows", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def playbook(tags: DataFrame, left: str, right: str, min_left: int = 5, more_than: int = 3) -> DataFrame:
    """Pairs of tags of two groups with more than ``more_than`` documents, of left tags with at least ``min_left``."""
    a = in_group(tags, left)
    frequent = a.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= min_left).select("tag")
    a = a.join(frequent, "tag", "left_semi").select("doc", F.col("tag").alias("src"))
    b = in_group(tags, right).select("doc", F.col("tag").alias("dst"))
    return a.join(b, "doc").groupBy("src", "dst").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > more_than)


def word_resolutions(phrases: DataFrame, word: str) -> DataFrame:
    """How often a word is explained, and in how many ways, over ``(community, phrase, meaning)``."""
    return phrases.where(F.col("phrase") == word.lower().strip()).agg(F.count("*").alias("n_communities"), F.countDistinct("meaning").alias("n_meanings"))


def bare_and_full(names: DataFrame, word: str) -> DataFrame:
    """Of ``(doc, name)`` the documents with the bare word and those with each longer name that holds it, most first."""
    key = F.lower(F.trim("name"))
    held = names.where(key.contains(word.lower())).select("doc", key.alias("name"), (key == word.lower()).alias("bare"))
    return held.groupBy("name", "bare").agg(F.countDistinct("doc").alias("n_docs")).orderBy(F.desc("n_docs"), "name")
