"""Sponsors, cosponsors and the statistics of who works with whom.

Rows are those of a cosponsor table: doc_id, person_id, full_name, party, state, district, is_withdrawn ... A blank
person or document is skipped (and counted where the reference counts it); repeated (document, person) rows are one fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import chamber, chamber_long, clean_district, last_first, ratio
from quillmesh.operators.orphans import id_number
from quillmesh.session import materialize

PART = 2048

def facts(rows: DataFrame) -> DataFrame:
    """Rows with document number and person, blanks dropped."""
    person = F.trim(F.coalesce("person_id", F.lit("")))
    return rows.withColumn("doc", id_number(F.col("doc_id"))).withColumn("person", person).where((F.col("doc").isNotNull()) & (F.col("person") != ""))


def active(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("is_withdrawn", F.lit(False)))


def person_nodes(rows: DataFrame, keep: str = "first") -> DataFrame:
    """One row per person with the attributes of the ``first`` (sponsors) or ``last`` (cosponsors) row."""
    pick = F.min_by if keep == "first" else F.max_by
    attributes = F.struct("full_name", "party", "state", "district")
    last, first = last_first(F.col("a.full_name"))
    return (
        facts(rows)
        .groupBy("person")
        .agg(pick(attributes, F.col("ord")).alias("a"))
        .select(
            F.concat(F.lit("sponsor:"), F.col("person")).alias("node_id"),
            F.trim(F.coalesce("a.full_name", F.lit(""))).alias("full_name"),
            last.alias("last_name"),
            first.alias("first_name"),
            F.trim(F.coalesce("a.party", F.lit(""))).alias("party"),
            F.trim(F.coalesce("a.state", F.lit(""))).alias("state"),
            clean_district(F.col("a.district")).alias("district"),
            chamber(F.trim(F.coalesce("a.full_name", F.lit("")))).alias("chamber"),
        )
    )


def sponsorship_edges(rows: DataFrame, relation: str) -> DataFrame:
    return facts(rows).select(
        F.concat(F.lit("document:"), F.col("doc").cast("string")).alias("src_id"), F.lit(relation).alias("relation"), F.concat(F.lit("sponsor:"), "person").alias("dst_id")
    )


def shares_counts(rows: DataFrame) -> DataFrame:
    """Per person the documents and the document pairs that share the person, without writing the pairs out."""
    return (
        facts(rows)
        .groupBy("person")
        .agg(F.countDistinct("doc").alias("n_docs"))
        .where("n_docs > 1")
        .withColumn("n_pairs", (F.col("n_docs") * (F.col("n_docs") - 1) / 2).cast("bigint"))
    )


def shares_edges(rows: DataFrame, relation: str, distinct_pairs: bool = False) -> DataFrame:
    """Document pairs that share a person, in row order. As many as a person's documents squared.

    The documents of a person are hashed into parts of about ``PART``, and every document meets every part, so the pairs of
    one person are made by many tasks. Partitions are counted by parts, as such rows are few bytes and many pairs.
    """
    f = facts(rows)
    f = f.groupBy("doc", "person").agg(F.min("ord").alias("ord")) if distinct_pairs else f.select("doc", "person", "ord")
    f = materialize(f.select(F.concat(F.lit("document:"), F.col("doc").cast("string")).alias("id"), "person", "ord"), "shared")
    n = f.groupBy("person").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    n = materialize(n, "parts")
    tasks = min(2000, max(1, n.agg(F.sum("parts")).first()[0] or 1))
    r = f.join(n, "person")
    a = r.select("person", F.col("id").alias("src_id"), F.col("ord").alias("ord_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = r.select("person", F.col("id").alias("dst_id"), F.col("ord").alias("ord_b"), F.pmod(F.xxhash64("id", "ord"), "parts").cast("int").alias("part"))
    a, b = (x.repartition(tasks, "person", "part") for x in (a, b))
    return a.join(b.hint("shuffle_hash"), ["person", "part"]).where("ord_a < ord_b").select("src_id", F.lit(relation).alias("relation"), "dst_id", "person")


def layer_stats(rows: DataFrame) -> DataFrame:
    """Rows, documents, persons, facts and skipped rows in one row."""
    doc, person = id_number(F.col("doc_id")), F.trim(F.coalesce("person_id", F.lit("")))
    ok = doc.isNotNull() & (person != "")
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(doc.isNotNull() & (person == "")).alias("skipped_no_person"),
        F.countDistinct(F.when(ok, doc)).alias("n_docs"),
        F.countDistinct(F.when(ok, person)).alias("n_persons"),
        F.count_if(ok).alias("n_edges"),
    )


def areas(documents: DataFrame) -> DataFrame:
    """``(doc, area)``: the authority of a document's first delivery; a blank one is NULL."""
    area = F.when(F.trim(F.coalesce("authority", F.lit(""))) != "", F.trim("authority"))
    first = documents.select(id_number(F.col("doc_id")).alias("doc"), "ord", area.alias("area")).where("doc IS NOT NULL")
    return first.groupBy("doc").agg(F.min_by("area", "ord").alias("area"))


def breadth_depth(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Per person: documents, areas, first known attributes."""
    f = facts(rows).join(areas(documents), "doc", "left")
    known = lambda c: F.min_by(F.when(F.trim(c) != "", F.trim(c)), F.when(F.trim(c) != "", F.col("ord"))).alias(c)
    return f.groupBy("person").agg(F.countDistinct("doc").alias("n_docs"), F.countDistinct("area").alias("n_areas"), known("full_name"), known("party"), known("state"))


def top_people(breadth: DataFrame, n: int = 10, specialists: bool = False) -> DataFrame:
    """The broadest people, or the most active of those with at most two areas."""
    if specialists:
        return breadth.where("n_areas <= 2").orderBy(F.desc("n_docs"), "person").limit(n)
    return breadth.orderBy(F.desc("n_areas"), F.desc("n_docs"), "person").limit(n)


def chamber_pivot(rows: DataFrame) -> DataFrame:
    c = facts(rows).withColumn("chamber", chamber_long(F.col("full_name")))
    counts = c.groupBy("doc").pivot("chamber", ["House", "Senate", "Unknown"]).count()
    return counts.na.fill(0).select("doc", F.col("House").alias("house"), F.col("Senate").alias("senate"), F.col("Unknown").alias("unknown"))


def chamber_areas(rows: DataFrame, documents: DataFrame) -> DataFrame:
    f = facts(rows).join(areas(documents), "doc").where("area IS NOT NULL")
    return f.groupBy(chamber_long(F.col("full_name")).alias("chamber"), "area").agg(F.count("*").alias("n"))


def _bipartisan(d: Column, r: Column) -> Column:
    return ratio(F.least(d, r), d + r)


def bipartisanship(rows: DataFrame) -> DataFrame:
    """Per document the active cosponsors of either party and min / (D + R); other parties do not count."""
    party = F.upper(F.trim("party"))
    c = active(facts(rows)).groupBy("doc").agg(F.count_if(party == "D").alias("n_d"), F.count_if(party == "R").alias("n_r"), F.count("*").alias("n_all"))
    return c.withColumn("index", _bipartisan(F.col("n_d"), F.col("n_r")))


def bipartisanship_summary(by_doc: DataFrame) -> DataFrame:
    return by_doc.agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("index") > 0.45).alias("n_balanced"),
        F.count_if(F.col("index") == 0).alias("n_partisan"),
        F.percentile("index", F.lit(0.5)).alias("median_index"),
    )


def integration(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Per area: people, people active in several areas, their share. A document without an area is an area of its own."""
    f = facts(rows).join(areas(documents), "doc", "left").select("person", F.coalesce("area", F.lit("∅")).alias("area")).distinct()
    breadth = f.groupBy("person").agg(F.count("*").alias("n_areas"))
    return (
        f.where("area <> '∅'")
        .join(breadth, "person")
        .groupBy("area")
        .agg(F.count("*").alias("n_people"), F.count_if(F.col("n_areas") > 1).alias("n_multi"), F.sum("n_areas").alias("sum_areas"))
        .withColumn("share_multi", F.col("n_multi") / F.col("n_people"))
    )


def person_pairs(rows: DataFrame, min_shared: int = 2) -> DataFrame:
    """``(src, dst, weight)``: people by shared documents. At most people squared rows, counted before they are kept."""
    f = facts(rows).select("doc", "person").distinct()
    a, b = f.toDF("doc", "src"), f.toDF("doc", "dst")
    return a.join(b, "doc").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_shared)


def area_pairs(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: areas by shared people."""
    f = facts(rows).join(areas(documents), "doc").where("area IS NOT NULL").select("person", "area").distinct()
    a, b = f.toDF("person", "src"), f.toDF("person", "dst")
    return a.join(b, "person").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def cross_party(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """Pairs of people of different known parties."""
    p = people.select(F.expr("substring(node_id, 9)").alias("person"), "party").where("party <> ''")
    a, b = p.toDF("src", "party_src"), p.toDF("dst", "party_dst")
    return pairs.join(a, "src").join(b, "dst").where("party_src <> party_dst").select("src", "dst", "weight", "party_src", "party_dst")


def degrees(pairs: DataFrame) -> DataFrame:
    """Degree, weighted degree and degree centrality of an undirected edge table."""
    ends = pairs.select(F.col("src").alias("node"), "weight").unionByName(pairs.select(F.col("dst").alias("node"), "weight"))
    d = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))
    n = d.agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n)).select("node", "degree", "weighted_degree", ratio(F.col("degree"), F.col("n") - 1).alias("degree_centrality"))


def clustering(pairs: DataFrame) -> DataFrame:
    """Clustering coefficient by counting triangles along degree-ordered edges."""
    deg = degrees(pairs).select("node", "degree")
    e = pairs.select("src", "dst").join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
    swap = (F.col("ds") > F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") > F.col("dst")))
    o = e.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("lo"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("hi"))
    x, y = o.toDF("a", "b"), o.toDF("a", "c")
    wedges = x.join(y, "a").where("b <> c")
    triangles = wedges.join(o.toDF("b", "c"), ["b", "c"])
    corners = triangles.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    return deg.join(corners, "node", "left").select("node", "degree", t.alias("triangles"), ratio(2.0 * t, F.col("degree") * (F.col("degree") - 1)).alias("clustering"))


def cross_ratio(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """Of every person with a cross-party tie the share of such ties."""
    total = degrees(pairs).select("node", "degree")
    crossing = degrees(cross_party(pairs, people).select("src", "dst", "weight")).select("node", F.col("degree").alias("cross_degree"))
    return crossing.join(total, "node").select("node", "degree", "cross_degree", (F.col("cross_degree") / F.greatest("degree", F.lit(1))).alias("cross_ratio"))


def party_mode(rows: DataFrame) -> DataFrame:
    """Per document the most frequent party; ties go to the one seen first."""
    c = facts(rows).where(F.trim(F.coalesce("party", F.lit(""))) != "").groupBy("doc", F.trim("party").alias("party")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return c.groupBy("doc").agg(F.max_by(F.struct("party", "n"), F.struct("n", -F.col("first_ord"))).alias("m")).select("doc", "m.party", "m.n")


def ranked_areas(rows: DataFrame, documents: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most frequent areas of every party."""
    c = facts(rows).join(areas(documents), "doc").where("area IS NOT NULL AND trim(party) <> ''").groupBy(F.trim("party").alias("party"), "area").agg(F.count("*").alias("n"))
    w = Window.partitionBy("party").orderBy(F.desc("n"), "area")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
