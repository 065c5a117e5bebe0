"""Operators that cross the tables: summaries of sponsors, alignment of tags, parties and entities, groups of one link,
registry seeding and review, extraction folds, text scans with the registry."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import ratio, split_list, strip
from quillmesh.operators.entities import mentions, registry_terms
from quillmesh.operators.legislators import areas, facts, party_mode
from quillmesh.operators.orphans import id_number
from quillmesh.operators.taxonomy import group_of, segment_tags


def sponsor_bills(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``(person, doc, area)``: the bills of every person, a row each; '' without an area."""
    f = facts(rows).select("person", "doc").distinct().join(areas(documents), "doc", "left")
    return f.select("person", "doc", F.coalesce("area", F.lit("")).alias("area"))


def sponsor_summary(rows: DataFrame, documents: DataFrame, top: int = 3) -> DataFrame:
    """Per person the number of bills and the ``top`` areas with counts; the bills themselves are ``sponsor_bills``."""
    f = sponsor_bills(rows, documents)
    bills = f.groupBy("person").agg(F.count("*").alias("n_bills"))
    counts = f.where("area <> ''").groupBy("person", "area").agg(F.count("*").alias("n"))
    w = Window.partitionBy("person").orderBy(F.desc("n"), "area")
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    named = best.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("rank", F.format_string("%s (%d)", "area", "n").alias("s")))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["s"]), "; ")
    return bills.join(named, "person", "left").select("person", "n_bills", F.coalesce(joined, F.lit("")).alias("top_areas"))


def tag_party_alignment(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the documents with a tag the share of every dominant party."""
    docs = segment_tags(segments).where("doc IS NOT NULL").select("doc", "tag").distinct()
    n = docs.join(party_mode(rows).select("doc", "party"), "doc").groupBy("tag", "party").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("tag")))


def _named(records: DataFrame) -> DataFrame:
    return mentions(records).select(id_number(F.col("doc")).alias("doc"), "kind", F.lower(F.trim("name")).alias("name")).where("doc IS NOT NULL").distinct()


def entity_tags(records: DataFrame, segments: DataFrame, group: str, least: int = 1) -> DataFrame:
    """Entities with the tags of one group by documents with both."""
    tags = segment_tags(segments).where(group_of(F.col("tag")) == group).select("doc", "tag").distinct()
    return _named(records).join(tags, "doc").groupBy("kind", "name", "tag").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def role_domains(records: DataFrame, segments: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent tags of the documents of every role."""
    n = entity_tags(records.withColumn("organizations", F.lit(None).cast(records.schema["organizations"].dataType)), segments, "strategies").where("kind = 'roles'")
    w = Window.partitionBy("name").orderBy(F.desc("n_docs"), "tag")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("name", "rank", "tag", "n_docs")


def entity_parties(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Entities by documents of either dominant party; ``skewed`` where one side has at least 10 and the other under a tenth."""
    p = _named(records).join(party_mode(rows).select("doc", "party"), "doc")
    c = p.groupBy("kind", "name").agg(F.count_if(F.col("party") == "D").alias("n_d"), F.count_if(F.col("party") == "R").alias("n_r"))
    most, total = F.greatest("n_d", "n_r"), F.col("n_d") + F.col("n_r")
    return c.withColumn("skewed", (most >= 10) & (ratio(F.least("n_d", "n_r"), total) < 0.1))


def person_entities(rows: DataFrame, records: DataFrame, least: int = 2) -> DataFrame:
    """Organizations of the documents a person co-sponsored."""
    orgs = _named(records).where("kind = 'organizations'").select("doc", "name")
    return facts(rows).select("doc", "person").distinct().join(orgs, "doc").groupBy("person", "name").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def link_groups(documents: DataFrame) -> DataFrame:
    """Catalogue rows of one link: the first is canonical, blank links stand alone; distinct tags of a group counted."""
    linked = documents.select(F.trim(F.coalesce("link", F.lit(""))).alias("link"), "ord", "tags").where("link <> ''")
    g = linked.groupBy("link").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_rows")).where("n_rows > 1")
    tags = linked.join(g.select("link"), "link", "left_semi").select("link", F.explode(split_list(F.col("tags"))).alias("t")).distinct()
    return g.join(tags.groupBy("link").agg(F.count("*").cast("int").alias("n_tags")), "link", "left").select("link", "first_ord", "n_rows", F.coalesce("n_tags", F.lit(0)).alias("n_tags"))


def link_group_tags(documents: DataFrame) -> DataFrame:
    """``(link, tag)``: the tags of a group of several rows, united."""
    linked = documents.select(F.trim(F.coalesce("link", F.lit(""))).alias("link"), "tags").where("link <> ''")
    several = linked.groupBy("link").agg(F.count("*").alias("n")).where("n > 1").select("link")
    return linked.join(several, "link", "left_semi").select("link", F.explode(split_list(F.col("tags"))).alias("tag")).distinct()


def department_histogram(names: DataFrame, name: str, keywords: list[str]) -> DataFrame:
    """Names by the first keyword they hold, else Other."""
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit("Other")
    for k in reversed(keywords):
        out = F.when(low.contains(k), k).otherwise(out)
    return names.groupBy(out.alias("keyword")).agg(F.count("*").alias("n"))


# fixed values: names an analyst seeds the registry with
SEEDS = {"Office of Management": "OOM", "National Records Council": "NRC"}


def seed_registry(dictionary: DataFrame, annotations: DataFrame) -> DataFrame:
    """Registry entries of the stages constants (1.0), dictionary (0.9), annotations (1.0): later stages add aliases and,
    if at least as sure, take over name and type."""
    spark = dictionary.sparkSession
    constants = spark.createDataFrame([(f"org:{re.sub('[^a-z0-9]+', '_', n.lower())}", n, "organizations", a) for n, a in SEEDS.items()], "entity_id string, name string, kind string, acronym string")
    stages = [constants.withColumn("confidence", F.lit(1.0)), dictionary.withColumn("confidence", F.lit(0.9)), annotations.withColumn("confidence", F.lit(1.0))]
    rows = None
    for i, s in enumerate(stages):
        s = s.select("entity_id", "name", "kind", "acronym", "confidence").withColumn("stage", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    order = F.struct("confidence", "stage", "name")
    return rows.groupBy("entity_id").agg(
        F.max_by("name", order).alias("canonical_name"), F.max_by("kind", order).alias("entity_type"), F.max("confidence").alias("confidence"),
        F.min_by(F.nullif(F.trim("acronym"), F.lit("")), F.when(F.trim(F.coalesce("acronym", F.lit(""))) != "", F.struct("stage", "acronym"))).alias("acronym"),
        F.size(F.collect_set("name")).alias("n_names"),
    )


def accept_canonical(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """Records with the organization names of the review's accepted rows ``(doc_id, name, canonical)`` replaced."""
    per_doc = accepted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.lower(F.trim("name")), "canonical"))).alias("m"))
    rename = F.transform("organizations", lambda e: e.withField("name", F.coalesce(F.element_at("m", F.lower(F.trim(e["name"]))), e["name"])))
    return records.join(per_doc, "doc_id", "left").withColumn("organizations", F.when(F.col("m").isNull(), F.col("organizations")).otherwise(rename)).drop("m")


def dismiss(queue: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return queue.join(done.select(*keys).distinct(), keys, "left_anti")


def merged_records(records: DataFrame) -> DataFrame:
    """The mentions of all records of a document merged: one per kind and lower-case name, the first kept.

    A name that the document's disambiguations list as a phrase gives way to a longer name of its kind that holds it;
    other names stay, whatever holds them.
    """
    m = mentions(records).withColumn("low", F.lower(F.trim("name")))
    first = m.groupBy("doc", "kind", "low").agg(F.min_by("name", F.struct("record_id", "pos")).alias("name"), F.count("*").alias("n"))
    phrases = records.select(F.trim("doc_id").alias("doc"), F.explode(F.map_keys("disambiguation_updates")).alias("low"))
    phrases = phrases.select("doc", F.lower(F.trim("low")).alias("low")).distinct()
    bare = first.join(phrases, ["doc", "low"], "left_semi").select(F.col("doc").alias("d"), F.col("kind").alias("k"), F.col("low").alias("short"))
    held = bare.join(first, (F.col("d") == F.col("doc")) & (F.col("k") == F.col("kind")) & (F.col("short") != F.col("low")) & F.col("low").contains(F.col("short")))
    held = held.select(F.col("d").alias("doc"), F.col("k").alias("kind"), F.col("short").alias("low")).distinct()
    return first.join(held, ["doc", "kind", "low"], "left_anti").select("doc", "kind", "name", "n")


def budgeted_context(lines: DataFrame, group: str, line: str, order: str, budget: int = 6000) -> DataFrame:
    """The first lines of every group whose lengths, with line ends, stay within the budget; it stops at the first too many.

    As a line takes a character at least, only the first ``budget`` of a group can count: they are ranked, which drops the
    others before the shuffle, and only then summed.
    """
    w = Window.partitionBy(group).orderBy(order, line)
    first = lines.withColumn("k", F.row_number().over(w)).where(F.col("k") <= budget)
    run = first.withColumn("length", F.sum(F.length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("length") <= budget)
    return run.groupBy(group).agg(F.count("*").alias("n_lines"), F.max("length").alias("n_chars"))


class Extractor(Protocol):
    """A model that reads one text; replace the dictionary scan below by any such object."""

    def __call__(self, text: str) -> list[tuple[str, int, int]]: ...


class TermScan:
    """Finds known terms as whole words, the longest first, in any case; the first place of each entity."""

    def __init__(self, terms: dict[str, str]) -> None:
        self.terms = terms
        self.engine = None

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        import ahocorasick

        if self.engine is None:
            self.engine = ahocorasick.Automaton()
            for t, e in self.terms.items():
                self.engine.add_word(t, (t, e))
            self.engine.make_automaton()
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits = []
        for end, (t, e) in self.engine.iter(low):
            s = end - len(t) + 1
            if not (s and (low[s - 1].isalnum() or low[s - 1] == "_")) and not (low[end + 1 : end + 2].isalnum() or low[end + 1 : end + 2] == "_"):
                hits.append((s, -(end + 1), e))
        out, seen, last = [], set(), 0
        for s, e, entity in sorted(hits):
            if s >= last:
                last = -e
                if entity not in seen:
                    seen.add(entity)
                    out.append((entity, s, -e))
        return out

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "engine": None}


def extract(texts: DataFrame, key: str, text: str, extractor: Extractor) -> DataFrame:
    """``(key, entity_id, char_start, char_end)`` of what the extractor finds."""
    sent = texts.sparkSession.sparkContext.broadcast(extractor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *x) for k, t in zip(pdf.k, pdf.t) if t for x in sent.value(t)], columns=["k", "entity_id", "char_start", "char_end"])

    out = texts.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInPandas(run, "k bigint, entity_id string, char_start bigint, char_end bigint")
    return out.withColumnRenamed("k", key)


def pre_resolve(texts: DataFrame, key: str, text: str, registry: DataFrame, at_most: int = 100_000) -> DataFrame:
    """Entries of a (small, checked) registry named in each text, at their first place."""
    named = F.lower(F.trim("canonical_name")) == F.col("term")
    short = F.lower(F.trim(F.coalesce("acronym", F.lit("")))) == F.col("term")
    terms = registry_terms(registry).join(registry.select("entity_id", "canonical_name", "acronym"), "entity_id").where(named | short & (F.length("term") >= 2) | (F.length("term") >= 3))
    rows = terms.groupBy("term").agg(F.max_by("entity_id", F.struct("confidence", -F.col("ord"))).alias("e")).limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} registry terms")
    return extract(texts, key, text, TermScan({r.term: r.e for r in rows}))


# fixed values: how a remark that names no entity begins; what may lead a name, in this order; where a name ends, in this
# order; beginnings that are no name
SKIPPED = ["not referenced", "already established", "defined in subsection", "defined in sec"]
PREAMBLES = [
    r"Explicitly\s+defined\s+as\s+", r"Extracted\s+in\s+context\s+of\s+", r"Resolved\s+to\s+", r"Confirmed\s+as\s+",
    r"Identified\s+as\s+", r"Refers\s+to\s+(the\s+)?",
]
BOUNDARIES = [
    " per SEC", " per Section", " per subsection", " per document", " per context", " per explicit", " per (",
    " in SEC.", " in context of", " in this section",
    " inferred from", " based on context", " based on jurisdiction",
    " as the ", " as established", " as explicitly",
    " (context-dependent)", " (standard ", " (distinct from",
    " (established ", " (defined ", " (per ",
    " (inferred ", " (consistent ",
    " — ", " – ", " - confirmed", " - inferred",
    "; ", " already established",
    ", appointed by", ", acting through",
    " with specific authorit", " responsible for",
    " under the ", " under this ",
]
NO_NAME = ["enforcement", "authority", "role ", "refers ", "confirmed ", "explicitly ", "identified ", "not ", "received ", "receives "]
QUOTED = r"""^.*?['"].*?['"].*?\brefers\s+to\s+(.+)"""
QUOTES = r"'\"‘’“”"
NOISE = r"\s*\(used\s+\d+\s+times.*?\)\s*$"
EITHER = r"[A-Z][a-z]+(?:\s+[A-Za-z]+)*\s+or\s+[A-Z][a-z]+"


def canonical_name(c: Column) -> Column:
    """The name of the entity that a remark such as 'Confirmed as the X Board per SEC. 4' means; NULL if it names none,
    two, or something that is no name. A NULL or blank remark gives NULL."""
    text = strip(F.coalesce(c, F.lit("")))
    low = F.lower(text)
    skipped = text == ""
    for p in SKIPPED:
        skipped = skipped | low.startswith(p)
    bare = text
    for p in PREAMBLES:
        bare = F.regexp_replace(bare, "(?iU)^" + p, "")
    quoted = text.rlike("(?idU)" + QUOTED)
    named = F.when(quoted, strip(F.regexp_extract(text, "(?idU)" + QUOTED, 1))).otherwise(bare)
    named = F.regexp_replace(named, f"^[{QUOTES}]+", "")
    cut = lambda t, b: F.when(F.position(F.lower(b), F.lower(t)) > 1, F.substring(t, F.lit(1), F.position(F.lower(b), F.lower(t)) - 1)).otherwise(t)
    named = F.aggregate(F.array(*[F.lit(b) for b in BOUNDARIES]), named, cut)
    named = F.regexp_replace(named, "(?idU)" + NOISE, "")
    named = strip(F.regexp_replace(named, rf"(?U)[{QUOTES},.\-\s]+$", ""))
    good = ~skipped & ~named.rlike("(?U)" + EITHER) & (F.length(named) >= 4) & named.rlike(r"\p{Lu}")
    for p in NO_NAME:
        good = good & ~F.lower(named).startswith(p)
    return F.when(good, named)


def fingerprints(rows: DataFrame, segments: DataFrame, least: int = 3, every: int = 1) -> DataFrame:
    """``(src, dst, cosine)`` of people with at least ``least`` kinds of tags, above the median cosine of all such pairs.

    As the median is over all pairs, the work is that of all pairs; ``every`` takes as queries (``src``) the people whose
    hash it divides, against all people.
    """
    tags = segment_tags(segments).where("doc IS NOT NULL").select("doc", F.col("tag")).distinct()
    v = facts(rows).select("doc", "person").distinct().join(tags, "doc").groupBy("person", group_of(F.col("tag")).alias("dim")).agg(F.count("*").cast("double").alias("x"))
    kept = v.groupBy("person").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.count("*").alias("n")).where(F.col("n") >= least)
    u = v.join(kept, "person").select("person", "dim", (F.col("x") / F.col("norm")).alias("x"))
    queries = u.where(F.pmod(F.xxhash64("person"), F.lit(every)) == 0).toDF("src", "dim", "xs")
    pairs = queries.join(u.toDF("dst", "dim", "xd"), "dim").where("src < dst" if every == 1 else "src <> dst").groupBy("src", "dst").agg(F.sum(F.col("xs") * F.col("xd")).alias("cosine"))
    middle = pairs.agg(F.percentile("cosine", F.lit(0.5)).alias("m"))
    return pairs.join(F.broadcast(middle), F.col("cosine") > F.col("m")).drop("m")


def principal_components(features: DataFrame, key: str, columns: list[str], k: int = 2) -> DataFrame:
    """Standardised features on their first ``k`` principal components."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=columns, outputCol="raw").transform(features)
    v = StandardScaler(inputCol="raw", outputCol="z", withMean=True).fit(v).transform(v)
    p = PCA(k=k, inputCol="z", outputCol="pc").fit(v).transform(v)
    return p.select(key, *[vector_to_array("pc")[i].alias(f"pc{i + 1}") for i in range(k)])


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by the hash of key and seed: the same for any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def list_items(text: Column) -> Column:
    """Items of 'the prefix A, B and C': and / or count as commas, the words before the last of the first item go before each."""
    head = F.split(F.regexp_replace(F.trim(text), r"\s+(?:and|or)\s+", ", "), r"\s*,\s*")
    words = F.split(head[0], " ")
    prefix = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.transform(F.filter(head, lambda x: x != ""), lambda x, i: F.when((i > 0) & (prefix != ""), F.concat(prefix, F.lit(" "), x)).otherwise(x))
