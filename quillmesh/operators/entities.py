"""Entities: registry index and resolution, dictionary, review, evaluation, chunk merging, confidence, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.ids import entity_id
from quillmesh.functions.text import plain_name, ratio, strip

LISTS = ("organizations", "offices", "roles")


def mentions(records: DataFrame) -> DataFrame:
    """``(record_id, doc, kind, pos, name, context, char_start, char_end)`` of all entity lists; blank names dropped."""
    out = None
    for kind in LISTS:
        field = "title" if kind == "roles" else "name"
        part = records.select("record_id", F.trim("doc_id").alias("doc"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "e")).select(
            "record_id", "doc", "kind", "pos", F.col(f"e.{field}").alias("name"), "e.context", "e.char_start", "e.char_end"
        )
        out = part if out is None else out.unionByName(part)
    return out.where(F.trim(F.coalesce("name", F.lit(""))) != "")


def coverage(records: DataFrame) -> DataFrame:
    """Per kind: unique lower-case names, mentions, documents."""
    return mentions(records).groupBy("kind").agg(
        F.countDistinct(F.lower(F.trim("name"))).alias("n_names"), F.count("*").alias("n_mentions"), F.countDistinct("doc").alias("n_docs")
    )


def token_usage(records: DataFrame) -> DataFrame:
    return records.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("chunks_processed").alias("chunks"))


def registry_terms(registry: DataFrame) -> DataFrame:
    """``(term, entity_id, entity_type, confidence, ord)``: lower-case name, acronym and aliases of every entry."""
    terms = F.concat(F.array("canonical_name", "acronym"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        registry.select("ord", "entity_id", "entity_type", "confidence", F.explode(terms).alias("t"))
        .withColumn("term", F.lower(F.trim(F.coalesce("t", F.lit("")))))
        .where("term <> ''")
        .groupBy("term", "entity_id")
        .agg(F.first("entity_type").alias("entity_type"), F.first("confidence").alias("confidence"), F.min("ord").alias("ord"))
    )


def resolve(names: DataFrame, terms: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """Names with the entry of their term: one of the kind first, then the most confident, then the first registered."""
    t = F.lower(F.trim(name))
    order = F.struct((F.col("entity_type") == F.col(kind)).cast("int"), "confidence", -F.col("t_ord"))
    wanted = names.select(name, kind).distinct()
    index = terms.withColumnRenamed("ord", "t_ord")
    best = wanted.join(index, t == F.col("term")).groupBy(name, kind).agg(F.max_by("entity_id", order).alias("entity_id"))
    return names.join(best, [name, kind], "left")


def registry_stats(registry: DataFrame) -> DataFrame:
    return registry.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("acronym", F.lit(""))) != "").alias("n_acronyms"), F.sum(F.size(F.coalesce("aliases", F.array().cast("array<string>")))).cast("bigint").alias("n_aliases"))


def dictionary(records: DataFrame) -> DataFrame:
    """Entries by slug id: first name, mentions, documents seen in."""
    m = mentions(records).withColumn("entity_id", entity_id(F.col("name"), F.col("kind")))
    return m.groupBy("entity_id").agg(
        F.min_by("name", F.struct("record_id", "pos")).alias("canonical_name"), F.first("kind").alias("entity_type"), F.count("*").alias("mention_count"), F.countDistinct("doc").alias("n_seen_in")
    )


def merge_entries(entries: DataFrame, keep: str, drop: str) -> DataFrame:
    """A dictionary with entry ``drop`` merged into ``keep``: aliases united without the kept name, mentions added."""
    both = entries.where(F.col("entity_id").isin(keep, drop)).withColumn("kept", F.col("entity_id") == keep)
    name = F.max_by("canonical_name", "kept")
    aliases = F.array_union(F.flatten(F.collect_list("aliases")), F.collect_list(F.when(~F.col("kept"), F.col("canonical_name"))))
    one = both.agg(F.lit(keep).alias("entity_id"), name.alias("canonical_name"), F.array_sort(F.array_except(aliases, F.array(name))).alias("aliases"), F.sum("mention_count").alias("mention_count"))
    rest = entries.where(~F.col("entity_id").isin(keep, drop)).select("entity_id", "canonical_name", "aliases", "mention_count")
    return rest.unionByName(one)


def term_map(registry: DataFrame) -> DataFrame:
    """Every name, alias and acronym with its entry; the later entry wins."""
    return registry_terms(registry).groupBy("term").agg(F.max_by("entity_id", "ord").alias("entity_id"))


def add_rules(rules: DataFrame) -> DataFrame:
    """Of rules of one pattern and scope the most confident, then the first."""
    w = Window.partitionBy("pattern", "scope").orderBy(F.desc("confidence"), "ord")
    return rules.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def bare_aliases(records: DataFrame, registry: DataFrame, generic: list[str]) -> DataFrame:
    """Mentions by a generic word alone, with the registry's suggestion if it has one."""
    m = mentions(records).where(F.lower(F.trim("name")).isin(*generic))
    return resolve(m.select("doc", "kind", "name"), registry_terms(registry)).groupBy("kind", "name", "entity_id").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"))


# fixed value: names shorter than this are less sure
SHORT_NAME = 8


def confidence(known: Column, in_memory: Column, acronym: Column, name: Column, conflict: Column) -> Column:
    """0.5, +0.3 in the registry, +0.1 in memory, +0.1 with acronym, -0.2 for a short name, -0.3 for a type conflict; in [0, 1]."""
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    score = 0.5 + add(known, 0.3) + add(in_memory, 0.1) + add(acronym, 0.1) - add(F.length(strip(name)) < SHORT_NAME, 0.2) - add(conflict, 0.3)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def scored(records: DataFrame, registry: DataFrame, roster: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Mentions with their entry, confidence and, under 0.5, the reasons.

    ``roster`` has the ``(kind, name)`` in memory; a name is in memory if it or the name of its entry is there. An entry of
    the index counts whatever its type; only ``rules`` ``(pattern, entity_id)`` are bound to one, so a type conflict is a
    name that the rules alone know, under another type.
    """
    low = lambda c: F.lower(F.trim(c))
    m = mentions(records).select("record_id", "kind", "pos", "name")
    entries = registry.select("entity_id", low("canonical_name").alias("full"), (F.trim(F.coalesce("acronym", F.lit(""))) != "").alias("has"), F.col("entity_type").alias("type"))
    r = resolve(m, registry_terms(registry)).join(entries, "entity_id", "left")
    if rules is not None:
        by_rule = rules.select(low("pattern").alias("phrase"), F.col("entity_id").alias("rule_id")).join(
            entries.toDF("rule_id", "rule_full", "rule_has", "rule_type"), "rule_id"
        )
        first = by_rule.groupBy("phrase").agg(*[F.max_by(c, "rule_id").alias(c) for c in ("rule_id", "rule_full", "rule_has", "rule_type")])
        r = r.join(first, low("name") == F.col("phrase"), "left")
        fits = F.col("entity_id").isNull() & (F.col("rule_type") == F.col("kind"))
        conflict = F.coalesce(F.col("entity_id").isNull() & (F.col("rule_type") != F.col("kind")), F.lit(False))
        r = r.withColumn("conflict", conflict).withColumns(
            {c: F.when(fits, F.col(f"rule_{x}")).otherwise(F.col(c)) for c, x in (("entity_id", "id"), ("full", "full"), ("has", "has"))}
        )
    else:
        r = r.withColumn("conflict", F.lit(False))
    known = roster.select("kind", low("name").alias("k")).where("k <> ''").distinct()
    r = r.join(known.select("kind", F.col("k").alias("own"), F.lit(True).alias("by_own")), (r["kind"] == known["kind"]) & (low("name") == F.col("own")), "left").drop(known["kind"])
    r = r.join(known.select(F.col("kind").alias("kind_f"), F.col("k").alias("k_full"), F.lit(True).alias("by_full")), (F.col("kind") == F.col("kind_f")) & (F.col("full") == F.col("k_full")), "left")
    in_memory = F.coalesce("by_own", "by_full", F.lit(False))
    found = F.col("entity_id").isNotNull()
    score = confidence(found, in_memory, F.coalesce("has", F.lit(False)), F.col("name"), F.col("conflict"))
    reasons = F.concat_ws(", ", F.when(F.length(strip(F.col("name"))) < SHORT_NAME, "short_name"), F.when(F.col("conflict"), "type_conflict"), F.when(~found, "not_in_registry"))
    reason = F.when(score < 0.5, F.when(reasons == "", "low_base_score").otherwise(reasons))
    return r.select("record_id", "kind", "pos", "name", "entity_id", score.alias("confidence"), reason.alias("reason"))


def evaluate_exact(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 per kind; both sides ``(doc, kind, name)``, compared as sets of plain names."""
    side = lambda df, s: df.select("doc", "kind", plain_name(F.col("name")).alias("n")).where("n <> ''").distinct().withColumn(s, F.lit(1))
    j = side(predicted, "p").join(side(gold, "g"), ["doc", "kind", "n"], "full")
    c = j.groupBy("kind").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("kind", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def memory(records: DataFrame) -> DataFrame:
    """Disambiguations folded over the records in order: the first value of a phrase wins; how often it was given."""
    d = records.select("record_id", F.explode("disambiguation_updates").alias("phrase", "meaning"))
    d = d.where(~F.col("phrase").contains("_in_sec_")).withColumn("phrase", F.lower(F.trim("phrase")))
    return d.groupBy("phrase").agg(F.min_by("meaning", F.struct("record_id", "meaning")).alias("meaning"), F.count("*").alias("n_given"), F.countDistinct("meaning").alias("n_meanings"))


def graduates(records: DataFrame, times: int = 5) -> DataFrame:
    """Phrases resolved to one meaning at least ``times`` times, with the confidence of the rule they become."""
    d = records.select(F.explode("disambiguation_updates").alias("phrase", "meaning"))
    n = d.groupBy(F.lower(F.trim("phrase")).alias("phrase"), F.trim("meaning").alias("meaning")).agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= times).withColumn("confidence", F.least(F.lit(0.95), 0.6 + 0.05 * F.col("n")))


# fixed values: what opens a section and a sub-section, with the blank lines before it
SECTION = r"(?dimU)^([\s\x1c-\x1f]*SEC(?:TION)?\.?[\s\x1c-\x1f]+\d+[A-Z]?\.)"
SUBSECTION = r"(?dmU)^([\s\x1c-\x1f]*\([a-z]\))"
_MARK = "\uffff\ufffe\uffff"  # noncharacters, which no text holds


def sections(texts: DataFrame, key: str, text: str, limit: int = 6000) -> DataFrame:
    """``(key, chunk, text)``: a text within the limit whole; others cut before the lines that open a section.

    A part beyond the limit is packed from its sub-sections ``(a)``, one of which may itself exceed the limit; a part
    without sub-sections, or with one at its very start only, is cut at the limit. Parts are stripped, blank ones dropped.
    """

    def cut(part: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(part) - 1) / limit)), lambda i: strip(F.substring(part, i * limit + 1, F.lit(limit))))

    def pack(part: Column) -> Column:
        subs = F.split(F.regexp_replace(part, SUBSECTION, _MARK + "$1"), _MARK)
        subs = F.filter(subs, lambda s: s != "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
        full = lambda acc, s: (F.length(acc["open"]) + F.length(s) > limit) & (acc["open"] != "")
        folded = F.aggregate(
            subs,
            start,
            lambda acc, s: F.when(full(acc, s), F.struct(F.concat(acc["done"], F.array(strip(acc["open"]))).alias("done"), s.alias("open"))).otherwise(
                F.struct(acc["done"].alias("done"), F.concat(acc["open"], s).alias("open"))
            ),
            lambda acc: F.concat(acc["done"], F.array(strip(acc["open"]))),
        )
        return F.when(F.size(subs) < 2, cut(part)).otherwise(folded)

    whole = F.col(text)
    opened = F.split(F.regexp_replace(whole, SECTION, _MARK + "$1"), _MARK)
    parts = F.filter(F.transform(opened, strip), lambda p: p != "")
    several = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > limit, pack(p)).otherwise(F.array(p))))
    long = F.when(F.size(opened) > 1, several).otherwise(pack(whole))
    chunks = F.when(F.length(whole) <= limit, F.array(whole)).otherwise(F.filter(long, lambda c: c != ""))
    return texts.where(F.length(text) > 0).select(key, F.posexplode(chunks).alias("chunk", "text"))


def soft_aliases(texts: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Whole-word occurrences of ``phrase`` in any case, with offsets from 0 and 20 characters of context on each side."""
    import re

    found = F.split(F.col(text), rf"(?i)(?<!\w){re.escape(phrase)}(?!\w)", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(found) - 1), lambda i: F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, p: s + F.length(p)) + (i - 1) * len(phrase))
    hits = texts.where(F.size(found) > 1).select(key, text, F.explode(ends).alias("char_start"))
    start = F.greatest(F.col("char_start") - 20, F.lit(0))
    return hits.select(key, "char_start", (F.col("char_start") + len(phrase)).alias("char_end"), F.substring(F.col(text), start + 1, F.col("char_start") + len(phrase) + 20 - start).alias("context"))


def untagged(spans: DataFrame, tagged: DataFrame, key: str) -> DataFrame:
    """Spans that overlap no tagged span (half-open)."""
    t = tagged.select(F.col(key).alias("t_key"), F.col("char_start").alias("t_start"), F.col("char_end").alias("t_end"))
    return spans.join(t, (F.col(key) == F.col("t_key")) & (F.col("char_start") < F.col("t_end")) & (F.col("char_end") > F.col("t_start")), "left_anti")


def greedy_spans(spans: Column) -> Column:
    """Of an array of (start, end) structs in order the ones that do not overlap the last one kept."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    keep = lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["end"]), F.concat(acc, F.array(s))).otherwise(acc)
    return F.aggregate(F.array_sort(spans), none, keep)
