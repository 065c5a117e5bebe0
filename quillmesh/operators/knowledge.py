"""What is known of names: generic and bare names, resolution in three tiers, the memory of a community, graduated rules.

A community is any label of documents, given as ``(doc, community)``; a document without one is of community ''. Records
are taken in the order of ``record_id``. Names are compared in lower case without outer blanks; NULL and blank names are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.alignments import canonical_name
from quillmesh.operators.entities import mentions, resolve
from quillmesh.session import materialize

# fixed values: terms too general to be an entity, and names that stand for another only in their document
GENERIC = ("federal agencies", "relevant stakeholders", "program agencies", "appropriate entities", "the committee", "the program")
BARE = (
    "secretary", "director", "chair", "chairman", "chairwoman",
    "speaker", "senator", "administrator", "commission", "committee",
    "department", "agency", "council", "board", "house",
    "officer", "bureau", "center", "office", "judge",
    "sponsor", "chief", "cochair", "partner", "agent",
    "the secretary", "the director", "the administrator",
    "the commission", "the department", "the committee",
    "the council", "the board", "the agency",
    "under secretary", "assistant secretary",
)
LISTS = ("organizations", "offices", "roles", "legislation_refs", "named_docs")


def low(c) -> Column:
    return F.lower(F.trim(c))


def is_generic(name: Column, resolved: Column) -> Column:
    """A general term or one of fewer than five characters, unless it is among the resolved phrases (an array)."""
    key = low(name)
    return F.when(F.array_contains(F.coalesce(resolved, F.array().cast("array<string>")), key), False).otherwise(key.isin(*GENERIC) | (F.length(key) < 5))


def is_bare(name: Column, phrases: Column) -> Column:
    """A listed bare name, or a phrase (of an array) that the document itself explains."""
    return low(name).isin(*BARE) | F.array_contains(F.coalesce(phrases, F.array().cast("array<string>")), low(name))


def valid_extraction(records: DataFrame, lists: tuple[str, ...] = LISTS) -> Column:
    """Whether all lists of a record are there; a column the table lacks is not."""
    ok = F.lit(True)
    for c in lists:
        ok = ok & (F.col(c).isNotNull() if c in records.columns else F.lit(False))
    return ok


def explained(records: DataFrame) -> DataFrame:
    """``(record_id, doc, phrase, meaning)`` of the disambiguations; of one phrase in a record the first by its spelling."""
    d = records.select("record_id", F.trim(F.coalesce("doc_id", F.lit(""))).alias("doc"), F.explode("disambiguation_updates").alias("raw", "meaning"))
    return d.groupBy("record_id", "doc", low("raw").alias("phrase")).agg(F.min_by("meaning", "raw").alias("meaning"))


def community_phrases(records: DataFrame, communities: DataFrame) -> DataFrame:
    """``(community, phrase, meaning)``: the first meaning given in each community; internal phrases are left out."""
    d = explained(records).join(communities, "doc").where(~F.col("phrase").contains("_in_sec_"))
    return d.groupBy("community", "phrase").agg(F.min_by("meaning", F.struct("record_id", "meaning")).alias("meaning"))


def review_queue(records: DataFrame, communities: DataFrame, phrases: DataFrame, terms: DataFrame, registry: DataFrame) -> DataFrame:
    """Bare names with the suggested canonical name and its source: the record's own explanation, the community's, the registry.

    A tier that explains the phrase but yields no name, or the bare name itself, leaves it to the next.
    """
    own = explained(records).select("record_id", "phrase", F.col("meaning").alias("own_meaning"))
    m = mentions(records).withColumn("phrase", low("name")).join(own, ["record_id", "phrase"], "left").where(low("name").isin(*BARE) | F.col("own_meaning").isNotNull())
    m = m.join(communities, "doc", "left").join(phrases.select("community", "phrase", F.col("meaning").alias("community_meaning")), ["community", "phrase"], "left")
    m = resolve(m, terms).join(registry.select("entity_id", F.col("canonical_name").alias("registered")), "entity_id", "left")
    name = lambda c: F.when(F.lower(c) != F.col("phrase"), c)
    tiers = {"doc": name(canonical_name(F.col("own_meaning"))), "community": name(canonical_name(F.col("community_meaning"))), "registry": name(F.col("registered"))}
    source = F.lit("unresolved")
    for tier, c in reversed(tiers.items()):
        source = F.when(c.isNotNull(), tier).otherwise(source)
    return m.select("record_id", "doc", "kind", "pos", "name", F.coalesce("community", F.lit("")).alias("community"), F.coalesce(*tiers.values()).alias("suggestion"), source.alias("source"))


def queue_stats(queue: DataFrame) -> DataFrame:
    """``(source, kind, n)`` with totals by source, by type and over all (NULL)."""
    return queue.cube("source", "kind").agg(F.count("*").alias("n"))


def roster(records: DataFrame, communities: DataFrame, terms: DataFrame, registry: DataFrame) -> DataFrame:
    """``(community, kind, name, n_mentions, first_seen)``: the entities of every community.

    A name enters when it is first met, unless the canonical name of its entry entered before; mentions of a name that
    never entered are not counted. A canonical name that itself means another entry follows the same rule once more.
    """
    m = mentions(records).join(communities, "doc", "left").withColumn("community", F.coalesce("community", F.lit(""))).withColumn("key", low("name"))
    order = F.struct("record_id", "pos")
    seen = m.groupBy("community", "kind", "key").agg(F.count("*").alias("n"), F.min(order).alias("since"), F.min_by("name", order).alias("name"), F.min_by("doc", order).alias("first_seen"))
    full = registry.select("entity_id", low("canonical_name").alias("full"))
    known = resolve(seen.withColumnRenamed("name", "shown").withColumn("name", F.col("key")), terms).join(full, "entity_id", "left").select("community", "kind", "key", "n", "since", "shown", "first_seen", "full")

    def entered(df: DataFrame, by: DataFrame) -> DataFrame:
        """Whether a name entered, given the names ``(community, kind, key, since)`` that did."""
        b = by.select("community", "kind", F.col("key").alias("full"), F.col("since").alias("full_since"))
        j = df.join(b, ["community", "kind", "full"], "left")
        blocked = (F.col("full") != F.col("key")) & (F.col("full_since") < F.col("since"))
        return j.where(~F.coalesce(blocked, F.lit(False))).drop("full_since")

    first = entered(known, known)
    return entered(known, first).select("community", "kind", F.col("shown").alias("name"), F.col("n").alias("n_mentions"), "first_seen")


def novel(records: DataFrame, roster_: DataFrame, communities: DataFrame, terms: DataFrame, registry: DataFrame) -> DataFrame:
    """Mentions neither whose name nor the canonical name of whose entry is in the roster of their community."""
    m = mentions(records).join(communities, "doc", "left").withColumn("community", F.coalesce("community", F.lit("")))
    m = resolve(m, terms).join(registry.select("entity_id", low("canonical_name").alias("full")), "entity_id", "left")
    have = materialize(roster_.select(F.col("community").alias("h_community"), F.col("kind").alias("h_kind"), low("name").alias("have")).distinct(), "roster")
    same = (F.col("community") == F.col("h_community")) & (F.col("kind") == F.col("h_kind"))
    for own in (low("name"), F.col("full")):
        m = m.join(have, same & (own == F.col("have")), "left_anti")
    return m.select("record_id", "doc", "community", "kind", "pos", "name")


def graduated(records: DataFrame, communities: DataFrame, terms: DataFrame, times: int = 5) -> DataFrame:
    """Rules of phrases that a community resolved to one name at least ``times`` times.

    The phrase itself must be unknown to the index and the name known; confidence is 0.6 + 0.05 a time, at most 0.95.
    """
    log = records.select(F.trim(F.coalesce("doc_id", F.lit(""))).alias("doc"), F.explode("disambiguation_updates").alias("raw", "resolved"))
    log = log.join(communities, "doc", "left").select(F.coalesce("community", F.lit("")).alias("community"), low("raw").alias("phrase"), "resolved")
    n = log.groupBy("community", "phrase", "resolved").agg(F.count("*").alias("n")).where(F.col("n") >= times)
    n = n.join(terms.select(F.col("term").alias("phrase")).distinct(), "phrase", "left_anti")
    best = terms.groupBy("term").agg(F.max_by("entity_id", F.struct("confidence", -F.col("ord"))).alias("entity_id"))
    n = n.join(best, low("resolved") == F.col("term"))
    return n.select("community", "phrase", "resolved", "entity_id", "n", F.least(F.lit(0.95), 0.6 + 0.05 * F.col("n")).alias("confidence"))


def probe_verdict(answer: Column, candidate: Column) -> Column:
    """True where the candidate leads the answer's list or is its only reading, NULL where others lead, false where it is
    missing. An answer that could not be had (NULL) does not block: true."""
    lines = F.filter(F.split(answer, "\n"), lambda x: F.lower(x).contains("confidence") & (F.trim(x) != ""))
    named = F.lower(answer).contains(F.lower(candidate))
    leads = (F.size(lines) <= 1) | F.lower(F.get(lines, F.lit(0))).contains(F.lower(candidate))
    return F.when(answer.isNull(), True).when(~named, False).when(leads, True)


def rule_overlap(a: Column, b: Column) -> Column:
    """Shared over united lower-case words of two rules; 0 where both are blank."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union > 0, F.size(F.array_intersect(words(a), words(b))) / union).otherwise(0.0)


def parsing_rules(rules: DataFrame, most: int = 7, overlap: float = 0.70) -> DataFrame:
    """``(community, ord, rule, state)`` of rules ``(community, ord, rule)`` folded in order: one that shares more than
    ``overlap`` of its words with an active one is dropped, or takes its place if longer; beyond ``most`` the oldest is archived.

    A community is folded as a sorted stream: at most ``most`` rules are held, however many there are.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        community, active = None, []
        for pdf in batches:
            out = []
            for c, o, rule in zip(pdf.community, pdf.ord, pdf.rule):
                if c != community:
                    out += [(community, *a[:2], "active") for a in active]
                    community, active = c, []
                words = set(rule.lower().split())
                near = next((i for i, a in enumerate(active) if words | a[2] and len(words & a[2]) / len(words | a[2]) > overlap), None)
                if near is None:
                    active.append((o, rule, words))
                    if len(active) > most:
                        out.append((community, *active.pop(0)[:2], "archived"))
                elif len(rule) > len(active[near][1]):
                    active[near] = (active[near][0], rule, words)
            yield pd.DataFrame(out, columns=["community", "ord", "rule", "state"])
        yield pd.DataFrame([(community, *a[:2], "active") for a in active], columns=["community", "ord", "rule", "state"])

    given = rules.where(F.trim(F.coalesce("rule", F.lit(""))) != "").select(F.coalesce("community", F.lit("")).alias("community"), F.col("ord").cast("bigint").alias("ord"), "rule")
    return given.repartition("community").sortWithinPartitions("community", "ord").mapInPandas(fold, "community string, ord bigint, rule string, state string")


def last_oddities(records: DataFrame, communities: DataFrame, n: int = 3) -> DataFrame:
    """``(community, k, oddity)``: the last ``n`` remarks of every community, the latest first."""
    o = records.where(F.trim(F.coalesce("oddity", F.lit(""))) != "").select(F.trim(F.coalesce("doc_id", F.lit(""))).alias("doc"), "record_id", "oddity")
    o = o.join(communities, "doc", "left").withColumn("community", F.coalesce("community", F.lit("")))
    w = Window.partitionBy("community").orderBy(F.desc("record_id"))
    return o.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("community", "k", "oddity")


def disambiguation_context(phrases: DataFrame, roster_: DataFrame, oddities: DataFrame, terms: DataFrame, registry: DataFrame, budget: int = 6000) -> DataFrame:
    """``(community, context, n_chars)``: what a model is told of a community, in four tiers within a budget of characters.

    1. its phrases, all or none; 2. entries of the registry in its roster, as many as fit; 3. its other names, the most
    mentioned first; 4. its latest remarks. A line takes at least three characters, so of every tier only ``budget / 3``
    lines can count: these are ranked before they are brought together.
    """
    r = resolve(roster_, terms).join(registry.select("entity_id", "canonical_name", "acronym", "entity_type"), "entity_id", "left")
    acronym = F.when(F.trim(F.coalesce("acronym", F.lit(""))) != "", F.concat(F.lit(" ("), "acronym", F.lit(")"))).otherwise("")
    known = r.where("canonical_name IS NOT NULL").select("community", F.lit(2).alias("tier"), F.concat("canonical_name", acronym, F.lit(" ["), F.regexp_replace(F.replace("entity_type", F.lit("_"), F.lit(" ")), "s+$", ""), F.lit("]")).alias("line"), F.lit(0).cast("bigint").alias("o")).distinct()
    other = r.where("canonical_name IS NULL").select("community", F.lit(3).alias("tier"), F.concat("name", F.lit(" ["), F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(", "), F.col("n_mentions").cast("string"), F.lit(" mentions]")).alias("line"), (-F.col("n_mentions")).alias("o"))
    first = phrases.select("community", F.lit(1).alias("tier"), F.concat(F.lit('"'), "phrase", F.lit('" = '), "meaning").alias("line"), F.lit(0).cast("bigint").alias("o"))
    last = oddities.select("community", F.lit(4).alias("tier"), F.col("oddity").alias("line"), (-F.col("k")).cast("bigint").alias("o"))
    lines = first.unionByName(known).unionByName(other).unionByName(last)
    w = Window.partitionBy("community", "tier").orderBy("o", "line")
    most = budget // 3
    kept = lines.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most + 1)
    per = kept.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("tier", "k", "line"))).alias("lines"))

    def write(lines: list) -> str:
        left, out = budget, []
        tier = {t: [x["line"] for x in lines if x["tier"] == t] for t in (1, 2, 3, 4)}
        if tier[1]:
            block = "Disambiguation rules: " + "; ".join(tier[1])
            if len(block) <= left:
                out.append(block)
                left -= len(block) + 1
        for t, head, least in ((2, "\nKnown entities (canonical):", 0), (3, "\nCommunity-specific entities:", 0), (4, "\nKnown oddities:", 80)):
            if tier[t] and left > least:
                out.append(head)
                left -= len(head) + 1
                for x in tier[t]:
                    if len(x) + 3 > left:
                        break
                    out.append(f"- {x}")
                    left -= len(x) + 3
        return "\n".join(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"community": pdf.community, "context": [write(x) for x in pdf.lines]})

    return per.mapInPandas(run, "community string, context string").withColumn("n_chars", F.length("context"))


def chunk_prompt(context: Column, name: Column, summary: Column, number: Column, total: Column, chunk: Column, known: Column) -> Column:
    """The text sent to a model for one chunk: context, document, names known so far (an array), the chunk."""
    names = F.when(F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Already found: "), F.array_join(known, "; ")))
    return F.concat_ws(
        "\n\n", F.nullif(context, F.lit("")), F.concat(F.lit("Document: "), name), F.concat(F.lit("Summary: "), F.nullif(summary, F.lit(""))),
        names, F.format_string("Chunk %d of %d:", number + 1, total), chunk,
    )


def parsed_json(answer: Column, schema: str = "map<string,string>") -> Column:
    """The JSON object of an answer, a code fence around it dropped; NULL for anything but an object."""
    t = F.trim(F.coalesce(answer, F.lit("")))
    t = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n[ \t]*```[ \t]*$", "")).otherwise(t)
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(t.startswith("{"), F.from_json(t, schema, {"mode": "PERMISSIVE"}))
