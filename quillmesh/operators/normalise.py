"""Raw rows brought to typed tables: documents, segments, people, lookup tables and the links between them.

A raw column that is absent counts as blank, NULL as ''. Ids are read as whole numbers; a row whose id is none is skipped,
as is a row that refers to a document outside the catalogue. ``skipped`` counts them by reason. Columns beyond those read
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.truth import sync_optional
from quillmesh.operators.entities import mentions
from quillmesh.operators.orphans import id_number

# fixed values: groups of taxonomy labels
GROUPS = ("Applications:", "Harms:", "Incentives:", "Risk factors:", "Strategies:")


def raw(df: DataFrame, name: str) -> Column:
    """A raw column as text without NULL; '' where the table has none of that name."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def taxonomy_columns(names: list[str]) -> list[str]:
    """The columns that are flags of the taxonomy, in order: those led by the name of a group."""
    return sorted(n for n in names if n.startswith(GROUPS))


def colon_columns(names: list[str], skip: set[str] = frozenset()) -> list[str]:
    """The columns with a colon in their name but for those to skip, in the order of the table."""
    return [n for n in names if ":" in n and n not in skip]


def plain_columns(names: list[str]) -> list[str]:
    """The columns that are no flags of the taxonomy."""
    flags = set(taxonomy_columns(names))
    return [n for n in names if n not in flags]


def flags_to_tags(columns: list[str], flag=lambda c: F.lower(F.trim(c)) == "true") -> Column:
    """The names of the flag columns that are set, as an array in the order given."""
    each = [F.when(flag(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit(c)) for c in columns]
    return F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<string>")


def tags_to_flags(df: DataFrame, tags: str, columns: list[str]) -> DataFrame:
    """A column ``True`` or '' for every tag of a bounded list."""
    held = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    return df.select("*", *[F.when(F.array_contains(held, c), "True").otherwise("").alias(c) for c in columns])


def lookup(df: DataFrame, name: str, key: str) -> DataFrame:
    """``(name, id)``; of rows of one name the last."""
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("look_name")).agg(F.max(key).alias("look_id"))


def authorities(df: DataFrame) -> DataFrame:
    return df.select("ord", *[raw(df, c).alias(c) for c in ("name", "jurisdiction", "parent_authority")])


def collections(df: DataFrame) -> DataFrame:
    return df.select("ord", raw(df, "name").alias("name"), raw(df, "description").alias("description"))


def documents(df: DataFrame, authority_rows: DataFrame) -> DataFrame:
    """Typed catalogue rows with the id of their authority (NULL where the lookup has none of that name)."""
    text = ("official_name", "casual_name", "link", "activity", "activity_date", "proposed_date", "short_summary", "long_summary", "tags")
    more = ("plaintext_retrieved", "plaintext_source", "pdf_source", "pdf_retrieved")
    flags = ("annotated", "validated", "applies_government", "applies_private", "plaintext_unavailable")
    found = taxonomy_columns(df.columns)
    n = raw(df, "n_segments").try_cast("int")
    out = df.select(
        F.col("ord"), id_number(F.col("doc_id")).alias("doc_id"), raw(df, "authority").alias("authority_name"), raw(df, "collections").alias("collections_raw"),
        *[raw(df, c).alias(c) for c in (*text, *more)], *[sync_optional(raw(df, c)).alias(c) for c in flags],
        F.when(n != 0, n).alias("n_segments"), flags_to_tags(found).alias("taxonomy_tags"),
    ).where("doc_id IS NOT NULL")
    return out.join(lookup(authority_rows, "name", "ord"), F.col("authority_name") == F.col("look_name"), "left").drop("look_name").withColumnRenamed("look_id", "authority_id")


def _known(df: DataFrame, documents_: DataFrame, reason: Column) -> DataFrame:
    """With ``doc`` and ``skip``, the reason why a row is left out or NULL."""
    ids = documents_.select(id_number(F.col("doc_id").cast("string")).alias("known_id")).where("known_id IS NOT NULL").distinct()
    d = df.withColumn("doc", id_number(F.col("doc_id")))
    d = d.join(ids, F.col("doc") == F.col("known_id"), "left")
    missing = F.when(F.col("doc").isNull(), "no document id").when(F.col("known_id").isNull(), "unknown document")
    return d.withColumn("skip", F.coalesce(missing, reason)).drop("known_id")


def _segments(df: DataFrame, documents_: DataFrame) -> DataFrame:
    return _known(df, documents_, F.when(F.trim(raw(df, "position")) == "", "no position"))


def segments(df: DataFrame, documents_: DataFrame) -> DataFrame:
    s = _segments(df, documents_).where("skip IS NULL")
    flags = ("non_operative", "not_relevant", "annotated", "validated")
    return s.select(
        "ord", F.col("doc").alias("document_id"), raw(s, "position").try_cast("double").cast("int").alias("segment_position"), *[raw(s, c).alias(c) for c in ("text", "tags", "summary")],
        *[sync_optional(raw(s, c)).alias(c) for c in flags],
        F.coalesce(F.col("taxonomy_tags"), F.array().cast("array<string>")).alias("taxonomy_tags") if "taxonomy_tags" in s.columns else flags_to_tags(taxonomy_columns(s.columns)).alias("taxonomy_tags"),
    )


def _people(df: DataFrame, documents_: DataFrame) -> DataFrame:
    return _known(df, documents_, F.when(F.trim(raw(df, "person_id")) == "", "no person"))


def cosponsors(df: DataFrame, documents_: DataFrame) -> DataFrame:
    """Blank dates are NULL, flags are true only where they say so."""
    c = _people(df, documents_).where("skip IS NULL")
    date = lambda n: F.nullif(F.trim(raw(c, n)), F.lit("")).try_cast("date").alias(n)
    return c.select(
        "ord", F.col("doc").alias("document_id"), F.trim(raw(c, "person_id")).alias("person_id"), *[raw(c, n).alias(n) for n in ("full_name", "party", "state", "district")],
        date("sponsorship_date"), (F.lower(raw(c, "is_original")) == "true").alias("is_original"), date("withdrawn_date"), (F.lower(raw(c, "is_withdrawn")) == "true").alias("is_withdrawn"),
    )


def sponsors(df: DataFrame, documents_: DataFrame, people_json: str = "people_json") -> DataFrame:
    """Counts are 0 where blank; a list of people that is no JSON is NULL."""
    s = _known(df, documents_, F.lit(None).cast("string")).where("skip IS NULL")
    count = lambda n: F.coalesce(raw(s, n).try_cast("int"), F.lit(0)).alias(n)
    parsed = F.from_json(raw(s, people_json), "array<map<string,string>>")
    return s.select("ord", F.col("doc").alias("document_id"), *[raw(s, n).alias(n) for n in ("party", "policy_area", "latest_action")], count("n_cosponsors"), count("n_current"), F.when(F.trim(raw(s, people_json)) != "", parsed).alias("people"))


def skipped(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``(table_name, reason, n)`` of the rows left out; tables are named ``segments`` or ``cosponsors``."""
    out = None
    for name, (df, docs) in tables.items():
        marked = {"segments": _segments, "cosponsors": _people}[name](df, docs)
        each = marked.where("skip IS NOT NULL").groupBy(F.col("skip").alias("reason")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "reason", "n")
        out = each if out is None else out.unionByName(each)
    return out


def document_collections(docs: DataFrame, collection_rows: DataFrame) -> DataFrame:
    """``(doc_id, collection_id)`` of the packed collections of normalised documents; names outside the list are dropped."""
    each = docs.select("doc_id", F.explode(F.split("collections_raw", ";")).alias("c")).select("doc_id", F.trim("c").alias("c"))
    return each.join(lookup(collection_rows, "name", "ord"), F.col("c") == F.col("look_name")).select("doc_id", F.col("look_id").alias("collection_id"))


def catalogue_rows(docs: DataFrame) -> DataFrame:
    """Normalised documents under the names of the catalogue file, numbers and flags as text, NULL as ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    flag = lambda c: F.when(F.col(c), "True").otherwise("").alias(c)
    names = ("official_name", "casual_name", "link", "activity", "activity_date", "proposed_date", "short_summary", "long_summary", "tags")
    return docs.select("ord", text("doc_id"), *[text(c) for c in names], F.col("authority_name").alias("authority"), F.col("collections_raw").alias("collections"), flag("applies_government"), flag("applies_private"))


def entity_mentions(records: DataFrame, registry_map: DataFrame) -> DataFrame:
    """``(doc, entity_id, kind, record_id, pos, char_start, context, k)``: mentions by kind and name of the lookup, numbered
    within document and entity; those without an entry drop out."""
    m = mentions(records).withColumn("name_key", F.lower(F.trim("name"))).join(registry_map, ["kind", "name_key"])
    w = Window.partitionBy("doc", "entity_id").orderBy("record_id", "pos", "kind")
    return m.select("doc", "entity_id", "kind", "record_id", "pos", "char_start", "context", F.row_number().over(w).alias("k"))


def mention_counts(mentions_: DataFrame) -> DataFrame:
    return mentions_.groupBy("doc", "entity_id").agg(F.count("*").alias("n"))


def coverage_shares(df: DataFrame, fields: list[str]) -> DataFrame:
    """The share of rows with a value in each field; NULL of an empty table."""
    return df.agg(*[(F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "") / F.count("*")).alias(c) for c in fields])


def typed_lookup(registry: DataFrame) -> DataFrame:
    """``(kind, name_key, entity_id)`` of the canonical names; of one kind and name the last entry."""
    key = F.lower(F.trim("canonical_name"))
    return registry.where(key != "").groupBy(F.col("entity_type").alias("kind"), key.alias("name_key")).agg(F.max_by("entity_id", "ord").alias("entity_id"))


def primary_else(primary: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """All primary rows and those of the other table whose key the primary lacks."""
    return primary.unionByName(other.join(primary.select(*keys).distinct(), keys, "left_anti"))
