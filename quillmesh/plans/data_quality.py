"""Queries p6 and p7 over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.operators.orphans import catalogue_states, orphan_counts, orphan_rows, references
from quillmesh.operators.packed import reference_names, split_packed
from quillmesh.sources.tables import table


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    names = reference_names(table(spark, sf, "collections"), table(spark, sf, "taxonomy"))
    return split_packed(table(spark, sf, "documents_raw"), "ord", ["collections", "tags"], names)


def _refs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    refs = references({n: table(spark, sf, n) for n in ("segments_raw", "cosponsor_rows")})
    return refs, catalogue_states(table(spark, sf, "documents_raw"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_rows(*_refs(spark, sf)).withColumnRenamed("period", "load_month")


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_counts(*_refs(spark, sf)).withColumnRenamed("period", "load_month")


QUERIES = {"p6_found": p6_found, "p7_found": p7_found, "p7_counts": p7_counts}

_NUMBER = r"TRY_CAST(regexp_extract(regexp_replace(doc_id, '^\s+|\s+$', '', 'g'), '^([+-]?[0-9]+)(\.0*)?$', 1) AS BIGINT)"
_ORPHANS = f"""
WITH states AS (SELECT {_NUMBER} AS k, min(loaded_at) AS first_at, min(deleted_at) AS gone_at
                FROM documents_raw GROUP BY 1),
refs AS (SELECT 'segments_raw' AS table_name, ord, {_NUMBER} AS k, loaded_at FROM segments_raw
         UNION ALL SELECT 'cosponsor_rows', ord, {_NUMBER}, loaded_at FROM cosponsor_rows),
found AS (SELECT table_name, ord, refs.k AS k, strftime(loaded_at, '%Y-%m') AS load_month,
          CASE WHEN states.k IS NULL THEN 'missing' WHEN gone_at <= loaded_at THEN 'deleted'
               WHEN first_at > loaded_at THEN 'late' END AS kind
          FROM refs LEFT JOIN states ON refs.k = states.k WHERE refs.k IS NOT NULL)
"""

SQL = {
    "p7_found": _ORPHANS + "SELECT table_name, ord, kind, load_month FROM found WHERE kind IS NOT NULL",
    "p7_counts": _ORPHANS
    + "SELECT table_name, load_month, kind, count(*) AS n_rows, count(DISTINCT k) AS n_keys "
    + "FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
