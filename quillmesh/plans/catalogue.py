"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.plans import crossings, data_quality, graphs, memories, records, tables

_MODULES = [data_quality, graphs, records, crossings, tables, memories]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["neighborhood_both"](spark, sf)
