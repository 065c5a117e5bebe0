"""Pairs of the rows that carry one key, a hot key spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def same_key_pairs(rows: DataFrame, key: str, row: str, block: int | None = None) -> DataFrame:
    """``(row_a, row_b)``, ``row_a < row_b``, of all rows of one key.

    The rows of a key are hashed into blocks of about ``block`` (``BLOCK``); every row meets every block, so no task has more than
    the rows of a key times ``block`` pairs. Keys of one row are left out before anything is copied; NULL is no key.
    """
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    r = rows.select(key, row).join(n, key).withColumn("parts", F.ceil(F.col("n") / (block or BLOCK)).cast("int"))
    a = r.select(key, F.col(row).alias("row_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = r.select(key, F.col(row).alias("row_b"), F.pmod(F.xxhash64(row), F.col("parts")).cast("int").alias("part"))
    return a.join(b, [key, "part"]).where("row_a < row_b").select("row_a", "row_b")
