"""Streaming forms of the stateful batch steps: resume without repeats, counting to a threshold, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_documents(stream: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """Each document once; repeats within the delay are dropped, so the state stays bounded."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    counts = stream.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), kind, "n", "total")


def graduated(stream: DataFrame, phrase: str, meaning: str, times: int = 5) -> DataFrame:
    """Phrases given one meaning ``times`` times so far (complete output)."""
    return stream.groupBy(phrase, meaning).agg(F.count("*").alias("n")).where(F.col("n") >= times)
