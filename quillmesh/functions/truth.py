"""Six readings of a flag written as text. NULL is false in each but ``sync_optional``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def graph_flag(c: Column) -> Column:
    return _low(c).isin("1", "true", "yes", "y", "x")


def exact_flag(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == "True"


def government_flag(c: Column) -> Column:
    return _low(c).isin("true", "1", "yes")


def sync_flag(c: Column) -> Column:
    return _low(c) == "true"


def sync_optional(c: Column) -> Column:
    """True or NULL, never false."""
    return F.when(_low(c) == "true", True)


def demo_flag(c: Column) -> Column:
    return ~F.trim(F.coalesce(c, F.lit(""))).isin("", "0", "FALSE", "False", "No")
