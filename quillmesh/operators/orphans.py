"""References to records that do not exist, are deleted, or arrive later.

References are pre-aggregated per key and period, so one hot key is a handful of rows before anything is shuffled. The
groups of more than 1/1000 of all references (at most 1000, whatever the data) are checked by broadcast, in both the
aggregated and the row form; the remaining groups meet the catalogue in a shuffle join, and both parts are united.

Kinds: ``missing`` (no catalogue row for the number), ``deleted`` (a deletion at or before the reference was loaded),
``late`` (the first catalogue load is after the reference's). Ids are compared as numbers; a NULL, blank or
non-numeric id is no reference. A reference without a load time can only be ``missing``; its period is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_GROUPS = 1000


def id_number(c: Column) -> Column:
    """The number an id is written as: blanks around it, leading zeros and a trailing ``.0`` do not matter."""
    plain = F.regexp_replace(c.cast("string"), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    whole = F.regexp_extract(plain, r"^([+-]?[0-9]+)(?:\.0*)?$", 1)
    return F.when(whole != "", whole.try_cast("bigint"))


def references(tables: dict[str, DataFrame], key: str = "doc_id", at: str = "loaded_at", row: str = "ord") -> DataFrame:
    """``(table_name, ord, key, at, period)`` of every reference of the tables."""
    out = None
    for name, df in tables.items():
        part = df.select(
            F.lit(name).alias("table_name"),
            F.col(row).cast("bigint").alias("ord"),
            id_number(F.col(key)).alias("key"),
            F.col(at).alias("at"),
            F.date_format(F.col(at), "yyyy-MM").alias("period"),
        ).where("key IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def catalogue_states(catalogue: DataFrame, key: str = "doc_id", at: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """One row per catalogue number: first load, first deletion."""
    return (
        catalogue.select(id_number(F.col(key)).alias("key"), F.col(at).alias("at"), F.col(deleted).alias("gone"))
        .where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("at").alias("first_at"), F.min("gone").alias("gone_at"), F.lit(True).alias("known"))
    )


def _kind(at: Column) -> Column:
    return (
        F.when(F.col("known").isNull(), F.lit("missing"))
        .when(F.col("gone_at") <= at, F.lit("deleted"))
        .when(F.col("first_at") > at, F.lit("late"))
    )


GROUP = ["table_name", "key", "period"]
STATE = ["first_at", "gone_at", "known"]


def _groups(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Reference groups of a key and period, with the state of the key and the kinds of their first and last row.

    A group passes from late through in order to deleted as time goes on, so equal kinds at both ends hold throughout.
    """
    total = refs.count()
    groups = refs.groupBy(*GROUP).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    return (
        groups.join(states, "key", "left")
        .withColumn("heavy", F.col("n") * HEAVY_GROUPS >= F.lit(total))
        .withColumn("kind_lo", _kind(F.col("lo")))
        .withColumn("kind_hi", _kind(F.col("hi")))
    )


def _named(df: DataFrame, *more: str) -> DataFrame:
    """The group columns under other names, for joins."""
    return df.select(*[F.col(c).alias(f"g_{c}") for c in GROUP], *more)


def _on_group() -> Column:
    same_period = F.col("period").eqNullSafe(F.col("g_period"))
    return (F.col("table_name") == F.col("g_table_name")) & (F.col("key") == F.col("g_key")) & same_period


def _rows_of(refs: DataFrame, groups: DataFrame, wanted: Column) -> DataFrame:
    """Orphan references of the wanted groups: the heavy ones by broadcast, the rest by a shuffle join, united."""
    heavy = F.broadcast(_named(groups.where("heavy")))
    hot = refs.join(F.broadcast(_named(groups.where(F.col("heavy") & wanted), *STATE)), _on_group())
    cold = refs.join(heavy, _on_group(), "left_anti").join(_named(groups.where(~F.col("heavy") & wanted), *STATE), _on_group())
    return (
        hot.unionByName(cold)
        .select("table_name", "ord", "key", "period", _kind(F.col("at")).alias("kind"))
        .where("kind IS NOT NULL")
    )


def orphan_rows(refs: DataFrame, states: DataFrame) -> DataFrame:
    """``(table_name, ord, kind, period)`` of every orphan reference."""
    wanted = F.col("kind_lo").isNotNull() | F.col("kind_hi").isNotNull()
    return _rows_of(refs, _groups(refs, states), wanted).select("table_name", "ord", "kind", "period")


def orphan_counts(refs: DataFrame, states: DataFrame) -> DataFrame:
    """``(table_name, period, kind, n_rows, n_keys)``: the report per table and period.

    Groups of one kind are counted as they are; only the rows of groups that change their kind are looked at.
    """
    groups = _groups(refs, states)
    mixed = ~F.col("kind_lo").eqNullSafe(F.col("kind_hi"))
    whole = groups.where(~mixed & F.col("kind_lo").isNotNull()).select(*GROUP, F.col("kind_lo").alias("kind"), "n")
    split = _rows_of(refs, groups, mixed).groupBy(*GROUP, "kind").agg(F.count("*").alias("n"))
    return (
        whole.unionByName(split)
        .groupBy("table_name", "period", "kind")
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))
    )
