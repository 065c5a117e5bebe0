"""Extracted names against annotated ones, and two extractions against each other.

Sides are ``(doc, kind, name)``; names are compared plain (lower case, no punctuation). A document that only one side has
counts with an empty list on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import edit_ratio, plain_name, ratio


def matched(predicted: DataFrame, gold: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(doc, kind, tp, partial, fp, fn)``: each predicted name, in order, takes the first free gold name that is equal or
    alike enough; ``partial`` counts those taken that are not equal. An earlier gold name that is alike wins over a later
    equal one. The lists of one document are the unit; ``pos`` orders them.
    """

    def lists(df: DataFrame, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("pos", plain_name(F.col("name")).alias("n"))))
        return df.groupBy("doc", "kind").agg(F.transform(ordered, lambda x: x["n"]).alias(name))

    none = F.array().cast("array<string>")
    j = lists(predicted, "p").join(lists(gold, "g"), ["doc", "kind"], "full").select("doc", "kind", F.coalesce("p", none).alias("p"), F.coalesce("g", none).alias("g"))
    start = F.struct(F.col("g").alias("free"), F.lit(0).alias("tp"), F.lit(0).alias("partial"))

    def take(acc, n):
        at = F.array_position(F.transform(acc["free"], lambda m: (m == n) | (edit_ratio(m, n) >= threshold)), True).cast("int")
        rest = F.concat(F.slice(acc["free"], 1, F.greatest(at - 1, F.lit(0))), F.slice(acc["free"], at + 1, F.size(acc["free"])))
        partial = (F.get(acc["free"], at - 1) != n).cast("int")
        return F.when(at > 0, F.struct(rest.alias("free"), (acc["tp"] + 1).alias("tp"), (acc["partial"] + partial).alias("partial"))).otherwise(acc)

    r = j.select("doc", "kind", F.size("p").alias("n"), F.aggregate("p", start, take).alias("r"))
    big = lambda c: c.cast("bigint")
    return r.select("doc", "kind", big(F.col("r.tp")).alias("tp"), big(F.col("r.partial")).alias("partial"), big(F.col("n") - F.col("r.tp")).alias("fp"), big(F.size("r.free")).alias("fn"))


def by_kind(counts: DataFrame) -> DataFrame:
    """Sums, precision, recall and F1 of every kind."""
    c = counts.groupBy("kind").agg(*[F.sum(x).alias(x) for x in ("tp", "partial", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("kind", "tp", "partial", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def macro_f1(kinds: DataFrame) -> DataFrame:
    """The mean F1 of the kinds that occur on either side, four decimals; 0 if none does."""
    some = kinds.where(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    return some.agg(F.coalesce(F.round(F.avg("f1"), 4), F.lit(0.0)).alias("macro_f1"), F.count("*").alias("n_kinds"))


def type_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Of the predicted names that gold has in the document under any kind, the share under the same kind.

    A name that gold has under several kinds counts once for each.
    """
    p = predicted.select("doc", "kind", plain_name(F.col("name")).alias("n"))
    g = gold.select("doc", F.col("kind").alias("gold_kind"), plain_name(F.col("name")).alias("n")).distinct()
    right = F.count_if(F.col("kind") == F.col("gold_kind"))
    return p.join(g, ["doc", "n"]).agg(F.count("*").alias("n_total"), right.alias("n_right"), F.round(ratio(right.cast("double"), F.count("*")), 4).alias("accuracy"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(doc, n_both, n_a, n_b)``: names, lower case and stripped, of both sides and of one only."""
    side = lambda df, c: df.select("doc", F.lower(F.trim("name")).alias("n")).where("n <> ''").distinct().withColumn(c, F.lit(1))
    j = side(a, "in_a").join(side(b, "in_b"), ["doc", "n"], "full")
    return j.groupBy("doc").agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"), F.count_if(F.col("in_b").isNull()).alias("n_a"), F.count_if(F.col("in_a").isNull()).alias("n_b"))


def contained(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct ``(doc, name)`` of ``a`` that hold, or are held by, a name of ``b`` in the same document."""
    side = lambda df, c: df.select("doc", F.lower(F.trim("name")).alias(c)).where(f"{c} <> ''").distinct()
    x, y = side(a, "name"), side(b, "other")
    held = (x["doc"] == y["doc"]) & (F.col("name").contains(F.col("other")) | F.col("other").contains(F.col("name")))
    return x.join(y, held, "left_semi")


def label_totals(spans: DataFrame, label: str = "kind") -> DataFrame:
    """Mentions by label, the most frequent first; of equal ones the first seen."""
    return spans.groupBy(label).agg(F.count("*").alias("n"), F.min("record_id").alias("since")).orderBy(F.desc("n"), "since").select(label, "n")
