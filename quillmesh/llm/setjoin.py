"""All pairs of records whose value sets overlap above a threshold: an adaptive extended-prefix join.

1. Equal sets are collapsed to one class (a class may hold any share of the rows).
2. The values of each class are ordered from the rarest. Sets of Jaccard similarity ``t`` share at least
   ``ceil(t * n)`` of the ``n`` values of either, hence at least ``l`` values of the first ``n - ceil(t * n) + l``.
3. Every class emits the combinations of ``l`` values of that prefix; classes meet on a common combination. A larger
   ``l`` means more rows to emit and far fewer candidates; the cheapest ``l`` is chosen from the join sizes of a hash
   share of the combinations. A set whose combinations would be too many, or that may share fewer values with another,
   takes a smaller ``l`` (1 always works), and two sets meet at the ``l`` of the larger.
4. Candidates are verified on the whole sets, and class pairs are written out as row pairs.

Defined results: case, surrounding blanks, repeats, NULL and blank values do not count; a NULL or empty array, or one
of fewer than ``min_size`` values, has no pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.pairs import same_key_pairs
from quillmesh.session import materialize

COMBINATIONS = 400
LEVELS = 4


def value_set(values: Column) -> Column:
    """The distinct values, sorted."""
    clean = F.transform(values, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def _combinations(values: Column, level: int) -> Column:
    """Hashes of all combinations of ``level`` values, each in the order of the array."""

    def walk(start: Column, picked: tuple[Column, ...]) -> Column:
        rest = F.slice(values, start, F.size(values))
        if len(picked) == level - 1:
            return F.transform(rest, lambda x: F.xxhash64(F.lit(level), *picked, x))
        return F.flatten(F.transform(rest, lambda x, i: walk(start + i + 1, (*picked, x))))

    return walk(F.lit(1), ())


class _Levels:
    """Which ``l`` two sets meet at, by the size of the larger."""

    def __init__(self, threshold: float, top: int) -> None:
        self.t = threshold
        self.up_to = {1: None}
        for level in range(2, top + 1):
            n = level
            while math.comb(self.prefix(n + 1, level), level) <= COMBINATIONS:
                n += 1
            self.up_to[level] = n
        # the sizes of sets that meet at a level; beyond the last, all meet at 1
        self.sizes: dict[int, list[list[int | None]]] = {level: [] for level in self.up_to}
        last = 0
        for n in range(1, max([0, *(u for u in self.up_to.values() if u)]) + 2):
            level = self._of(n)
            if level == last:
                self.sizes[level][-1][1] = n
            else:
                self.sizes[level].append([n, n])
            last = level
        self.sizes[1][-1][1] = None

    def _of(self, n: int) -> int:
        level = max(level for level, most in self.up_to.items() if most is None or n <= most)
        return max(1, min(level, self.shared(n)))

    def shared(self, n: int) -> int:
        return math.ceil(self.t * n - 1e-9)

    def prefix(self, n: int, level: int) -> int:
        return min(n, n - self.shared(n) + level)

    def at(self, n: Column) -> Column:
        out = F.lit(1)
        for level in sorted(self.up_to)[1:]:
            out = F.when(n <= self.up_to[level], level).otherwise(out)
        return F.greatest(F.lit(1), F.least(out, F.ceil(n * self.t - 1e-9).cast("int")))

    def emitted(self, tokens: Column) -> Column:
        """``(level, key)`` of every combination a set of these tokens must show."""
        n = F.size(tokens)
        shared = F.ceil(n * self.t - 1e-9).cast("int")
        partner = F.floor(n / self.t + 1e-9).cast("int")
        parts = []
        for level in self.up_to:
            prefix = F.slice(tokens, 1, F.least(n, n - shared + level))
            # the larger of two sets has from n to partner values
            wanted = F.lit(False)
            for least, most in self.sizes[level]:
                wanted = wanted | (partner >= least) & (F.lit(True) if most is None else n <= most)
            keys = F.when(wanted, _combinations(prefix, level)).otherwise(F.array().cast("array<bigint>"))
            parts.append(F.arrays_zip(F.array_repeat(F.lit(level), F.size(keys)).alias("level"), keys.alias("key")))
        return F.explode(F.concat(*parts))


def _emit(classes: DataFrame, levels: _Levels) -> DataFrame:
    return classes.select("cid", "side", "n", levels.emitted(F.col("tokens")).alias("e")).select(
        "cid", "side", "n", "e.level", "e.key"
    )


def _cost(classes: DataFrame, levels: _Levels, share: int) -> float:
    """Rows emitted plus candidates, from one of ``share`` hash parts of the combinations."""
    keys = _emit(classes, levels).where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).groupBy("level", "key").count()
    n = F.col("count").cast("double")
    return keys.agg(F.sum(n + n * (n - 1) / 2)).first()[0] or 0.0


def similar_sets(
    left: DataFrame,
    key: str,
    values: str,
    threshold: float,
    min_size: int = 1,
    right: DataFrame | None = None,
    share: int = 16,
) -> DataFrame:
    """``(key_a, key_b)`` of all row pairs with at least ``threshold`` Jaccard similarity.

    Within one table ``key_a < key_b``; with ``right``, ``key_a`` is of the left table and ``key_b`` of the right.
    """

    def keyed(df: DataFrame, side: int) -> DataFrame:
        s = df.select(F.col(key).alias("row"), value_set(F.col(values)).alias("set")).where(F.size("set") >= min_size)
        return s.withColumn("side", F.lit(side)).withColumn("digest", F.unhex(F.md5(F.concat_ws("\u001f", "set"))))

    sides = [keyed(left, 0)] + ([keyed(right, 1)] if right is not None else [])
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    distinct = materialize(rows.groupBy("side", "digest").agg(F.first("set").alias("set")), "sets")
    long = distinct.select("side", "digest", F.explode("set").alias("value"))
    ranks = long.groupBy("value").agg(F.count("*").alias("df"))
    ordered = F.array_sort(F.collect_list(F.struct("df", F.xxhash64("value").alias("token"))))
    classes = materialize(
        long.join(ranks, "value")
        .groupBy("side", "digest")
        .agg(ordered.alias("o"))
        .select(
            "side", "digest", F.monotonically_increasing_id().alias("cid"), F.size("o").alias("n"), F.col("o.token").alias("tokens")
        ),
        "classes",
    )
    choices = [_Levels(threshold, top) for top in range(1, LEVELS + 1)]
    levels = min(choices, key=lambda c: _cost(classes, c, share))
    emitted = _emit(classes, levels)
    a = emitted.select(*[F.col(c).alias(c + "_a") for c in ("cid", "side", "n")], "level", "key")
    b = emitted.select(*[F.col(c).alias(c + "_b") for c in ("cid", "side", "n")], "level", "key")
    order = F.col("cid_a") < F.col("cid_b") if right is None else (F.col("side_a") < F.col("side_b"))
    fits = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9) & (
        F.col("level") == levels.at(F.greatest("n_a", "n_b"))
    )
    candidates = a.join(b, ["level", "key"]).where(order & fits).select("cid_a", "cid_b").distinct()
    for s in "ab":
        candidates = candidates.join(
            classes.select(F.col("cid").alias(f"cid_{s}"), F.col("digest").alias(f"digest_{s}"), F.col("tokens").alias(f"t_{s}")),
            f"cid_{s}",
        )
    both = F.size(F.array_intersect("t_a", "t_b"))
    alike = both / (F.size("t_a") + F.size("t_b") - both) >= threshold
    pairs = candidates.where(alike).select("digest_a", "digest_b")

    members = rows.select("row", "side", "digest")

    def of(side: int, name: str) -> DataFrame:
        return members.where(F.col("side") == side).select(F.col("row").alias(f"row_{name}"), F.col("digest").alias(f"digest_{name}"))

    if right is None:
        across = pairs.join(of(0, "a"), "digest_a").join(of(0, "b"), "digest_b")
        same = same_key_pairs(members, "digest", "row")
        found = across.select(F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b"))
        found = found.unionByName(same.select("row_a", "row_b"))
    else:
        found = pairs.join(of(0, "a"), "digest_a").join(of(1, "b"), "digest_b").select("row_a", "row_b")
    return found.select(F.col("row_a").alias(f"{key}_a"), F.col("row_b").alias(f"{key}_b"))
