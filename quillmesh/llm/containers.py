"""Filling containers of fixed capacity with texts of varying length.

Only sizes decide a packing, and sizes are whole numbers up to the capacity; so the packing is planned from the
histogram of sizes (at most ``capacity`` rows, whatever the corpus) and then applied to all items in parallel:

1. A text above the longest window is cut into full pieces and a rest; other texts are one piece.
2. Every size is routed to the tier of the shortest window that holds it. Tiers are packed from the longest window down;
   a size first fills the tightest gaps that longer windows left, then opens containers of its own window (best fit,
   decreasing). A planned pattern stands for any number of equal containers. With one window there is one tier.
3. The items of a size are ranked (a size is salted by its count, so one that a third of all texts have is spread) and
   the rank leads to pattern and container.
4. Containers are numbered from the fullest and dealt to step groups forth and back, so the groups have as many containers
   and nearly as many tokens each.

Defined results: a text without tokens needs no room and is put, by the hash of its key, into one of the containers
(container 0 if there are none). Equal sizes are ranked by salt, key and piece. Keys must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import materialize

CAPACITY = 2048
#: Items of one size that are ranked in one task.
RANKED = 100_000


class Filled(NamedTuple):
    """``count`` equal containers of one window: how many pieces of each size they hold."""

    window: int
    pattern: dict[int, int]
    count: int

    @property
    def used(self) -> int:
        return sum(size * n for size, n in self.pattern.items())


def plan(histogram: dict[int, int], windows: tuple[int, ...] = (CAPACITY,)) -> list[Filled]:
    """Containers that hold the whole histogram of sizes, the fullest first."""
    open_: dict[int, list[Filled]] = {}
    closed: list[Filled] = []

    def put(f: Filled) -> None:
        room = f.window - f.used
        (open_.setdefault(room, []) if room else closed).append(f)

    tiers = sorted(windows, reverse=True)
    for window, shorter in zip(tiers, [*tiers[1:], 0]):
        for size in sorted((s for s in histogram if shorter < s <= window), reverse=True):
            left = histogram[size]
            while left:
                gap = min((r for r in open_ if r >= size), default=0)
                if not gap:
                    each = window // size
                    if left >= each:
                        put(Filled(window, {size: each}, left // each))
                        left %= each
                    if left:
                        put(Filled(window, {size: left}, 1))
                    break
                f = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                each = gap // size
                if left >= each * f.count:
                    used = f.count
                elif left >= each:
                    used = left // each
                else:
                    used, each = 1, left
                if used < f.count:
                    put(f._replace(count=f.count - used))
                put(f._replace(pattern=f.pattern | {size: f.pattern.get(size, 0) + each}, count=used))
                left -= each * used
    every = closed + [f for room in sorted(open_) for f in open_[room]]
    return sorted(every, key=lambda f: -f.used)


def pieces(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """``(key, piece, token_start, token_end, n_tokens)``: one row per text, more only for texts above the capacity."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("bigint")
    return (
        sizes.select(key, n.alias("all"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
        .withColumn("token_start", F.col("piece") * capacity)
        .withColumn("token_end", F.least(F.col("token_start") + capacity, F.col("all")))
        .select(key, "piece", "token_start", "token_end", (F.col("token_end") - F.col("token_start")).alias("n_tokens"))
    )


def fill_containers(sizes: DataFrame, key: str, capacity: int = CAPACITY, group: int = 8, windows: tuple[int, ...] | None = None) -> DataFrame:
    """``pieces`` with ``container_id``, ``window`` and ``step_group`` (of about ``group`` containers each).

    Containers hold ``capacity`` tokens, or one of several ``windows``, whose longest then is the capacity.
    """
    windows = tuple(windows or (capacity,))
    capacity = max(windows)
    items = materialize(pieces(sizes, key, capacity), "pieces")
    counted = items.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("all_of_size"))
    # as many rows as the capacity at most
    histogram = dict(counted.collect())
    parts = F.broadcast(counted.select("n_tokens", F.ceil(F.col("all_of_size") / RANKED).alias("parts")))
    salted = items.where("n_tokens > 0").join(parts, "n_tokens").withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.col("parts"))).drop("parts")
    counts = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    planned = plan(histogram, windows)
    first, intervals, used = 0, [], dict.fromkeys(histogram, 0)
    for f in planned:
        for size, each in f.pattern.items():
            intervals.append((size, used[size], first, each, f.window))
            used[size] += each * f.count
        first += f.count
    total = max(first, 1)
    groups = -(-total // group)
    table = np.array(sorted(intervals), np.int64).reshape(-1, 5)
    # the plan grows with the capacity, not with the corpus
    sent = items.sparkSession.sparkContext.broadcast(table)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        starts = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            names = batch.schema.names
            rank, size = (np.asarray(batch.column(names.index(c))) for c in ("rank", "n_tokens"))
            i = np.searchsorted(starts, (size << 44) + rank, side="right") - 1
            container = t[i, 2] + (rank - t[i, 1]) // t[i, 3]
            keep = [c for c in names if c != "rank"]
            cols = [batch.column(names.index(c)) for c in keep] + [pa.array(container, pa.int64()), pa.array(t[i, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "container_id", "window"])

    by_size = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(by_size), F.lit(0))).drop("n")
    within = Window.partitionBy("n_tokens", "salt").orderBy(key, "piece")
    ranked = (
        salted.join(offsets, ["n_tokens", "salt"])
        .withColumn("rank", F.row_number().over(within) - 1 + F.col("before"))
        .select(key, "piece", "token_start", "token_end", "n_tokens", F.col("rank").cast("bigint").alias("rank"))
    )
    kind = items.select(key).schema[0].dataType.simpleString()
    columns = f"`{key}` {kind}, piece bigint, token_start bigint, token_end bigint, n_tokens bigint, container_id bigint, window bigint"
    # the first container of every planned pattern, and its window
    opened = np.cumsum([0, *(f.count for f in planned)])[: max(len(planned), 1)]
    widths = np.array([f.window for f in planned] or [capacity], np.int64)
    ranges = items.sparkSession.sparkContext.broadcast((opened, widths))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, widths = ranges.value
        for batch in batches:
            at = np.searchsorted(opened, np.asarray(batch.column(5)), side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(widths[at], pa.int64())], [*batch.schema.names, "window"])

    somewhere = F.pmod(F.xxhash64(key), F.lit(total).cast("bigint")).alias("container_id")
    empty = items.where("n_tokens = 0").select(key, "piece", "token_start", "token_end", "n_tokens", somewhere).mapInArrow(place, columns)
    turn = F.pmod(F.col("container_id"), F.lit(2 * groups))
    return ranked.mapInArrow(assign, columns).unionByName(empty).withColumn("step_group", F.when(turn < groups, turn).otherwise(2 * groups - 1 - turn))
