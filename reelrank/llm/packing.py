"""Filling fixed-capacity containers with items (problem 8), by variable-capacity
best-fit over the histogram of sizes.

Sizes are whole numbers up to the largest capacity, so all that packing needs to know of
any number of items is how many there are of each size: a table of at most that many rows.
Best-fit runs over this histogram, moving whole groups of equal items into whole groups of
equally full bins: an item goes where it leaves the least space; where it fits nowhere,
bins are opened of the permitted capacity that costs least, judged by the share of it that
the items still waiting would leave empty. Finally every bin is downsized to the
smallest permitted capacity that holds its contents. What comes out is a list of slots
("the items of size 300 with numbers 17 to 42 go to bins 5 to 30"), by which every item
finds its bin from its size and its number among equals, in parallel."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelrank.runtime import cut, ship

#: Items of one size are numbered in parts of about so many.
PART_ROWS = 100_000
#: The largest capacity for which a histogram is kept on the driver.
LARGEST_CAPACITY = 1 << 20


@dataclass
class Bins:
    """A group of bins with the same contents. slots: (size, number of the first item) of
    each item; the k-th bin of the group holds the first number + k."""

    count: int
    capacity: int
    left: int
    slots: list[tuple[int, int]] = field(default_factory=list)


def _waste(capacity: int, size: int, waiting: list[int], count: dict[int, int]) -> float:
    """The share of a bin that stays empty when the largest waiting items that fit go in."""
    left = capacity - size
    taken: dict[int, int] = {size: 1}
    at = bisect_right(waiting, left)
    while left and at:
        s = waiting[at - 1]
        k = min(left // s, count[s] - taken.get(s, 0))
        if k > 0:
            taken[s] = taken.get(s, 0) + k
            left -= k * s
        at = min(at - 1, bisect_right(waiting, left))
    return left / capacity


def best_fit(histogram: dict[int, int], capacities: list[int]) -> list[Bins]:
    """Bins for `histogram` (size -> number of items, sizes from 1 to the largest
    capacity). Deterministic; time depends on the number of sizes, not of items."""
    permitted = sorted(set(capacities))
    count = {s: n for s, n in histogram.items() if n > 0}
    numbered = dict.fromkeys(count, 0)
    waiting = sorted(count)
    open_: dict[int, list[Bins]] = {}  # by space left
    spaces: list[int] = []
    full: list[Bins] = []

    def put(b: Bins) -> None:
        if b.left == 0:
            full.append(b)
            return
        if b.left not in open_:
            open_[b.left] = []
            insort(spaces, b.left)
        open_[b.left].append(b)

    def take(space: int) -> Bins:
        b = open_[space].pop()
        if not open_[space]:
            del open_[space]
            spaces.pop(bisect_left(spaces, space))
        return b

    while waiting:
        size = waiting[-1]
        todo = count[size]
        while todo:
            at = bisect_left(spaces, size)
            if at < len(spaces):
                b = take(spaces[at])
                k = min(b.count, todo)
                if k < b.count:
                    put(Bins(b.count - k, b.capacity, b.left, [(s, n + k) for s, n in b.slots]))
                filled = Bins(k, b.capacity, b.left - size, [*b.slots, (size, numbered[size])])
                numbered[size] += k
                todo -= k
                put(filled)
                continue
            count[size] = todo
            capacity = min((c for c in permitted if c >= size), key=lambda c: (round(_waste(c, size, waiting, count), 9), -c))
            # so many that every item of this size gets in, several to a bin where they fit
            per_bin = capacity // size
            k = max(1, todo // per_bin)
            used = per_bin if todo >= per_bin else todo
            first = numbered[size]
            put(Bins(k, capacity, capacity - used * size, [(size, first + i * k) for i in range(used)]))
            numbered[size] += k * used
            todo -= k * used
        count.pop(size)
        waiting.pop()
    bins = full + [b for space in spaces for b in open_[space]]
    for b in bins:
        held = b.capacity - b.left
        b.capacity = permitted[bisect_left(permitted, held)]
        b.left = b.capacity - held
    return bins


def pieces(sizes: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece, offset, size): an item longer than `capacity` is cut into full pieces
    and the rest; any other stays whole."""
    n = F.expr(f"cast(ceil(`{size}` / {capacity}) as int)")
    many = sizes.select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("_total"), n.alias("_n")).where("_n >= 1")
    cutd = many.select("item", "_total", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("piece"))
    return cutd.select("item", "piece", (F.col("piece").cast("bigint") * capacity).alias("offset"), F.least(F.lit(capacity).cast("bigint"), F.col("_total") - F.col("piece").cast("bigint") * capacity).cast("int").alias("size"))


def _slots(bins: list[Bins]) -> tuple[np.ndarray, ...]:
    rows, first_bin = [], 0
    for b in bins:
        rows += [(s, n, first_bin, b.capacity, b.left) for s, n in b.slots]
        first_bin += b.count
    rows.sort()
    code = np.array([(s << 42) | n for s, n, *_ in rows], dtype=np.int64)
    return code, np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64), np.array([r[4] for r in rows], dtype=np.int64)


def pack(sizes: DataFrame, item: str, size: str, capacities: list[int], part_rows: int = PART_ROWS) -> DataFrame:
    """(item, piece, offset, size, bin_id, capacity, unused): each item's container, the
    container's capacity (one of `capacities`, chosen jointly) and its unused space.

    Items longer than the largest capacity come in pieces; all others are whole. Items of null
    or no size need no container and give no row. `item` must identify rows; the same items
    always get the same bins. Other columns don't matter.

    The driver holds one count per size (at most the largest capacity, LARGEST_CAPACITY at
    most) and the slots, which depend on the number of sizes and not of items; the slots
    are what every task gets."""
    permitted = sorted({int(c) for c in capacities})
    if not permitted or permitted[0] < 1 or permitted[-1] > LARGEST_CAPACITY:
        raise ValueError(f"capacities must lie between 1 and {LARGEST_CAPACITY}")
    ship(sizes.sparkSession)
    rows = cut(pieces(sizes.where(F.col(size) > 0), item, size, permitted[-1]))
    total = rows.count()
    parts = max(1, -(-total // part_rows))
    part = F.pmod(F.xxhash64("item", "piece"), F.lit(parts))
    rows = rows.withColumn("_part", part)
    by_part = rows.groupBy("size", "_part").agg(F.count("*").alias("n"))
    histogram = {r["size"]: r.n for r in by_part.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    bins = best_fit(histogram, permitted)
    code, first, bin_, capacity, left = _slots(bins)
    # numbers among equals: the part's start plus the place within the part
    start = by_part.select("size", "_part", (F.sum("n").over(W.partitionBy("size").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).alias("_before"))
    placed = rows.withColumn("_at", F.row_number().over(W.partitionBy("size", "_part").orderBy("item", "piece")) - 1)
    placed = placed.join(start, ["size", "_part"]).withColumn("_number", F.coalesce("_before", F.lit(0)) + F.col("_at"))
    shape = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("capacity", T.LongType()), T.StructField("unused", T.LongType())])

    @F.pandas_udf(shape)
    def find(s: pd.Series, number: pd.Series) -> pd.DataFrame:
        want = (s.to_numpy(np.int64) << 42) | number.to_numpy(np.int64)
        k = np.searchsorted(code, want, side="right") - 1
        return pd.DataFrame({"bin_id": bin_[k] + number.to_numpy(np.int64) - first[k], "capacity": capacity[k], "unused": left[k]})

    return placed.withColumn("_bin", find("size", "_number")).select("item", "piece", "offset", "size", "_bin.bin_id", "_bin.capacity", "_bin.unused")
