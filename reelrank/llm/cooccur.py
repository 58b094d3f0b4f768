"""Items that appear together (problem 3), by stripes.

Each basket gives, for every item, the array of its neighbours (its stripe). Map tasks
merge the stripes of all their baskets into one associative array per item before anything
is shuffled; reducers receive whole stripes and add them up by key. A stripe is shuffled
in slices by neighbour, so that the stripe of an item that is everywhere is spread too.

Baskets of unlimited size: a pair needs `min_count` baskets, so the min_count - 1 largest
baskets alone can never make a pair. These emit no stripes at all. Pairs that the other
baskets nominate get their counts in the large ones by intersecting the two items' lists
of large baskets (at most min_count - 1 entries). Any other basket of more than BLOCK_ITEMS items is
cut into blocks, and every two blocks go to a task of their own. Every count stays exact."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelrank.runtime import cut, ship

#: Baskets of at most so many items always give stripes.
LARGE_BASKET = 64
#: Items of a basket that one row may hold; larger baskets are cut into blocks of about so many.
BLOCK_ITEMS = 2048
#: Baskets of at most so many items are paired without arrays.
SMALL_BASKET = 24
#: Pairs that a map task merges in memory before it passes its stripes on.
FLUSH_PAIRS = 2_000_000
#: Slices of a stripe in the shuffle.
SLICES = 64
#: Neighbours of one stripe record.
STRIPE = 4096


def _merge(codes: list[np.ndarray], counts: list[np.ndarray], names: np.ndarray) -> Iterator[pd.DataFrame]:
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    count = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
    item, near = code >> 32, code & 0xFFFFFFFF
    # a stripe record: one item, one slice of its neighbours
    part = np.array([hash_slice(n) for n in names], dtype=np.int64)[near]
    order = np.lexsort((near, part, item))
    item, near, count, part = item[order], near[order], count[order], part[order]
    new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (part[1:] != part[:-1])])
    ends = np.r_[new[1:], len(item)]
    rows: list[tuple] = []
    for lo, hi in zip(new, ends):
        for k in range(lo, hi, STRIPE):
            top = min(hi, k + STRIPE)
            rows.append((names[item[lo]], int(part[lo]), names[near[k:top]], count[k:top]))
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=["item_a", "part", "near", "counts"])
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["item_a", "part", "near", "counts"])


def hash_slice(name: str) -> int:
    """A slice that every worker computes alike."""
    return zlib.crc32(name.encode()) % SLICES


def _pair_codes(k: np.ndarray, sides: np.ndarray | None) -> Iterator[np.ndarray]:
    """The pairs of a basket's numbers, in blocks of bounded size; with sides only those between the two."""
    for i0 in range(0, len(k), 512):
        for j0 in range(i0, len(k), 4096):
            i = np.arange(i0, min(i0 + 512, len(k)))
            j = np.arange(j0, min(j0 + 4096, len(k)))
            a, b = np.meshgrid(i, j, indexing="ij")
            keep = a < b
            if sides is not None:
                keep &= sides[a] != sides[b]
            if keep.any():
                yield (k[a[keep]] << 32) | k[b[keep]]


def _stripes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids: dict[str, int] = {}
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    small: list[int] = []  # pairs of small baskets
    held = 0

    def add(code: np.ndarray) -> Iterator[pd.DataFrame]:
        nonlocal codes, counts, held
        codes.append(code)
        counts.append(np.ones(len(code), dtype=np.int64))
        held += len(code)
        if held >= FLUSH_PAIRS:
            merged, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
            codes, counts, held = [merged], [count], len(merged)
            if held >= FLUSH_PAIRS // 2:
                yield from _merge(codes, counts, np.array(list(ids), dtype=object))
                codes, counts, held = [], [], 0  # names keep their numbers

    for batch in batches:
        for items, right in zip(batch["items"], batch["right"]):
            if right is None and len(items) <= SMALL_BASKET:
                k = [ids.setdefault(x, len(ids)) for x in sorted(items)]
                small += [x << 32 | y for x, y in combinations(k, 2)]
                if len(small) >= FLUSH_PAIRS // 8:
                    yield from add(np.array(small, dtype=np.int64))
                    small = []
            else:
                # sorted, so that places compare as names do; a pair of blocks gives the pairs between them
                side = dict.fromkeys(items, 0) | ({} if right is None else dict.fromkeys(right, 1))
                names = sorted(side)
                sides = None if right is None else np.array([side[x] for x in names], dtype=np.int8)
                for code in _pair_codes(np.array([ids.setdefault(x, len(ids)) for x in names], dtype=np.int64), sides):
                    yield from add(code)
        if len(ids) > FLUSH_PAIRS // 2:  # too many names to hold on to
            if small:
                yield from add(np.array(small, dtype=np.int64))
            if codes:
                yield from _merge(codes, counts, np.array(list(ids), dtype=object))
            ids, codes, counts, small, held = {}, [], [], [], 0
    if small:
        yield from add(np.array(small, dtype=np.int64))
    if codes:
        yield from _merge(codes, counts, np.array(list(ids), dtype=object))


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))


def log_likelihood(c: Column, a: Column, b: Column, n: int) -> Column:
    """The log-likelihood ratio of the 2x2 table of two items' baskets."""
    c, a, b = (x.cast("double") for x in (c, a, b))
    total = F.lit(float(n))
    cells = _xlogx(c) + _xlogx(a - c) + _xlogx(b - c) + _xlogx(total - a - b + c)
    margins = _xlogx(a) + _xlogx(total - a) + _xlogx(b) + _xlogx(total - b)
    return F.greatest(F.lit(0.0), 2 * (cells - margins + _xlogx(total)))


def basket_rows(frequent: DataFrame, wide: DataFrame, block_items: int) -> DataFrame:
    """(items, right): a row for each basket of several items, or, for those of wide (basket, n), one
    for every two of its blocks; right is null where the pairs are those within items."""
    none_wide = wide.isEmpty()
    plain = frequent if none_wide else frequent.join(wide.select("basket"), "basket", "left_anti")
    whole = plain.groupBy("basket").agg(F.collect_list("item").alias("items")).where(F.size("items") > 1).select("items", F.lit(None).cast("array<string>").alias("right"))
    if none_wide:
        return whole
    blocks = F.expr(f"cast(ceil(n / {block_items}) as int)")
    cells = frequent.join(wide, "basket").withColumn("blocks", blocks).withColumn("b", F.expr("cast(pmod(xxhash64(item), blocks) as int)"))
    cells = cells.withColumn("k", F.explode(F.expr("sequence(0, blocks - 1)"))).select("basket", "item", "b", F.least("b", "k").alias("lo"), F.greatest("b", "k").alias("hi"))
    two = cells.groupBy("basket", "lo", "hi").agg(F.collect_list(F.when(F.col("b") == F.col("lo"), F.col("item"))).alias("items"), F.collect_list(F.when((F.col("b") == F.col("hi")) & (F.col("lo") < F.col("hi")), F.col("item"))).alias("right"))
    return whole.unionByName(two.select("items", F.when(F.col("lo") < F.col("hi"), F.col("right")).alias("right")))


def cooccurrence(rows: DataFrame, basket: str, item: str, min_count: int = 5, large: int = LARGE_BASKET, block_items: int = BLOCK_ITEMS, min_ratio: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n, lift, llr) with item_a < item_b by code point:
    every pair that stands in at least `min_count` baskets and has a log-likelihood ratio of at least
    `min_ratio` (10.83: significant at one in a thousand). n counts the baskets with an
    item, lift is n_ab * n / (n_a * n_b), llr Dunning's ratio.

    An item counts once per basket; rows with a null basket or item don't count; an empty
    table gives no pairs. Other columns don't matter."""
    if min_count < 1:
        raise ValueError("min_count must be 1 or more")
    ship(rows.sparkSession)
    held = cut(rows.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item")).where("basket is not null and item is not null").distinct())
    n = held.select("basket").distinct().count()
    support = cut(held.groupBy("item").count().withColumnRenamed("count", "support").where(F.col("support") >= min_count))
    frequent = held.join(support.select("item"), "item", "left_semi")
    sizes = cut(frequent.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > min(large, block_items)))
    # at most min_count - 1 baskets, as many rows on the driver
    largest = [r.basket for r in sizes.where(F.col("n") > large).orderBy(F.desc("n"), "basket").limit(min_count - 1).collect()] if min_count > 1 else []
    is_large = F.col("basket").isin(largest) if largest else F.lit(False)
    baskets = basket_rows(frequent.where(~is_large), sizes.where((F.col("n") > block_items) & ~is_large), block_items)
    stripes = baskets.mapInPandas(_stripes, "item_a string, part int, near array<string>, counts array<bigint>")
    merged = stripes.repartition("item_a", "part").select("item_a", "part", F.explode(F.arrays_zip("near", "counts")).alias("x")).groupBy("item_a", "part", F.col("x.near").alias("item_b")).agg(F.sum("x.counts").alias("n_light"))
    need = min_count - len(largest)
    merged = merged.where(F.col("n_light") >= need).drop("part")
    if largest:
        where_large = frequent.where(is_large).groupBy("item").agg(F.collect_set("basket").alias("in_large"))
        for side in "ab":
            merged = merged.join(where_large.select(F.col("item").alias(f"item_{side}"), F.col("in_large").alias(f"large_{side}")), f"item_{side}", "left")
        both = F.size(F.array_intersect("large_a", "large_b"))
        merged = merged.withColumn("n_ab", F.col("n_light") + F.when(both > 0, both).otherwise(0))
    else:
        merged = merged.withColumnRenamed("n_light", "n_ab")
    merged = merged.where(F.col("n_ab") >= min_count)
    for side in "ab":
        merged = merged.join(support.select(F.col("item").alias(f"item_{side}"), F.col("support").alias(f"n_{side}")), f"item_{side}")
    lift = F.col("n_ab").cast("double") * n / (F.col("n_a").cast("double") * F.col("n_b"))
    out = merged.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.lit(n).cast("bigint").alias("n"), lift.alias("lift"), log_likelihood(F.col("n_ab"), F.col("n_a"), F.col("n_b"), n).alias("llr"))
    return out.where(F.col("llr") >= min_ratio) if min_ratio > 0 else out
