"""Mixing sources to target weights (problem 9), by Sainte-Laguë apportionment.

The whole mix is cut into equal blocks of tokens. Blocks go to sources one by one to the
highest quotient share / (2 * blocks so far + 1), as long as the source's documents, each
used at most its number of times, can fill them. A source's blocks go to its shards the
same way, by the shards' tokens. Within a shard documents stand in seeded order; whole
rounds over the shard come first, then documents from the start of the order until the
blocks are filled."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.runtime import cut, ship

#: Blocks of the whole mix; shares are met to within one block.
BLOCKS = 20_000
#: Tokens that a shard is meant to hold; there are as many shards as that takes.
SHARD_TOKENS = 2_000_000
#: Shards, or groups of them, among which one task shares tokens.
FAN = 1024
#: Sources with a target, at most: the driver holds their totals. More raise an error.
MAX_SOURCES = 1024


def sainte_lague(weights: dict, seats: int, limits: dict | None = None) -> dict:
    """Seats by the highest quotients weight / (2 * seats so far + 1); nobody gets more than
    its limit, and what it can't take goes on to the others. Ties go to the smaller key.

    A bisection finds a quotient that at most `seats` quotients reach. Those are given at once: one by
    one, too, they would all come before any lower one. The few seats left are given one by one."""
    limits = limits or {}
    got = dict.fromkeys(weights, 0)
    live = {k: (w, min(seats, limits.get(k, seats))) for k, w in weights.items() if w > 0 and limits.get(k, seats) > 0}
    if not live or seats <= 0:
        return got

    def reach(w: float, most: int, quotient: float) -> int:
        n = min(most, int((w / quotient + 1) / 2))
        while n > 0 and w / (2 * n - 1) < quotient:
            n -= 1
        while n < most and w / (2 * n + 1) >= quotient:
            n += 1
        return n

    low, high = 0.0, 2 * max(w for w, _ in live.values())
    if sum(most for _, most in live.values()) <= seats:
        return got | {k: most for k, (_, most) in live.items()}
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        taken = sum(reach(w, most, middle) for w, most in live.values())
        if taken > seats:
            low = middle
        else:
            high = middle
            if seats - taken <= 8:
                break
    for k, (w, most) in live.items():
        got[k] = reach(w, most, high)
    left = seats - sum(got.values())
    queue = [(-w / (2 * got[k] + 1), k) for k, (w, most) in live.items() if got[k] < most]
    heapq.heapify(queue)
    while queue and left > 0:
        _, k = heapq.heappop(queue)
        got[k] += 1
        left -= 1
        if got[k] < live[k][1]:
            heapq.heappush(queue, (-live[k][0] / (2 * got[k] + 1), k))
    return got


def split_tokens(wanted: int, held: dict[int, int], repeats: int, block: int) -> dict[int, int]:
    """`wanted` tokens (at most repeats times those held) shared among shards by whole blocks in the order of
    highest quotients; what part-filled blocks leave over goes to the first shards with room."""
    own = sainte_lague({k: float(t) for k, t in held.items()}, wanted // block, {k: -(-t * repeats // block) for k, t in held.items()})
    out = {k: min(n * block, held[k] * repeats) for k, n in own.items()}
    left = wanted - sum(out.values())
    for k in sorted(held):
        more = min(left, held[k] * repeats - out[k])
        out[k] += more
        left -= more
    return out


def shard_quotas(sums: DataFrame, wanted: DataFrame, levels: int, block: int, fan: int) -> DataFrame:
    """sums: (source, shard, t tokens); wanted: (source, wanted tokens, max_repeats) -> (source,
    shard, t, wanted, max_repeats). Shards form a tree of `fan` children a node; every node shares
    its tokens among its children, so no task sees more than `fan` rows of a group."""
    at = wanted.withColumn("node", F.lit(0).cast("bigint"))
    for level in range(levels - 1, -1, -1):
        width = fan**level
        below = sums.groupBy("source", F.expr(f"shard div {width}").alias("child")).agg(F.sum("t").alias("t")) if level else sums.select("source", F.col("shard").cast("bigint").alias("child"), "t")
        rows = below.withColumn("node", F.expr(f"child div {fan}")).join(at, ["source", "node"])

        def share(group: pd.DataFrame) -> pd.DataFrame:
            held = dict(zip(group["child"].tolist(), group["t"].tolist()))
            own = split_tokens(int(group["wanted"].iloc[0]), held, int(group["max_repeats"].iloc[0]), block)
            return pd.DataFrame({"source": group["source"], "node": group["child"], "t": group["t"], "wanted": [own[k] for k in group["child"]], "max_repeats": group["max_repeats"]})

        shared = rows.groupBy("source", "node").applyInPandas(share, "source string, node bigint, t bigint, wanted bigint, max_repeats int")
        at = shared if level == 0 else shared.drop("t")
    return at.withColumnRenamed("node", "shard")


def largest_total(tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The most tokens at which every source that has documents and a target can meet its
    share of them (shares of sources without documents are spread over the others)."""
    live = [s for s in shares if tokens.get(s, 0) > 0 and shares[s] > 0 and repeats[s] > 0]
    whole = sum(shares[s] for s in live)
    return min((int(tokens[s] * repeats[s] * whole / shares[s]) for s in live), default=0)


def draw_mix(docs: DataFrame, item: str, source: str, tokens: str, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares). drawn: (item, source, tokens, repeats), every drawn document once
    with how often it is used. shares: one row per source that has a target or documents:
    (source, target_share, wanted_share, max_repeats, available_tokens, drawn_tokens,
    drawn_documents, reached_share).

    targets: (source, target_share, max_repeats), at most MAX_SOURCES rows. total_tokens:
    the size of the mix; by default the largest at which every target can be met.
    wanted_share is the target among sources that have documents. A source that can't fill
    its blocks leaves them to the others. Documents of null source, of no tokens or of a source
    without a target are never drawn. The same documents and seed give the same draw."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    share = {r.source: float(r.target_share) for r in rows}
    most = {r.source: int(r.max_repeats) for r in rows}
    sized = docs.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens")).where("source is not null and tokens > 0")
    sized = cut(sized)
    have_rows = sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    targeted = have_rows.where(F.col("source").isin(list(share))) if share else have_rows.limit(0)
    have = {r.source: int(r.t) for r in targeted.collect()}  # at most MAX_SOURCES rows
    total = largest_total(have, share, most) if total_tokens is None else min(total_tokens, sum(have[s] * most[s] for s in have))
    live = {s: share[s] for s in have}
    n_shards = {s: max(1, -(-have[s] // shard_tokens)) for s in have}
    if not n_shards or total <= 0:
        drawn = sized.limit(0).select("item", "source", "tokens", F.lit(0).alias("repeats"))
    else:
        block = max(1, -(-total // blocks))
        # the last block at a limit may be part-filled
        quota = sainte_lague(live, -(-total // block), {s: -(-have[s] * most[s] // block) for s in have})
        shard_map = F.create_map(*[x for s, n in n_shards.items() for x in (F.lit(s), F.lit(n).cast("bigint"))])
        placed = sized.where(F.col("source").isin(list(n_shards))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("item")), shard_map[F.col("source")]))
        wanted = spark.createDataFrame([(s, min(quota[s] * block, have[s] * most[s]), most[s]) for s in n_shards], "source string, wanted bigint, max_repeats int")
        levels = 1
        while fan**levels < max(n_shards.values()):
            levels += 1
        quotas = shard_quotas(placed.groupBy("source", "shard").agg(F.sum("tokens").alias("t")), wanted, levels, block, fan)
        quotas = quotas.select("source", "shard", F.expr("wanted div t").alias("rounds"), (F.col("wanted") % F.col("t")).alias("rest"), "max_repeats")
        w = W.partitionBy("source", "shard").orderBy("_order", "item").rowsBetween(W.unboundedPreceding, -1)
        seeded = placed.withColumn("_order", F.xxhash64(F.lit(seed), F.col("item"))).withColumn("_before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
        joined = seeded.join(quotas, ["source", "shard"])
        repeats = F.least(F.col("max_repeats").cast("bigint"), F.col("rounds") + F.when(F.col("_before") * 2 + F.col("tokens") <= F.col("rest") * 2, 1).otherwise(0))
        drawn = joined.select("item", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")
    drawn = cut(drawn)
    sums = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("drawn_documents"))
    whole = sum(live.values()) or 1.0
    reached = drawn.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] or 0
    asked = spark.createDataFrame([(s, share[s], live.get(s, 0.0) / whole, most[s]) for s in sorted(share)], "source string, target_share double, wanted_share double, max_repeats int")
    available = have_rows.select("source", F.col("t").alias("available_tokens"))
    out = available.join(asked, "source", "full").join(sums, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    shares = out.select("source", "target_share", "wanted_share", "max_repeats", zero("available_tokens"), zero("drawn_tokens"), zero("drawn_documents"), (F.coalesce("drawn_tokens", F.lit(0)) / F.lit(float(reached or 1))).alias("reached_share"))
    return drawn, shares
