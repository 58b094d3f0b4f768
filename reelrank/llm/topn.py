"""Top N items within every group (problem 5), by score histograms.

Each group's histogram of scores gives a lower bound that at least N items reach; items
below it are dropped before anything is ranked, and only the survivors are ranked exactly,
ties included. Histograms have a fixed number of buckets, so they are small however large
the group; survivors are ranked in salted parts first (N of each part, then N of all), so
one score shared by a third of all rows is no hot group either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.runtime import BROADCAST_ROWS, cut

SALTS = 16
#: Buckets are the leading bits of the score's order-preserving code: sign, exponent and
#: the first bits of the fraction.
FRACTION_BITS = 6


def score_bucket(score: Column) -> Column:
    """A bucket number that never falls as the score rises, from the score's leading
    digits: floor(2**FRACTION_BITS * log2-like code), the same for equal scores."""
    size = F.abs(score)
    exponent = F.floor(F.log2(F.greatest(size, F.lit(2.0**-60))))
    exponent = F.least(F.greatest(exponent, F.lit(-60)), F.lit(1023))
    fraction = size / F.pow(F.lit(2.0), exponent.cast("double")) - 1  # about 0 to 1; clamped
    step = F.least(F.greatest(F.floor(fraction * 2**FRACTION_BITS), F.lit(0)), F.lit(2**FRACTION_BITS - 1))
    code = (exponent + 61) * 2**FRACTION_BITS + step
    return F.when(score > 0, code).when(score < 0, -code).otherwise(F.lit(0)).cast("int")


def best_scores(rows: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """(group, item, score): each item once per group with its highest finite score."""
    finite = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (F.abs(F.col(score).cast("double")) < F.lit(float("inf")))
    valid = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull() & finite)
    return valid.groupBy(F.col(group).alias("grp"), F.col(item).cast("string").alias("item")).agg(F.max(F.col(score).cast("double")).alias("score"))


def score_floors(scored: DataFrame, n: int) -> DataFrame:
    """(grp, floor, size) of every group with more than n items: the highest bucket that, with those
    above it, holds at least n of them."""
    histogram = scored.groupBy("grp", "bucket").agg(F.count("*").alias("here"))
    down = W.partitionBy("grp").orderBy(F.desc("bucket"))  # a group's buckets are bounded
    sized = histogram.withColumn("reach", F.sum("here").over(down)).withColumn("size", F.sum("here").over(W.partitionBy("grp")))
    return sized.where((F.col("size") > n) & (F.col("reach") - F.col("here") < n)).groupBy("grp").agg(F.min("bucket").alias("floor"), F.max("size").alias("size"))


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 10, floors_sent: int = BROADCAST_ROWS) -> DataFrame:
    """(grp, rank_no, item, score): each group's n best distinct items by score descending,
    then item ascending as a string; rank_no from 1.

    An item that repeats counts once with its highest score. Null, NaN and infinite scores
    and null groups and items don't count; -0.0 equals 0.0. Groups with fewer than n items
    keep them all; an empty table gives no rows; other columns don't matter.

    Every map task drops what lies below the floors before anything is shuffled. Floors are sent to the
    tasks: those of all groups or, of more than `floors_sent`, those of the largest ones. Any
    other group holds less than one in `floors_sent` of all rows; it is ranked as it is, and every map task
    passes on n of its rows."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    scored = best_scores(rows, group, item, score)
    scored = cut(scored.withColumn("score", F.col("score") + F.lit(0.0)).withColumn("bucket", score_bucket(F.col("score"))))
    floors = cut(score_floors(scored, n))
    if floors.count() > floors_sent:
        floors = floors.orderBy(F.desc("size"), "grp").limit(floors_sent)
    # at most floors_sent narrow rows
    kept = scored.join(F.broadcast(floors.select("grp", "floor")), "grp", "left").where(F.col("floor").isNull() | (F.col("bucket") >= F.col("floor")))
    survivors = kept.withColumn("salt", F.when(F.col("floor").isNull(), 0).otherwise(F.pmod(F.hash("item"), F.lit(SALTS))))
    best = [F.desc("score"), F.asc("item")]
    part = survivors.withColumn("_r", F.row_number().over(W.partitionBy("grp", "salt").orderBy(*best))).where(F.col("_r") <= n)
    ranked = part.withColumn("rank_no", F.row_number().over(W.partitionBy("grp").orderBy(*best))).where(F.col("rank_no") <= n)
    return ranked.select("grp", "rank_no", "item", "score")
