"""Percentiles of very large numeric columns (problem 6), by logarithmic buckets.

A value x > 0 falls into bucket ceil(log(x) / log(gamma)), a negative one into the mirror
image, and gamma = (1 + accuracy) / (1 - accuracy); so the middle of a bucket is within the relative
`accuracy` of every value in it. Counts of equal buckets add up: sketches of partitions,
days or months combine into the sketch of their union, exactly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 0.01
#: The ends of what a double holds: buckets reach from one to the other, so that only zero counts as zero.
SMALLEST, LARGEST = 5e-324, 1.7976931348623157e308
PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def _shift(accuracy: float) -> int:
    return 1 - math.ceil(math.log(SMALLEST) / math.log(gamma(accuracy)))


def bucket_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """A whole number that rises with the value: 0 for zero, positive and negative buckets on
    either side."""
    shift = _shift(accuracy)
    step = F.ceil(F.ln(F.abs(value)) / F.lit(math.log(gamma(accuracy)))) + shift
    step = F.greatest(step, F.lit(1))
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0)).cast("int")


def value_of(bucket: Column, accuracy: float = ACCURACY) -> Column:
    """The middle of a bucket: within `accuracy` of each of its values (of those below 2.3e-308
    within a step of a double)."""
    g, shift = gamma(accuracy), _shift(accuracy)
    size = F.exp((F.abs(bucket) - shift).cast("double") * F.lit(math.log(g))) * F.lit(2 / (g + 1))
    size = F.least(size, F.lit(LARGEST))
    return F.when(bucket > 0, size).when(bucket < 0, -size).otherwise(F.lit(0.0))


def sketch(rows: DataFrame, keys: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(*keys, bucket, n): the counts of values per bucket, combined before the shuffle.
    Null, NaN and infinite values don't count. Null keys are a group of their own."""
    v = F.col(value).cast("double")
    valid = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return valid.groupBy(*keys, bucket_of(v, accuracy).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of each union: counts of the same bucket add up over all other keys."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], at: tuple[float, ...] = PERCENTILES, accuracy: float = ACCURACY) -> DataFrame:
    """(*keys, n_values, p50, ...): for each key the value at rank ceil(p * n), to within
    the relative accuracy. A key's buckets are bounded (some 140,000 over the whole range of
    doubles at 1 %, in practice a few hundred), whatever the number of values."""
    names = ["p" + f"{round(p * 100, 4):g}".replace(".", "_") for p in at]
    w = W.partitionBy(*keys).orderBy("bucket") if keys else W.partitionBy(F.lit(0)).orderBy("bucket")
    total = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    run = sketches.withColumn("_reach", F.sum("n").over(w)).withColumn("_n", F.sum("n").over(total))
    picks = [value_of(F.min(F.when(F.col("_reach") >= F.ceil(F.lit(p) * F.col("_n")), F.col("bucket"))), accuracy).alias(name) for p, name in zip(at, names)]
    return run.groupBy(*keys).agg(F.first("_n").alias("n_values"), *picks)
