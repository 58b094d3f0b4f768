"""The keep-last table of reviews and the percentile sketches as streams: beyond what a
batch needs, for tables that grow by appending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_events(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Events without repetitions that arrive within `late`; state older than that is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(events: DataFrame, time: str, width: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Counts per window and keys, final once the watermark has passed the window."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
