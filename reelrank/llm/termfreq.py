"""Frequency of every distinct value or term (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_frequencies(counts: DataFrame, record: str, term: str, occurrences: str | None, n_records: int, min_records: int = 3, max_share: float = 0.1) -> DataFrame:
    """(term, n_occurrences, n_records, total_records, mark) for every distinct term.

    counts: rows (record, term) that may repeat, each with `occurrences` of the term (one
    where None). Counts per record and term are combined by hash before they are shuffled,
    then per term: no term or record, however frequent, is gathered anywhere. mark is `rare` below
    `min_records` records, `common` above `max_share` of n_records, else null. Rows with a
    null record or term don't count."""
    times = F.lit(1) if occurrences is None else F.col(occurrences)
    valid = counts.where(F.col(record).isNotNull() & F.col(term).isNotNull())
    per_record = valid.groupBy(F.col(record).alias("_record"), F.col(term).alias("term")).agg(F.sum(times).alias("_tf"))
    per_term = per_record.groupBy("term").agg(F.sum("_tf").alias("n_occurrences"), F.count("*").alias("n_records"))
    mark = F.when(F.col("n_records") < min_records, "rare").when(F.col("n_records") > F.lit(max_share) * F.lit(float(n_records)), "common")
    return per_term.select("term", "n_occurrences", "n_records", F.lit(n_records).cast("bigint").alias("total_records"), mark.alias("mark"))
