"""Sinks (SNK*). Spark's commit protocol makes writes atomic: readers see a folder with a
success mark or none."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.functions.text import tsv_cell
from reelrank.sources.readers import file_digests


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """SNK1/SNK2/SNK3: one object per line, nulls left out."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_release(tables: dict[str, DataFrame], folder: str, release_id: str, expires_at: str) -> dict:
    """SNK8: each table gzipped under its name, never over something that is there; then, last, so that
    readers see a whole release or none, manifest.json with every part's path, bytes and SHA-256."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", "gzip").json(f"{folder}/{name}")
    files = {}
    for name in tables:
        for r in sorted(file_digests(spark, f"{folder}/{name}/part-*").collect()):  # one row a part
            files[f"{name}/{r.path.rsplit('/', 1)[1]}"] = {"pathname": f"{name}/{r.path.rsplit('/', 1)[1]}", "bytes": r.bytes, "sha256": r.sha256}
    manifest = {"schemaVersion": 1, "releaseId": release_id, "expiresAt": expires_at, "files": files}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")
    return manifest


def write_tsv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """SNK5: tabs and line breaks in cells become spaces; header in every part."""
    cells = [tsv_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]
    df.select(*cells).write.mode("overwrite" if overwrite else "errorifexists").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def draft_lines(queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK6: (value) of the queries as JSON and of the judgments as TSV rows."""
    q = queries.select(F.to_json(F.struct("_id", "text", "metadata")).alias("value"))
    r = qrels.select(F.concat_ws("\t", "query_id", "doc_id", F.col("grade").cast("string")).alias("value"))
    return q, r


def reviewed_split(queries: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK7: queries whose documents all have a final grade, and their judgments."""
    done = status.groupBy("query_id").agg(F.min(F.col("final_grade").isNotNull().cast("int")).alias("ok")).where("ok = 1").select("query_id")
    return queries.join(done, "query_id", "left_semi"), status.join(done, "query_id", "left_semi").select("query_id", "doc_id", F.col("final_grade").alias("grade"))


def report_json(report: DataFrame) -> str:
    """SNK4: a one-row report as JSON."""
    row = report.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a report is one row")
    return json.dumps(row[0].asDict(True), sort_keys=True, default=str)


def report_markdown(report: DataFrame, title: str) -> str:
    """SNK9: a small table (at most 100 rows) as Markdown."""
    rows = report.limit(100).collect()
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(report.columns) + " |\n|" + " --- |" * len(report.columns)
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join(show(v) for v in r) + " |" for r in rows) + "\n"


def case_workbook(cases: DataFrame) -> DataFrame:
    """SNK10: cases (category, status) counted by both, with totals, in one pass."""
    return cases.cube("category", "status").agg(F.count("*").alias("n"))
