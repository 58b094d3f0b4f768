"""Sources (SRC*): typed scans of CSV, TSV, JSONL and Parquet, checked as they are read. Checks
run as aggregations; what a message quotes is a bounded sample."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.functions.text import unicode_key, unicode_text

#: The quartet of CSV files, by name. imdbId keeps its leading zeros.
CSV_SCHEMAS = {
    "movies": "movieId string, title string, genres string",
    "ratings": "userId string, movieId string, rating double, timestamp bigint",
    "tags": "userId string, movieId string, tag string, timestamp bigint",
    "links": "movieId string, imdbId string, tmdbId bigint",
}
DOCUMENT = "_id string, title string, text string, overview string, metadata struct<year:int,genres:array<string>,tags:array<string>,average_rating:double,rating_count:bigint,imdb_id:string,tmdb_id:bigint,source:string,cast:array<string>,directors:array<string>>"
QUERY = "_id string, text string, metadata struct<category:string,label_status:string,notes:string>"
RUN = "query_id string, latency_ms double, candidate_ids array<string>, results array<struct<doc_id:string,score:double>>"
UNCATEGORIZED = "uncategorized"


class DataError(ValueError):
    """Input that breaks a rule, with where it does."""


@dataclass(frozen=True)
class Dataset:
    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame


def read_csv(spark: SparkSession, path: str, name: str, null: str = "") -> DataFrame:
    """SRC8: one of the quartet with its fixed schema; fields that don't fit fail the read. null: how
    a null is written."""
    reader = spark.read.schema(CSV_SCHEMAS[name]).option("header", True).option("mode", "FAILFAST").option("escape", '"').option("multiLine", False).option("nullValue", null)
    return reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC1: one object per line, blank lines skipped. A line that isn't an object of the
    schema raises DataError and is quoted."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = parsed.where("r is null or r._bad is not null or not startswith(ltrim(value), '{')").select(F.left("value", F.lit(80)).alias("v")).limit(1).collect()
    if bad:
        raise DataError(f"{path}: not a JSON object of the schema: {bad[0].v}")
    return parsed.select("r.*").drop("_bad")


def _check_ids(df: DataFrame, column: str, what: str) -> DataFrame:
    """Trimmed ids, none empty, none twice."""
    out = df.withColumn(column, F.trim(column))
    if out.where(F.col(column).isNull() | (F.col(column) == "")).limit(1).count():
        raise DataError(f"a {what} has no id")
    twice = out.groupBy(column).count().where("count > 1").select(column).orderBy(column).limit(3).collect()
    if twice:
        raise DataError(f"{what} ids occur twice: " + ", ".join(r[0] for r in twice))
    return out


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC2."""
    return _check_ids(read_jsonl(spark, path, DOCUMENT), "_id", "document")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """SRC3/SRC20: the category is `uncategorized` where there is none."""
    q = _check_ids(read_jsonl(spark, path, QUERY), "_id", "query")
    return q.withColumn("category", F.coalesce("metadata.category", F.lit(UNCATEGORIZED)))


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: (query_id, doc_id, grade) of a TSV with the columns query-id, corpus-id and
    score; whole grades, no pair twice."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    missing = {"query-id", "corpus-id", "score"} - set(raw.columns)
    if missing:
        raise DataError(f"{path} lacks the columns " + ", ".join(sorted(missing)))
    rows = raw.select(F.trim("`query-id`").alias("query_id"), F.trim("`corpus-id`").alias("doc_id"), F.col("score").try_cast("int").alias("grade"))
    if rows.where("query_id is null or query_id = '' or doc_id is null or doc_id = '' or grade is null").limit(1).count():
        raise DataError(f"{path}: a judgment lacks an id or a whole grade")
    twice = rows.groupBy("query_id", "doc_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise DataError(f"{path}: ({twice[0].query_id}, {twice[0].doc_id}) is judged twice")
    return rows


def load_dataset_files(spark: SparkSession, corpus: str, queries: str, qrels: str) -> Dataset:
    """SRC6, with SRC12's checks."""
    ds = Dataset(load_documents(spark, corpus), load_queries(spark, queries), load_qrels(spark, qrels))
    check_dataset(ds)
    return ds


def load_dataset(spark: SparkSession, folder: str, split: str = "test") -> Dataset:
    """SRC5: corpus.jsonl, queries.jsonl and qrels/{split}.tsv."""
    return load_dataset_files(spark, f"{folder}/corpus.jsonl", f"{folder}/queries.jsonl", f"{folder}/qrels/{split}.tsv")


def check_dataset(ds: Dataset) -> None:
    """SRC12: tables that aren't empty, references that exist, and a positive grade for every
    judged query; messages name up to three ids."""
    from reelrank.operators.validation import violations

    for name in ("documents", "queries", "qrels"):
        if not getattr(ds, name).limit(1).count():
            raise DataError(f"the dataset has no {name}")
    found = violations(ds.documents.select(F.col("_id").alias("doc_id")), ds.queries.select(F.col("_id").alias("query_id")), ds.qrels).orderBy("rule").collect()  # at most one row per rule
    if found:
        raise DataError("; ".join(f"{r.rule}: {r.sample}" for r in found))


def load_run(spark: SparkSession, path: str) -> DataFrame:
    """SRC7/SRC21: ranked runs; finite scores, latencies of 0 and more, no document or
    candidate twice, every query once. A null list of candidates differs from an empty one."""
    run = _check_ids(read_jsonl(spark, path, RUN), "query_id", "run")
    docs = F.transform("results", lambda r: F.trim(r["doc_id"]))
    bad_score = F.exists("results", lambda r: r["score"].isNull() | F.isnan(r["score"]) | (F.abs(r["score"]) == F.lit(float("inf"))))
    rules = {
        "results are missing": F.col("results").isNull(),
        "a score isn't finite": bad_score,
        "a result has no document": F.exists(docs, lambda d: d.isNull() | (d == "")),
        "a document occurs twice": F.size(F.array_distinct(docs)) != F.size(docs),
        "a latency is negative or not finite": (F.col("latency_ms") < 0) | F.isnan("latency_ms") | (F.col("latency_ms") == F.lit(float("inf"))),
        "a candidate occurs twice": F.size(F.array_distinct("candidate_ids")) != F.size("candidate_ids"),
    }
    broken = run.select("query_id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("b")).where(F.size("b") > 0).orderBy("query_id").limit(1).collect()
    if broken:
        raise DataError(f"run of {broken[0].query_id}: {broken[0].b[0]}")
    return run


def first_readable(spark: SparkSession, paths: list[str]) -> str:
    """SRC16: the first of several paths that exists, on any file system Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError("none of these can be read: " + ", ".join(paths))


def count_lines(spark: SparkSession, path: str) -> int:
    """SRC19: lines that aren't blank."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).count()


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC18: (path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_manifest(manifest: dict, now: str, max_files: int = 64) -> None:
    """SRC17: a release manifest: schema version 1, an id, an expiry after `now` (ISO) and
    for every file its path, size and SHA-256."""
    if manifest.get("schemaVersion") != 1:
        raise DataError("unknown manifest version")
    if not re.fullmatch(r"[a-z0-9][a-z0-9._-]{2,79}", str(manifest.get("releaseId", ""))):
        raise DataError("the release has no valid id")
    if str(manifest.get("expiresAt", "")) <= now:
        raise DataError("the release has expired")
    files = manifest.get("files")
    if not isinstance(files, dict) or not 0 < len(files) <= max_files:
        raise DataError("the release lists no files")
    for name, f in files.items():
        if not f.get("pathname") or not re.fullmatch(r"[0-9a-f]{64}", str(f.get("sha256", ""))) or not isinstance(f.get("bytes"), int) or f["bytes"] < 1:
            raise DataError(f"file {name} lacks a path, size or digest")


def read_release(spark: SparkSession, folder: str, now: str, max_files: int = 64) -> tuple[dict, DataFrame]:
    """SRC17/SRC18: the checked manifest of a release and (path, is_whole): whether each of its files is
    there with the manifest's bytes and SHA-256."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    check_manifest(manifest, now, max_files)
    wanted = spark.createDataFrame([(f["pathname"], f["bytes"], f["sha256"]) for f in manifest["files"].values()], "path string, bytes bigint, sha256 string")  # at most max_files
    names = sorted({f["pathname"].split("/")[0] for f in manifest["files"].values()})
    there = file_digests(spark, [f"{folder}/{n}/part-*" for n in names]).select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    found = wanted.join(there, "path", "left")
    return manifest, found.select("path", F.coalesce((F.col("bytes") == F.col("b")) & (F.col("sha256") == F.col("s")), F.lit(False)).alias("is_whole"))


# --- enrichment


def project_enrichment(payload: DataFrame, cast: int = 12, keywords: int = 20) -> DataFrame:
    """SRC11: payload (_id, credits struct<cast, crew>, keywords struct<keywords>, overview,
    poster_path) -> (_id, cast, directors, keywords, overview, poster_path): the first `cast`
    actors, the crew whose job is Director, the first `keywords` keywords."""
    ids = lambda a: F.transform(a, lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name")))
    return payload.select("_id", ids(F.slice("credits.cast", 1, cast)).alias("cast"), ids(F.filter("credits.crew", lambda c: c["job"] == "Director")).alias("directors"), ids(F.slice("keywords.keywords", 1, keywords)).alias("keywords"), "overview", "poster_path")


def is_complete() -> Column:
    """SRC15, over project_enrichment's columns."""
    return F.col("cast").isNotNull() & F.col("directors").isNotNull() & F.col("keywords").isNotNull() & F.col("overview").isNotNull() & F.col("poster_path").isNotNull()


def pending(documents: DataFrame, cache: DataFrame, refresh: bool = False, limit: int | None = None) -> DataFrame:
    """SRC14: the ids still to be fetched, least first, at most `limit` of them."""
    ids = documents.select("_id").distinct()
    todo = ids if refresh else ids.join(cache.where(is_complete()).select("_id"), "_id", "left_anti")
    return todo.orderBy("_id").limit(limit) if limit is not None else todo


def merge_cache(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC13: the merged cache (new rows win, column by column the same) and one row of counts:
    updated, unchanged, kept, without_poster."""
    cols = [c for c in old.columns if c != "_id"]
    a = old.select("_id", F.struct(*cols).alias("_old"))
    b = new.select("_id", F.struct(*cols).alias("_new"))
    j = a.join(b, "_id", "full")
    counts = j.agg(F.count_if(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))).alias("updated"), F.count_if(F.col("_new").isNotNull() & F.col("_new").eqNullSafe(F.col("_old"))).alias("unchanged"), F.count_if(F.col("_new").isNull()).alias("kept"), F.count_if(F.coalesce("_new", "_old")["poster_path"].isNull()).alias("without_poster"))
    return j.select("_id", F.coalesce("_new", "_old").alias("r")).select("_id", "r.*"), counts


def movie_aliases(payload: DataFrame, countries: tuple[str, ...] = ("IN", "US", "GB"), languages: tuple[str, ...] = ("hi", "en")) -> DataFrame:
    """SRC22: payload (_id, original_title, original_language, translations array<struct<
    language, title>>, alternatives array<struct<country, title>>) -> (_id, pos, text, language,
    source), one row per Unicode key, the first in this order."""
    original = F.array(F.struct(F.col("original_title").alias("text"), F.coalesce("original_language", F.lit("und")).alias("language"), F.lit("original").alias("source")))
    translated = F.transform(F.filter("translations", lambda t: t["language"].isin(*languages)), lambda t: F.struct(t["title"].alias("text"), t["language"].alias("language"), F.lit("translation").alias("source")))
    others = F.transform(F.filter("alternatives", lambda t: t["country"].isin(*countries)), lambda t: F.struct(t["title"].alias("text"), F.lit("und").alias("language"), F.lit("alternative").alias("source")))
    empty = F.filter(original, lambda _: F.lit(False))
    rows = payload.select("_id", F.posexplode(F.concat(original, F.coalesce(translated, empty), F.coalesce(others, empty))).alias("pos", "a")).select("_id", "pos", "a.*").where("text is not null and trim(text) <> ''")
    keyed = rows.withColumn("n", unicode_text(F.col("text"))).withColumn("key", unicode_key(F.col("n"))).where("key <> ''")
    first = keyed.groupBy("_id", "key").agg(F.min_by(F.struct("pos", "text", "language", "source"), "pos").alias("f"))
    return first.select("_id", "f.*")


def import_aliases(old: DataFrame, fetched: DataFrame, processed: DataFrame, source: str) -> DataFrame:
    """ETL19: aliases (_id, text, source, ..) of other sources stay; those of `source` are
    replaced for the processed ids and stay for the rest."""
    keep = old.where(F.col("source") != source).unionByName(old.where(F.col("source") == source).join(processed.select("_id").distinct(), "_id", "left_anti"))
    return keep.unionByName(fetched.select(*old.columns))
