"""Queries of problems 1 and 2 over the catalogue tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.operators.orphans import Reference, find_orphans
from reelrank.operators.packed import explode_packed
from reelrank.runtime import clean_key, table

NO_GENRES = "(no genres listed)"
#: The white space that ends of keys may carry, as an SQL expression.
SQL_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288))"


def sql_key(column: str) -> str:
    return f"nullif(trim({column}, {SQL_WS}), '')"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    movies = table(spark, folder, "movies").select(clean_key("movieId").alias("movie_id"), "genres").where("movie_id is not null")
    names = table(spark, folder, "genre_names").select("genre")
    rows = explode_packed(movies, "genres", ["movie_id"], names, [NO_GENRES], value="genre")
    return rows.distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    at = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    seconds = lambda name: F.floor(at(name) / 1_000_000)
    ratings, tags, judged = (table(spark, folder, t) for t in ("ratings", "tags", "provisional"))
    references = [
        Reference("ratings", "movieId", ratings, "movieId", "movie", F.col("timestamp")),
        Reference("tags", "movieId", tags, "movieId", "movie", F.col("timestamp")),
        Reference("provisional", "corpus-id", judged, "corpus-id", "movie", seconds("judged_at")),
        Reference("provisional", "query-id", judged, "query-id", "query", seconds("judged_at")),
    ]
    movies = table(spark, folder, "movies").select(F.lit("movie").alias("entity"), F.col("movieId").alias("key"))
    queries = table(spark, folder, "queries").select(F.lit("query").alias("entity"), F.col("_id").alias("key"))
    log = table(spark, folder, "catalog_log").select("entity", F.col("ref_key").alias("key"), "op", seconds("changed_at").alias("seconds"))
    return find_orphans(references, movies.unionByName(queries), log)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found}

ORACLE = {
    "p2_found": f"""
with log as (
  select distinct entity, {sql_key('ref_key')} k, op, floor(epoch(changed_at))::bigint sec from catalog_log where op in ('add', 'remove')
), parents as (
  select 'movie' entity, {sql_key('"movieId"')} k from movies union select 'query', {sql_key('"_id"')} from queries
), refs as (
  select distinct 'ratings' tbl, 'movieId' fld, 'movie' entity, {sql_key('"movieId"')} k, "timestamp" ts from ratings
  union all select distinct 'tags', 'movieId', 'movie', {sql_key('"movieId"')}, "timestamp" from tags
  union all select distinct 'provisional', 'corpus-id', 'movie', {sql_key('"corpus-id"')}, floor(epoch(judged_at))::bigint from provisional
  union all select distinct 'provisional', 'query-id', 'query', {sql_key('"query-id"')}, floor(epoch(judged_at))::bigint from provisional
), logged as (select entity, k, sec, max(op) op from log where k is not null group by all),
firsts as (select entity, k, min(sec) first_at from logged group by all),
state as (
  select r.*, f.first_at, l.op from (select * from refs where k is not null) r
  left join firsts f on f.entity = r.entity and f.k = r.k
  asof left join logged l on l.entity = r.entity and l.k = r.k and l.sec <= r.ts
)
select distinct tbl, fld, k as ref_key, strftime(make_timestamp(ts * 1000000), '%Y-%m') as period, reason from (
  select *, case
    when first_at is not null then case when ts < first_at then 'early' when op = 'remove' then 'removed' end
    when not exists (select 1 from parents p where p.entity = state.entity and p.k = state.k) then 'never' end as reason
  from state) where reason is not null
""",
}
