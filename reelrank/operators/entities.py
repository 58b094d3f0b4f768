"""Entity browsing and typeahead (FL6, FL9, SO8-SO10, SO12, QY4, QY5, JN13, JN14, JN16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.functions import text as tx


def page(entities: DataFrame, number: int, size: int, contains: str = "", role: str | None = None) -> DataFrame:
    """SO8/FL6/FL9: one page (from 1) of entities by movie count, then name and id, with the
    total and the number of pages on each row. The count is one aggregate, the page a
    bounded top-k: no full sort is gathered."""
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("pages start at 1 and hold 1 to 1000 entities")
    kept = entities
    if contains:
        kept = kept.where(F.contains(F.lower("name"), F.lit(contains.lower())))
    count = "movie_count"
    if role is not None:
        count = f"{role}_movie_count"
        kept = kept.where(F.array_contains("roles", role))
    total = kept.count()
    rows = kept.select("entity_id", "name", F.col(count).alias("movie_count")).orderBy(F.desc("movie_count"), "name", "entity_id").offset((number - 1) * size).limit(size)
    return rows.select("*", F.lit(total).cast("bigint").alias("total"), F.lit(-(-total // size)).cast("bigint").alias("pages"))


def related(edges: DataFrame, records: DataFrame, n: int = 20) -> DataFrame:
    """JN16/SO9: each entity's n most rated movies. edges: (entity_id, movie_id)."""
    j = edges.select("entity_id", F.col("movie_id").alias("id")).distinct().join(records.select("id", "title", "rating_count"), "id")
    ranked = j.withColumn("rank_no", F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("rating_count"), "title", "id")))
    return ranked.where(F.col("rank_no") <= n).select("entity_id", "rank_no", "id", "rating_count")


def in_every_group(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """JN13: (query_id, movie_id) of movies that have someone of every person group of the
    query. groups: (query_id, group_no, entity_id)."""
    wanted = groups.groupBy("query_id").agg(F.count_distinct("group_no").alias("n"))
    held = groups.join(edges.select("entity_id", "movie_id").distinct(), "entity_id").select("query_id", "group_no", "movie_id").distinct().groupBy("query_id", "movie_id").agg(F.count("*").alias("held"))
    return held.join(wanted, "query_id").where("held = n").select("query_id", "movie_id")


def person_movies(groups: DataFrame, people: DataFrame, credits: DataFrame, records: DataFrame) -> DataFrame:
    """JN14: (query_id, group_no, movie_id): the movies of each group's person. groups: (query_id,
    group_no, entity_id, role), a null role for any; people: (entity_id, name, movie_ids array);
    credits: (entity_id, role, movie_id); records: (id, cast, directors), arrays of names.

    People with credits have those of the role (and no others, even if there are none); people
    without have their movie_ids where no role is asked for; else they have the records that name
    them in the cast, for directors in the directors, for no such role in either."""
    bare = lambda c: F.regexp_replace(F.col(c).cast("string"), "^movie:movielens:", "")
    role = F.nullif(F.col("role"), F.lit(""))
    g = groups.select("query_id", "group_no", "entity_id", role.alias("role")).distinct()
    c = credits.where("movie_id is not null").select("entity_id", F.col("role").alias("as_role"), bare("movie_id").alias("movie_id")).distinct()
    own = g.join(c, "entity_id").where(F.col("role").isNull() | (F.col("role") == F.col("as_role"))).select("query_id", "group_no", "movie_id")
    rest = g.join(people, "entity_id").join(c.select("entity_id").distinct(), "entity_id", "left_anti")
    listed = F.col("role").isNull() & (F.coalesce(F.size("movie_ids"), F.lit(0)) > 0)
    by_list = rest.where(listed).select("query_id", "group_no", F.explode("movie_ids").alias("movie_id")).select("query_id", "group_no", bare("movie_id").alias("movie_id"))
    named = lambda field, kind: records.select(F.col("id").alias("movie_id"), F.lit(kind).alias("as_role"), F.explode(field).alias("name"))
    names = named("cast", "actor").unionByName(named("directors", "director"))
    any_role = F.col("role").isNull() | ~F.col("role").isin("actor", "director")
    by_name = rest.where(~listed).join(names, "name").where(any_role | (F.col("role") == F.col("as_role"))).select("query_id", "group_no", "movie_id")
    return own.unionByName(by_list).unionByName(by_name).distinct()


def typeahead(queries: DataFrame, entities: DataFrame, n: int = 6) -> DataFrame:
    """QY4/SO12: the n best names for each prefix: (query_id, rank_no, id, name, score). queries:
    (query_id, text); entities: (id, name, weight). A name that is the text scores 4, one that starts
    with it 3, one with a word that starts with it 2; texts shorter than two characters
    suggest nothing.

    Words are looked up by their first two characters (an equi-join), then checked."""
    n = max(1, min(12, n))
    q = queries.select("query_id", tx.exact_key(F.col("text")).alias("qk")).where(F.length("qk") >= 2).withColumn("k", F.left("qk", F.lit(2)))
    named = entities.select("id", "name", "weight", tx.exact_key(F.col("name")).alias("nk"))
    words = F.expr("transform(split(nk, ' '), (w, i) -> named_struct('rest', array_join(slice(split(nk, ' '), i + 1, size(split(nk, ' '))), ' '), 'at', i))")
    parts = named.withColumn("w", F.explode(words)).select("id", "name", "weight", "nk", "w.rest", "w.at").where(F.length("rest") >= 2).withColumn("k", F.left("rest", F.lit(2)))
    hit = q.join(parts, "k").where(F.startswith("rest", F.col("qk")))
    score = F.when(F.col("nk") == F.col("qk"), 4).when(F.col("at") == 0, 3).otherwise(2)
    best = hit.groupBy("query_id", "id", "name", "weight").agg(F.max(score).alias("score"))
    ranked = best.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("weight"), "name", "id")))
    return ranked.where(F.col("rank_no") <= n).select("query_id", "rank_no", "id", "name", "score")


def lookup(records: DataFrame, text: str, n: int = 12) -> DataFrame:
    """FL7/SO10: records with this id or with the text in their title: id matches first, then
    equal titles, prefixes, rating counts, titles."""
    key = tx.exact_key(F.col("title"))
    wanted = " ".join(text.lower().split())
    rows = records.where((F.col("id") == text.strip()) | F.contains(key, F.lit(wanted)))
    return rows.orderBy((F.col("id") == text.strip()).desc(), (key == wanted).desc(), F.startswith(key, F.lit(wanted)).desc(), F.desc("rating_count"), "title", "id").limit(n)

