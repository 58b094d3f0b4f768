"""Integrity of a dataset (SRC12, JN5, ST3, FL14): every broken rule is a row of one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(documents: DataFrame, queries: DataFrame, judged: DataFrame, runs: DataFrame | None = None, samples: int = 3) -> DataFrame:
    """(rule, n, sample): for each broken rule the number of offending ids and the first
    `samples` of them. documents (doc_id), queries (query_id), judged (query_id, doc_id, grade),
    runs (query_id, doc_id).

    Rules: duplicate_document, duplicate_query, empty_document, empty_query, unknown_query,
    unknown_document, no_positive_grade, unknown_run_document. Samples are kept by a bounded
    aggregate of the distinct ids, never by collecting them."""
    docs, asked = documents.select("doc_id"), queries.select("query_id")
    found = [
        ("duplicate_document", docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("x"))),
        ("duplicate_query", asked.where("query_id is not null").groupBy("query_id").count().where("count > 1").select(F.col("query_id").alias("x"))),
        ("empty_document", docs.where("doc_id is null or trim(doc_id) = ''").select(F.coalesce("doc_id", F.lit("")).alias("x")).distinct()),
        ("empty_query", asked.where("query_id is null or trim(query_id) = ''").select(F.coalesce("query_id", F.lit("")).alias("x")).distinct()),
        ("unknown_query", judged.select("query_id").distinct().join(asked, "query_id", "left_anti").select(F.col("query_id").alias("x"))),
        ("unknown_document", judged.select("doc_id").distinct().join(docs, "doc_id", "left_anti").select(F.col("doc_id").alias("x"))),
        ("no_positive_grade", judged.groupBy("query_id").agg(F.max("grade").alias("g")).where("g <= 0").select(F.col("query_id").alias("x"))),
    ]
    if runs is not None:
        found.append(("unknown_run_document", runs.select("doc_id").where("doc_id is not null").distinct().join(docs, "doc_id", "left_anti").select(F.col("doc_id").alias("x"))))
    rows = None
    for rule, ids in found:
        one = ids.select(F.lit(rule).alias("rule"), "x")
        rows = one if rows is None else rows.unionByName(one)
    numbered = rows.groupBy("rule").agg(F.count("*").alias("n"), F.min("x").alias("sample"))
    if samples <= 1:
        return numbered
    from pyspark.sql import Window as W

    first = rows.withColumn("r", F.row_number().over(W.partitionBy("rule").orderBy("x"))).where(F.col("r") <= samples).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("samples"))
    return numbered.drop("sample").join(first, "rule").select("rule", "n", F.col("samples").alias("sample"))


def summary(documents: DataFrame, queries: DataFrame, judged: DataFrame) -> DataFrame:
    """AG13: one row of counts."""
    d = documents.agg(F.count("*").alias("documents"))
    q = queries.agg(F.count("*").alias("queries"))
    per = judged.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.expr("grade > 0")).alias("p"))
    j = per.agg(F.count("*").alias("judged_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("judgments"), F.coalesce(F.sum("p"), F.lit(0)).alias("positive_judgments"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(d).join(one(q), "_k").join(one(j), "_k").drop("_k")


def draft_violations(queries: DataFrame, judged: DataFrame, documents: DataFrame, max_queries: int = 500) -> DataFrame:
    """FL14: broken rules of a draft: (rule, n). queries (query_id, text, category), judged
    (query_id, doc_id, grade), documents (doc_id). Query ids read q and three digits or more, texts and
    categories aren't empty, grades are 0 to 3, pairs and ids are unique and refer to what exists."""
    rules = [
        ("bad_query_id", queries.where(~F.coalesce(F.col("query_id").rlike(r"^q\d{3,}\z"), F.lit(False)))),
        ("empty_text", queries.where("text is null or trim(text) = ''")),
        ("empty_category", queries.where("category is null or trim(category) = ''")),
        ("duplicate_query", queries.groupBy("query_id").count().where("count > 1")),
        ("bad_grade", judged.where("grade is null or grade not between 0 and 3")),
        ("duplicate_judgment", judged.groupBy("query_id", "doc_id").count().where("count > 1")),
        ("unknown_query", judged.join(queries.select("query_id"), "query_id", "left_anti")),
        ("unknown_document", judged.join(documents.select("doc_id"), "doc_id", "left_anti")),
        ("too_many_queries", queries.groupBy().count().where(F.col("count") > max_queries)),
    ]
    out = None
    for rule, rows in rules:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def next_query_id(queries: DataFrame) -> str:
    """AG30: one more than the largest number, three digits at least."""
    top = queries.agg(F.max(F.regexp_extract("query_id", r"^q(\d+)\z", 1).try_cast("bigint"))).first()[0] or 0
    return f"q{top + 1:03d}"


#: What a request may be.
LONGEST_QUERY, MOST_RESULTS, WEIGHT_TOP = 300, 9742, 100


def request_problems(requests: DataFrame) -> DataFrame:
    """FL13: (request_id, problem): the first rule that each search request breaks, null for none. requests:
    (request_id, query, result_limit, weights map<string,double>); null limits and weights are the defaults."""
    weights = F.map_values("weights")
    bad = F.exists(weights, lambda w: w.isNull() | F.isnan(w) | (w < 0) | (w > WEIGHT_TOP))
    nothing = (F.size(weights) > 0) & ~F.exists(weights, lambda w: w > 0)
    problem = (
        F.when(F.col("query").isNull() | (F.btrim("query") == "") | (F.length("query") > LONGEST_QUERY), "query")
        .when(bad, "weight")
        .when(nothing, "weights")
        .when(~F.coalesce("result_limit", F.lit(24)).between(1, MOST_RESULTS), "result_limit")
    )
    return requests.select("request_id", problem.alias("problem"))


def normalized_filters(filters: DataFrame) -> DataFrame:
    """FL2: genres unique and not empty in their order, the mode `all` or else `any`, bounds finite or null."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)).alias(c)
    genres = F.array_distinct(F.filter(F.coalesce("genres", F.array().cast("array<string>")), lambda g: g.isNotNull() & (g != "")))
    return filters.select("query_id", genres.alias("genres"), F.when(F.col("genre_mode") == "all", "all").otherwise("any").alias("genre_mode"), *[finite(c) for c in ("year_min", "year_max", "rating_min", "count_min")])


def film_cards(records: DataFrame, directors: int = 3, cast: int = 6) -> DataFrame:
    """FL10/FL12: what a film's card shows: no long columns, the first directors and actors."""
    return records.select("id", "title", "year", "genres", "average_rating", "rating_count", F.slice("directors", 1, directors).alias("directors"), F.slice("cast", 1, cast).alias("cast"))


def public_entities(people: DataFrame, role: str | None = None) -> DataFrame:
    """FL11: entities without their movies and credits; the count is that of the role, where one is asked for."""
    count = F.col("movie_count") if role is None else F.coalesce(F.col(f"{role}_movie_count"), F.col("movie_count"))
    return people.select("entity_id", "name", "roles", count.alias("movie_count"))


def registry_stats(people: DataFrame, members: dict[str, DataFrame]) -> DataFrame:
    """ETL17: (kind, entities, links): how many entities a registry has of each kind, and how many movies they link."""
    kinds = {"actor": people.where("actor_movie_count > 0").select(F.col("actor_movie_count").alias("n")), "director": people.where("director_movie_count > 0").select(F.col("director_movie_count").alias("n")), **{k: v.select(F.col("movie_count").alias("n")) for k, v in members.items()}}
    out = None
    for kind, rows in kinds.items():
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("links"))
        out = one if out is None else out.unionByName(one)
    return out
