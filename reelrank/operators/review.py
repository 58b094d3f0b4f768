"""Judgment pools and reviews (AG19, AG20, AG25, SO13, WN7-WN10, JN18, JN19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.operators.corpus import keep_last, ranked_within
from reelrank.runtime import fresh_name, quoted

#: Fixed values of pooling.
STRATEGY_DEPTH, POOL_SIZE, SOURCES = 10, 40, 4


def nominate(lists: DataFrame, depth: int = STRATEGY_DEPTH) -> DataFrame:
    """WN8: lists (query_id, source, source_no, doc_id, score) -> each source's first `depth`
    documents of each query, with `rank`."""
    return ranked_within(lists, ["query_id", "source"], [F.desc("score"), F.asc("doc_id")], depth, "rank")


def interleave(nominations: DataFrame, size: int = POOL_SIZE, sources: int = SOURCES) -> DataFrame:
    """SO13/WN9: (query_id, place, doc_id, n_sources): round robin over ranks, at one rank
    by source number; each document at its first turn, the first `size` of a query."""
    first = nominations.groupBy("query_id", "doc_id").agg(F.min(F.col("rank") * sources + F.col("source_no")).alias("turn"), F.count_distinct("source").alias("n_sources"))
    placed = first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("turn", "doc_id"))).where(F.col("place") <= size)
    return placed.select("query_id", "place", "doc_id", "n_sources")


def latest_reviews(events: DataFrame) -> DataFrame:
    """WN7/QY9: the last review of each (query, document, reviewer) of an append-only table
    (query_id, doc_id, reviewer_id, grade, reviewed_at); of one instant the higher grade."""
    return keep_last(events, ["query_id", "doc_id", "reviewer_id"], ["reviewed_at", "grade"])


def judgment_status(reviews: DataFrame, adjudications: DataFrame | None = None) -> DataFrame:
    """AG20/JN18: (query_id, doc_id, n_reviews, is_conflict, final_grade). Grades that differ
    by 2 or more conflict. The adjudicated grade is final, else the rounded mean of at least
    two reviews without conflict, else null."""
    s = reviews.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_reviews"), F.max("grade").alias("hi"), F.min("grade").alias("lo"), F.sum("grade").alias("sum"))
    conflict = (F.col("n_reviews") >= 2) & ((F.col("hi") - F.col("lo") >= 2) | ((F.col("hi") == 3) & (F.col("lo") <= 1)))
    s = s.withColumn("is_conflict", conflict)
    if adjudications is not None:
        s = s.join(adjudications.select("query_id", "doc_id", F.col("final_grade").alias("_adj")), ["query_id", "doc_id"], "left")
    else:
        s = s.withColumn("_adj", F.lit(None).cast("int"))
    mean = F.floor(F.col("sum") / F.col("n_reviews") + 0.5).cast("int")
    final = F.coalesce("_adj", F.when((F.col("n_reviews") >= 2) & ~F.col("is_conflict"), mean))
    return s.select("query_id", "doc_id", "n_reviews", "is_conflict", final.cast("int").alias("final_grade"))


def progress(pool: DataFrame, status: DataFrame) -> DataFrame:
    """AG19: (query_id, pool_size, twice_reviewed, conflicts, finalized) over the pool's
    documents (query_id, doc_id)."""
    j = pool.select("query_id", "doc_id").join(status, ["query_id", "doc_id"], "left")
    return j.groupBy("query_id").agg(F.count("*").alias("pool_size"), F.count_if(F.coalesce("n_reviews", F.lit(0)) >= 2).alias("twice_reviewed"), F.count_if(F.coalesce("is_conflict", F.lit(False)) & F.col("final_grade").isNull()).alias("conflicts"), F.count_if(F.col("final_grade").isNotNull()).alias("finalized"))


def outside_pool(results: DataFrame, pool: DataFrame, depth: int = 10) -> DataFrame:
    """JN19: current results (query_id, doc_id, rank) down to `depth` that the pool lacks."""
    return results.where(F.col("rank") <= depth).join(pool.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def audit(reviews: DataFrame, adjudications: DataFrame) -> DataFrame:
    """ST6: one typed trail of both."""
    a = reviews.select(F.lit("review").alias("kind"), "*")
    return a.unionByName(adjudications.select(F.lit("adjudication").alias("kind"), "*"), allowMissingColumns=True)


def judged_metrics(lists: DataFrame, k: int = 10) -> DataFrame:
    """AG25: lists (query_id, rank, grade) of judged results -> ndcg over the returned
    documents only, precision at 5 (of those returned), top1 and zero_relevant."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = lists.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "rank")))
    per = ideal.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("i") <= k, gain / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("best"),
        F.count_if((F.col("rank") <= 5) & (F.col("grade") >= 2)).alias("good5"), F.count_if(F.col("rank") <= 5).alias("n5"), F.max(F.when(F.col("rank") == 1, F.col("grade") >= 2)).alias("top1_relevant"), F.max("grade").alias("top"),
    )
    return per.select("query_id", F.coalesce(F.try_divide("dcg", "best"), F.lit(0.0)).alias("ndcg"), F.try_divide("good5", "n5").alias("precision_5"), "top1_relevant", (F.col("top") < 2).alias("zero_relevant"))


def agreement(judged: DataFrame) -> DataFrame:
    """AG26: judged (item_id, rep, grade, gold) -> one row: agreement, recall and specificity
    at grade 2 and the share of items whose grade changes between repetitions."""
    good, gold = F.col("grade") >= 2, F.col("gold") >= 2
    a = judged.agg(F.avg((good == gold).cast("double")).alias("agreement"), F.avg(F.when(gold, good.cast("double"))).alias("recall"), F.avg(F.when(~gold, (~good).cast("double"))).alias("specificity"))
    b = judged.groupBy("item_id").agg((F.min("grade") != F.max("grade")).cast("double").alias("moved")).agg(F.avg("moved").alias("instability"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def calibration_sample(negatives: DataFrame, item: str, seed: str, every: int = 4) -> DataFrame:
    """QY15/TX31: the first and then every fourth row of the order by SHA-256 of seed and item.
    Items must be distinct; rows without one are left out. No task sees the whole order: rows are
    numbered within the ranges of the hash's three leading digits, after those of earlier ranges."""
    h, r, p, n = (fresh_name(negatives, x) for x in ("_hash", "_range", "_place", "_before"))
    rows = negatives.where(F.col(item).isNotNull()).withColumn(h, tx.shuffle_key(seed, F.col(item))).withColumn(r, F.left(h, F.lit(3)))
    sizes = rows.groupBy(r).agg(F.count("*").alias(p))
    before = F.coalesce(F.sum(p).over(W.orderBy(r).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn(p, F.row_number().over(W.partitionBy(r).orderBy(h, item)))
    starts = F.broadcast(sizes.select(r, before.alias(n)))  # at most 4,096 ranges
    return placed.join(starts, r).where((F.col(n) + F.col(p) - 1) % every == 0).select(*[quoted(c) for c in negatives.columns])


def hash_sample(rows: DataFrame, item: str, seed: str, every: int = 4) -> DataFrame:
    """About every fourth row: those whose SHA-256 of seed and item has leading digits divisible
    by four. Whether a row is taken depends on its item alone."""
    h = F.conv(F.left(tx.shuffle_key(seed, F.col(item)), F.lit(8)), 16, 10).cast("bigint")
    return rows.where(h % every == 0)


#: Words of a query that no text bears witness to.
REVIEW_STOP_WORDS = ["movie", "movies", "film", "films", "classic", "indie", "quirky", "epic"]
#: Weights of genre_quality and text_evidence.
QUALITY_WEIGHTS = (0.55, 0.3, 0.15)
TEXT_WEIGHT, GENRE_WEIGHT = 0.6, 0.4
POOL_SOURCES = ["existing", "production", "baseline", "genre_quality", "text_evidence"]


def genre_nominations(requests: DataFrame, records: DataFrame, depth: int = STRATEGY_DEPTH) -> DataFrame:
    """QY8: (query_id, source, doc_id, rank): the first records by genre_quality (all genres held, by
    focus, Bayesian rating and evidence) and by text_evidence (some genre held, by the share of the
    query's words that tags and overview hold and the share of genres). requests: (query_id, text,
    genres); records with rating evidence, tags and, where there is one, an overview.

    Quality depends on the wanted genres alone, so every different list of genres is ranked once."""
    from reelrank.operators.ranking import genre_focus, numeric_order

    tie = numeric_order(F.col("id"))
    held = records.withColumn("_g", F.explode(F.array_distinct("genres")))
    asked = requests.where(F.size("genres") > 0).withColumn("wanted", F.array_sort(F.array_distinct("genres")))
    lists = asked.select("wanted").distinct()
    focus = genre_focus(F.col("wanted"), F.col("genres"))[1]
    a, b, c = QUALITY_WEIGHTS
    quality = tx.fixed(focus * a + F.col("bayesian_rating") / 5 * b + F.col("rating_evidence") * c, 6)
    strict = lists.withColumn("_g", F.get("wanted", F.lit(0))).join(held, "_g").where(F.size(F.array_except("wanted", "genres")) == 0).withColumn("score", quality)
    by_quality = ranked_within(strict, ["wanted"], [F.desc("score"), *tie], depth, "rank").select("wanted", F.col("id").alias("doc_id"), "rank")
    stop = F.array(*map(F.lit, REVIEW_STOP_WORDS))
    overview = F.col("overview") if "overview" in records.columns else F.lit("")
    told = held.select("_g", "id", "genres", tx.exact_key(F.concat_ws(" ", F.array_join("tags", " "), overview)).alias("told"))
    pairs = asked.select("query_id", "wanted", F.array_except(tx.query_tokens(F.col("text")), stop).alias("terms"), F.explode("wanted").alias("_g")).join(told, "_g").drop("_g").dropDuplicates(["query_id", "id"])
    found = F.size(F.filter("terms", lambda t: F.contains("told", t)))
    score = F.coalesce(F.try_divide(found.cast("double"), F.size("terms")), F.lit(0.0)) * TEXT_WEIGHT + F.size(F.array_intersect("wanted", "genres")) / F.size("wanted") * GENRE_WEIGHT
    by_text = ranked_within(pairs.withColumn("score", tx.fixed(score, 6)).where("score > 0"), ["query_id"], [F.desc("score"), *tie], depth, "rank").select("query_id", F.lit("text_evidence").alias("source"), F.col("id").alias("doc_id"), "rank")
    return asked.select("query_id", "wanted").join(by_quality, "wanted").select("query_id", F.lit("genre_quality").alias("source"), "doc_id", "rank").unionByName(by_text)


def review_pool(nominations: DataFrame, depth: int = STRATEGY_DEPTH, size: int = POOL_SIZE) -> DataFrame:
    """QY8: (query_id, place, doc_id, n_sources): existing judgments first, all of them, then round robin over
    the ranks of the other strategies down to `depth`; `size` documents a query. nominations: (query_id,
    source of POOL_SOURCES, doc_id, rank from 1)."""
    no = F.create_map(*[x for i, s in enumerate(POOL_SOURCES) for x in (F.lit(s), F.lit(i))])[F.col("source")]
    existing = F.col("source") == POOL_SOURCES[0]
    kept = nominations.where(existing | (F.col("rank") <= depth)).withColumn("turn", F.when(existing, F.col("rank")).otherwise((1 << 30) + F.col("rank") * len(POOL_SOURCES) + no))
    first = kept.groupBy("query_id", "doc_id").agg(F.min("turn").alias("turn"), F.count_distinct(F.when(F.col("rank") <= depth, F.col("source"))).alias("n_sources"))
    return ranked_within(first, ["query_id"], ["turn", "doc_id"], size, "place").select("query_id", "place", "doc_id", "n_sources")


def publication_readiness(results: DataFrame, pool: DataFrame, status: DataFrame, depth: int = 10, least: int = 20) -> DataFrame:
    """QY10/JN19: (query_id, top_count, in_pool, finalized, action, is_ready, pool_complete) of every query
    with results (query_id, doc_id, rank). The pool of a query is complete with `least` documents or
    more, all reviewed twice and final; what is missing from the pool comes before what awaits reviews."""
    top = results.where(F.col("rank") <= depth).select("query_id", "doc_id").distinct()
    held = top.join(pool.select("query_id", "doc_id", F.lit(1).alias("_in")), ["query_id", "doc_id"], "left").join(status.select("query_id", "doc_id", "final_grade"), ["query_id", "doc_id"], "left")
    per = held.groupBy("query_id").agg(F.count("*").alias("top_count"), F.count("_in").alias("in_pool"), F.count_if(F.col("_in").isNotNull() & F.col("final_grade").isNotNull()).alias("finalized"))
    done = progress(pool, status).select("query_id", ((F.col("pool_size") >= least) & (F.col("twice_reviewed") == F.col("pool_size")) & (F.col("conflicts") == 0) & (F.col("finalized") == F.col("pool_size"))).alias("pool_complete"))
    action = F.when(F.col("in_pool") < F.col("top_count"), "expand_pool").when(F.col("finalized") < F.col("in_pool"), "complete_reviews").otherwise("none")
    return per.join(done, "query_id", "left").select("query_id", "top_count", "in_pool", "finalized", action.alias("action"), (action == "none").alias("is_ready"), F.coalesce("pool_complete", F.lit(False)).alias("pool_complete"))


def judged_titles(judged: DataFrame, records: DataFrame) -> DataFrame:
    """JN17: judgments (query_id, doc_id, grade) with title and year of the record; one that the catalogue
    lacks goes by its id."""
    r = records.select(F.col("id").alias("doc_id"), "title", "year")
    return judged.join(r, "doc_id", "left").select("query_id", "doc_id", "grade", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Film "), "doc_id")).alias("title"), "year")


def review_problems(events: DataFrame, pool: DataFrame) -> DataFrame:
    """QY9: (query_id, doc_id, reviewer_id, problem) of reviews that can't be taken: the first rule each breaks."""
    known = events.join(pool.select("query_id", "doc_id").distinct().withColumn("_in", F.lit(True)), ["query_id", "doc_id"], "left")
    who = F.length(F.btrim(F.coalesce("reviewer_id", F.lit(""))))
    problem = F.when(F.col("_in").isNull(), "not_in_pool").when(~who.between(1, 80), "bad_reviewer").when(F.col("grade").isNull() | ~F.col("grade").between(0, 3), "bad_grade")
    if "notes" in events.columns:
        problem = F.coalesce(problem, F.when(F.length(F.btrim("notes")) > 500, "long_notes"))
    return known.select("query_id", "doc_id", "reviewer_id", problem.alias("problem")).where("problem is not null")
