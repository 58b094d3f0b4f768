"""Relevance evaluation (AG*, JN4, WN1, WN2): qrels and runs in long form, per-query metrics by
one aggregation, reports over them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.runtime import clean_key

METRICS = ["candidate_recall", "precision_at_k", "recall_at_k", "recall_at_recall_k", "reciprocal_rank", "ndcg_at_k", "candidate_recall_grade_2", "precision_at_k_grade_2", "recall_at_k_grade_2", "recall_at_recall_k_grade_2", "reciprocal_rank_grade_2", "judged_at_k"]


def qrels(rows: DataFrame, query: str = "query-id", doc: str = "corpus-id", grade: str = "score") -> DataFrame:
    """(query_id, doc_id, grade): one row per judged pair, the highest grade of repeated
    judgments. Grades that are null or negative and null or blank keys don't count."""
    valid = rows.select(clean_key(F.col(f"`{query}`")).alias("query_id"), clean_key(F.col(f"`{doc}`")).alias("doc_id"), F.col(grade).cast("int").alias("grade")).where("query_id is not null and doc_id is not null and grade >= 0")
    return valid.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def latest_runs(rows: DataFrame) -> DataFrame:
    """(query_id, latency_ms, candidate_ids, results): each query's last run. Of runs at one
    time the one with more results stands, then the lower latency."""
    valid = rows.select(clean_key("query_id").alias("query_id"), "latency_ms", "candidate_ids", "results", "run_at").where("query_id is not null")
    order = F.struct("run_at", F.size(F.coalesce("results", F.array().cast(rows.schema["results"].dataType))), -F.coalesce(F.nanvl("latency_ms", F.lit(None)), F.lit(1e18)), F.xxhash64("candidate_ids", "results"))
    return valid.groupBy("query_id").agg(F.max_by(F.struct("latency_ms", "candidate_ids", "results"), order).alias("r")).select("query_id", "r.*")


def ranked(runs: DataFrame) -> DataFrame:
    """WN1: (query_id, doc_id, rank): the list in its order, the first place of each
    document."""
    pos = runs.select("query_id", F.posexplode("results").alias("p", "r")).select("query_id", clean_key(F.col("r.doc_id")).alias("doc_id"), "p").where("doc_id is not null")
    first = pos.groupBy("query_id", "doc_id").agg(F.min("p").alias("p"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("p"))).drop("p")


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2((rank + 1).cast("double"))


def evaluate(judged: DataFrame, runs: DataFrame, k: int = 10, recall_k: int = 100, categories: DataFrame | None = None) -> DataFrame:
    """AG1-AG8: one row per judged query with every metric.

    judged: (query_id, doc_id, grade); runs: (query_id, latency_ms, candidate_ids array,
    results array<struct<doc_id, ...>>), one row per query; categories: (query_id, category).
    Runs without judgments are left out, judged queries without a run score as empty and count
    as missing. candidate_recall is null where a run has no candidates at all (null), as
    are latencies. Relevant is a grade above 0, strongly relevant one of 2 and more; a result
    without a judgment has grade 0."""
    if k < 1 or recall_k < 1:
        raise ValueError("metric cutoffs must be positive integers")
    ideal = judged.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    base = ideal.groupBy("query_id").agg(
        F.count_if(F.expr("grade > 0")).alias("relevant"), F.count_if(F.expr("grade >= 2")).alias("strong"), F.sum(F.when(F.col("i") <= k, _gain(F.col("grade"), F.col("i"))).otherwise(0.0)).alias("ideal")
    )
    lists = ranked(runs).join(judged.select("query_id").distinct(), "query_id", "left_semi").join(judged, ["query_id", "doc_id"], "left")
    hit = lambda cut, g: F.count_if((F.col("rank") <= cut) & (F.col("grade") >= g))
    first = lambda g: F.min(F.when(F.col("grade") >= g, F.col("rank")))
    per = lists.groupBy("query_id").agg(
        F.count("*").alias("retrieved"), hit(k, 1).alias("hits"), hit(recall_k, 1).alias("deep"), hit(k, 2).alias("hits2"), hit(recall_k, 2).alias("deep2"),
        first(1).alias("first1"), first(2).alias("first_grade_2_rank"), first(3).alias("first_grade_3_rank"),
        F.count_if((F.col("rank") <= k) & F.col("grade").isNotNull()).alias("judged_k"), F.sum(F.when(F.col("rank") <= k, _gain(F.coalesce("grade", F.lit(0)), F.col("rank"))).otherwise(0.0)).alias("actual"),
    )
    nominated = runs.select("query_id", F.explode("candidate_ids").alias("c")).select("query_id", clean_key("c").alias("doc_id")).where("doc_id is not null").distinct()
    held = judged.join(nominated, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count_if(F.expr("grade > 0")).alias("c1"), F.count_if(F.expr("grade >= 2")).alias("c2"))
    seen = runs.select("query_id", F.when(~F.isnan("latency_ms"), F.col("latency_ms")).alias("latency_ms"), F.col("candidate_ids").isNotNull().alias("has_candidates"), F.lit(True).alias("has_run"))
    j = base.join(per, "query_id", "left").join(held, "query_id", "left").join(seen, "query_id", "left")
    if categories is not None:
        j = j.join(categories.select("query_id", F.col("category").alias("_category")), "query_id", "left")
    else:
        j = j.withColumn("_category", F.lit(None).cast("string"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    part = lambda a, b: F.coalesce(F.try_divide(n(a), F.col(b)), F.lit(0.0))
    returned = F.least(F.coalesce("retrieved", F.lit(0)), F.lit(k))
    return j.select(
        "query_id", F.coalesce("_category", F.lit("uncategorized")).alias("category"),
        F.when(F.col("has_candidates"), part("c1", "relevant")).alias("candidate_recall"),
        (n("hits") / k).alias("precision_at_k"), part("hits", "relevant").alias("recall_at_k"), part("deep", "relevant").alias("recall_at_recall_k"),
        F.coalesce(F.lit(1.0) / F.col("first1"), F.lit(0.0)).alias("reciprocal_rank"), part("actual", "ideal").alias("ndcg_at_k"),
        F.when(F.col("has_candidates"), part("c2", "strong")).alias("candidate_recall_grade_2"),
        (n("hits2") / k).alias("precision_at_k_grade_2"), part("hits2", "strong").alias("recall_at_k_grade_2"), part("deep2", "strong").alias("recall_at_recall_k_grade_2"),
        F.coalesce(F.lit(1.0) / F.col("first_grade_2_rank"), F.lit(0.0)).alias("reciprocal_rank_grade_2"),
        F.coalesce(F.try_divide(n("judged_k"), returned), F.lit(0.0)).alias("judged_at_k"),
        "first_grade_3_rank", "first_grade_2_rank", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), "relevant", "latency_ms", F.col("has_run").isNull().alias("is_missing"),
    )


def nearest_rank(value: str, p: float) -> Column:
    """AG11: the value at rank ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def median(value: str) -> Column:
    """AG12: the middle value; of an even number the mean of the middle two, to 3 decimals."""
    middle = F.percentile(F.col(value).cast("double"), 0.5)
    return F.when(F.count(value) % 2 == 1, middle).otherwise(tx.fixed(middle, 3))


def summarize(per_query: DataFrame) -> DataFrame:
    """AG8/AG10: the report over all judged queries, one row."""
    means = [F.avg(m).alias({"reciprocal_rank": "mrr", "reciprocal_rank_grade_2": "mrr_grade_2"}.get(m, m)) for m in METRICS]
    return per_query.agg(F.count("*").alias("evaluated_queries"), *means, F.min("judged_at_k").alias("minimum_judged_at_k"), F.avg("latency_ms").alias("mean_latency_ms"), nearest_rank("latency_ms", 0.5).alias("p50_latency_ms"), nearest_rank("latency_ms", 0.95).alias("p95_latency_ms"), F.count_if("is_missing").alias("missing_queries"))


def by_category(per_query: DataFrame) -> DataFrame:
    """AG9."""
    return per_query.groupBy("category").agg(F.count("*").alias("queries"), *[F.avg(m).alias(a) for m, a in (("ndcg_at_k", "ndcg_at_k"), ("precision_at_k_grade_2", "precision_at_k_grade_2"), ("recall_at_k_grade_2", "recall_at_k_grade_2"), ("reciprocal_rank_grade_2", "mrr_grade_2"), ("judged_at_k", "judged_at_k"))])


def grouping_report(rows: DataFrame, dims: list[str], aggs: list[Column]) -> DataFrame:
    """AG22: overall and by each dimension in one pass: GROUPING SETS ((), (a), (b))."""
    sets = [[]] + [[F.col(d)] for d in dims]
    return rows.groupingSets(sets, *[F.col(d) for d in dims]).agg(F.grouping_id().alias("grouping_id"), *aggs)


def case_rates(trials: DataFrame, case: str, passed: str) -> DataFrame:
    """AG21: one row: the mean over cases of their share of passed trials, the sample
    deviation, its 95 % interval within 0 to 1 and the number of cases that passed sometimes."""
    per = trials.groupBy(case).agg(F.avg(F.col(passed).cast("double")).alias("rate"), F.count("*").alias("trials"))
    half = F.lit(1.96) * F.coalesce(F.stddev_samp("rate"), F.lit(0.0)) / F.sqrt(F.count("*").cast("double"))
    return per.agg(F.count("*").alias("cases"), F.sum("trials").alias("trials"), F.avg("rate").alias("pass_rate"), F.stddev_samp("rate").alias("deviation"), F.greatest(F.lit(0.0), F.avg("rate") - half).alias("low"), F.least(F.lit(1.0), F.avg("rate") + half).alias("high"), F.count_if(F.expr("rate > 0 and rate < 1")).alias("flaky"))


#: The filters that a case compares.
CASE_FILTERS = ["year_min", "year_max", "rating_min", "count_min"]


def assess_cases(cases: DataFrame, live: bool = False) -> DataFrame:
    """AG24: one row per case: (case_id, checks map, failed_checks, passed, recall, precision,
    mrr, ndcg10).

    cases: (case_id, expected, actual), both structs with `ids` (the results in order), title_ids,
    genres (arrays), genre_mode, year_min, year_max, rating_min, count_min, sort_field,
    sort_direction and blocked. expected has also people (ids), roles (map of id to role), ordered,
    unresolved_kind, fast_path and local_mode; actual has people (structs of id and role),
    unavailable (array) and mode. Sets compare without order, null equals null, a null array is
    empty. Relevance is binary; metrics without relevant documents are null (precision only
    where nothing was returned either)."""
    names = {side: {f.name: f.dataType.simpleString() for f in cases.schema[side].dataType.fields} for side in ("expected", "actual")}
    items = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.array().cast(names[side][c]))
    e, a = (lambda c: F.col(f"expected.{c}")), (lambda c: F.col(f"actual.{c}"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    same = lambda c: F.array_sort(items("expected", c)) == F.array_sort(items("actual", c))
    both = lambda cols: reduce(lambda x, y: x & y, [e(c).eqNullSafe(a(c)) for c in cols])
    people = items("actual", "people")
    roles = F.coalesce(F.map_entries(e("roles")), F.array().cast("array<struct<key:string,value:string>>"))
    held = lambda r: F.get(F.filter(people, lambda p: p["id"] == r["key"]), F.lit(0))["role"]
    kind, missing = e("unresolved_kind"), items("actual", "unavailable")
    resolved = F.when(kind == "explicit", F.size(missing) > 0).when(kind != "", F.exists(missing, lambda m: F.startswith(m, kind))).otherwise(F.size(missing) == 0)
    ordered = items("expected", "ids") == items("actual", "ids")
    checks = {
        "execution": yes(a("mode") == F.when(yes(e("fast_path")), F.coalesce(e("local_mode"), F.lit("exact_alias"))).otherwise("model")) if live else F.lit(True),
        "people": F.array_sort(items("expected", "people")) == F.array_sort(F.transform(people, lambda p: p["id"])),
        "roles": F.forall(roles, lambda r: yes(held(r) == r["value"])),
        "title": same("title_ids"),
        "genres": same("genres"),
        "genre_mode": (F.size(items("expected", "genres")) < 2) | e("genre_mode").eqNullSafe(a("genre_mode")),
        "filters": both(CASE_FILTERS),
        "sort": both(["sort_field", "sort_direction"]),
        "blocked": e("blocked").eqNullSafe(a("blocked")),
        "unresolved": yes(resolved),
        "results": same("ids"),
        "order": ~yes(e("ordered")) | ordered,
    }
    c = cases.select("case_id", F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), v)]).alias("checks"), items("expected", "ids").alias("_want"), items("actual", "ids").alias("_got"))
    c = c.withColumn("_hit", F.transform("_got", lambda d: F.array_contains("_want", d).cast("double")))
    gain = lambda xs: F.aggregate(F.transform(F.slice(xs, 1, 10), lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    n, hits, first = F.size("_want"), F.aggregate("_hit", F.lit(0.0), lambda s, x: s + x), F.array_position("_hit", 1.0)
    return c.select(
        "case_id", "checks", F.filter(F.map_keys("checks"), lambda k: ~F.col("checks")[k]).alias("failed_checks"), F.forall(F.map_values("checks"), lambda v: v).alias("passed"),
        F.when(n > 0, hits / F.size(F.array_distinct("_want"))).alias("recall"),
        F.when(F.size("_got") > 0, F.try_divide(hits, F.size("_got"))).when(n > 0, 0.0).alias("precision"),
        F.when(n > 0, F.when(first > 0, F.try_divide(F.lit(1.0), first)).otherwise(0.0)).alias("mrr"),
        F.when(n > 0, F.try_divide(gain(F.col("_hit")), gain(F.transform("_want", lambda d: F.lit(1.0))))).alias("ndcg10"),
    )


def fallback_reasons(trials: DataFrame) -> DataFrame:
    """AG23: (fallback_reason, trials): how often each reason occurred; none and blank don't count."""
    return trials.where("fallback_reason <> ''").groupBy("fallback_reason").agg(F.count("*").alias("trials"))


def token_usage(trials: DataFrame, rates: tuple[float, float, float] | None = None, errors: DataFrame | None = None) -> DataFrame:
    """AG23: one row: input_tokens, output_tokens, cached_input_tokens and unreported_calls (calls
    of a model without usage) over trials (fast_path, usage struct of the three counts);
    cost_usd and cost_per_attempt_usd with rates in USD a million input, output and cached input
    tokens, null without. errors (usage): failed calls, which are paid for too but are in the
    costs only; attempts are trials and errors."""
    if rates is not None and not all(math.isfinite(r) and r >= 0 for r in rates):
        raise ValueError("rates must be finite and not negative")
    kinds = ["input_tokens", "output_tokens", "cached_input_tokens"]
    rows = trials.select("usage", F.coalesce("fast_path", F.lit(False)).alias("fast_path"), F.lit(False).alias("failed"))
    if errors is not None:
        rows = rows.unionByName(errors.select("usage", F.lit(True).alias("fast_path"), F.lit(True).alias("failed")))
    of = lambda k, failed: F.coalesce(F.sum(F.when(F.col("failed") == failed, F.coalesce(F.col(f"usage.{k}"), F.lit(0)).cast("bigint"))), F.lit(0))
    per = rows.agg(*[of(k, False).alias(k) for k in kinds], F.count_if(~F.col("fast_path") & F.col("usage").isNull()).alias("unreported_calls"), *[of(k, True).alias(f"_{k}") for k in kinds], F.count_if(~F.col("failed")).alias("_trials"), F.count("*").alias("_attempts"))
    i, o, h = (F.col(k) + F.col(f"_{k}") for k in kinds)
    cost = F.lit(None).cast("double") if rates is None else ((i - h) * F.lit(float(rates[0])) + o * F.lit(float(rates[1])) + h * F.lit(float(rates[2]))) / 1e6
    return per.withColumn("cost_usd", cost).select(*kinds, "unreported_calls", "cost_usd", F.when(F.col("_trials") > 0, F.try_divide("cost_usd", "_attempts")).alias("cost_per_attempt_usd"))


# --- gates and comparisons

#: Metric, bound, direction.
THRESHOLDS = [("candidate_recall", 0.8, ">="), ("precision_at_k", 0.045, ">="), ("recall_at_k", 0.4, ">="), ("recall_at_recall_k", 0.6, ">="), ("mrr", 0.32, ">="), ("ndcg_at_k", 0.32, ">="), ("p95_latency_ms", 150.0, "<="), ("missing_queries", 0.0, "<=")]


def unpivot_report(report: DataFrame, metrics: list[str]) -> DataFrame:
    return report.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("m.*")


def gate(report: DataFrame, thresholds: list[tuple[str, float, str]] = THRESHOLDS) -> DataFrame:
    """AG28: (metric, value, bound, passed); a null value fails."""
    values = unpivot_report(report, [t[0] for t in thresholds])
    bounds = report.sparkSession.createDataFrame(thresholds, "metric string, bound double, direction string")
    ok = F.when(F.col("direction") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return values.join(F.broadcast(bounds), "metric").select("metric", "value", "bound", F.coalesce(ok, F.lit(False)).alias("passed"))


def compare(baseline: DataFrame, current: DataFrame, metrics: list[str], tolerance: float = 1e-4) -> DataFrame:
    """JN20/AG27: per query the deltas current - baseline, and whether one fell by more
    than the tolerance. Queries of the baseline alone have null deltas and are regressions."""
    c = current.select("query_id", *[F.col(m).alias(f"_{m}") for m in metrics])
    j = baseline.join(c, "query_id", "left")
    deltas = [(F.col(f"_{m}") - F.col(m)).alias(f"delta_{m}") for m in metrics]
    worse = F.greatest(F.lit(0), *[F.coalesce((F.col(f"delta_{m}") < -tolerance).cast("int"), F.lit(1)) for m in metrics]) == 1
    return j.select("query_id", "category", *deltas).withColumn("is_worse", worse)


def compare_reports(baseline: DataFrame, current: DataFrame, metrics: list[str], tolerance: float = 1e-4) -> DataFrame:
    """AG27: two reports of one row, metric by metric: (metric, baseline, current, delta, relative, is_regression)."""
    a = unpivot_report(baseline, metrics).withColumnRenamed("value", "baseline")
    b = unpivot_report(current, metrics).withColumnRenamed("value", "current")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    j = a.join(b, "metric").select("metric", zero("baseline").alias("baseline"), zero("current").alias("current"))
    delta = F.col("current") - F.col("baseline")
    return j.select("metric", "baseline", "current", tx.fixed(delta, 6).alias("delta"), tx.fixed(F.try_divide(delta, F.col("baseline")), 6).alias("relative"), (delta < -tolerance).alias("is_regression"))


def category_deltas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """AG27: (category, queries, mean_rr_delta, mean_recall_delta, lost): mean changes over the current queries of
    each category, a query without a baseline changing from 0, and how many lost their reciprocal rank."""
    b = baseline.select("query_id", F.col("reciprocal_rank").alias("_rr"), F.col("recall_at_recall_k").alias("_recall"))
    j = current.join(b, "query_id", "left")
    delta = lambda c, o: F.coalesce(c, F.lit(0.0)) - F.coalesce(o, F.lit(0.0))
    lost = (F.coalesce("_rr", F.lit(0.0)) > 0) & (F.col("reciprocal_rank") == 0)
    return j.groupBy("category").agg(F.count("*").alias("queries"), tx.fixed(F.avg(delta("reciprocal_rank", "_rr")), 6).alias("mean_rr_delta"), tx.fixed(F.avg(delta("recall_at_recall_k", "_recall")), 6).alias("mean_recall_delta"), F.count_if(lost).alias("lost"))
