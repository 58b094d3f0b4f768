"""Queries of pools, readiness, comparisons, case assessments and request checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.operators import corpus as cp
from reelrank.operators import entities as en
from reelrank.operators import evaluation as ev
from reelrank.operators import review as rv
from reelrank.operators import validation as va
from reelrank.plans import catalogue as cat
from reelrank.plans import people as pe
from reelrank.plans import search as sr
from reelrank.plans.metadata import unsupported
from reelrank.plans.people_sql import _BASE_EVAL, _MEMBERS, _NOW_EVAL, CREDITS, PEOPLE, POOL, REVIEWS, slug
from reelrank.plans.records import SQL_WS, sql_key
from reelrank.plans.sql import RECORDS, SEARCHED, STOP, TITLES, _parsed, evidence, fixed, key
from reelrank.runtime import clean_key, cut, table


def _evals(spark, folder):
    """Metrics of each query's first and latest run."""
    c = table(spark, folder, "queries").select(clean_key("_id").alias("query_id"), F.col("metadata.category").alias("category")).where("query_id is not null").groupBy("query_id").agg(F.min("category").alias("category"))
    runs = table(spark, folder, "tiny_run").where("run_at is not null")
    early = runs.withColumn("run_at", F.timestamp_micros(-F.unix_micros(F.col("run_at").cast("timestamp"))))
    return tuple(cut(ev.evaluate(cat._judged(spark, folder), ev.latest_runs(r), categories=c)) for r in (early, runs))


COMPARED = ["precision_at_k", "recall_at_k", "recall_at_recall_k", "mrr", "ndcg_at_k"]


def report_comparison(spark, folder):
    """AG27: the report of the first runs against that of the latest."""
    a, b = _evals(spark, folder)
    out = ev.compare_reports(ev.summarize(a), ev.summarize(b), COMPARED)
    return out.select("metric", tx.fixed(F.col("baseline"), 6).alias("baseline"), tx.fixed(F.col("current"), 6).alias("current"), tx.fixed(F.col("delta"), 5).alias("delta"), "is_regression")


def category_deltas(spark, folder):
    """AG27: mean changes by category and lost reciprocal ranks."""
    a, b = _evals(spark, folder)
    d = ev.category_deltas(a, b)
    return d.select("category", "queries", tx.fixed(F.col("mean_rr_delta"), 5).alias("mean_rr_delta"), tx.fixed(F.col("mean_recall_delta"), 5).alias("mean_recall_delta"), "lost")


def latency_medians(spark, folder):
    """AG12: the median latency of each query's runs, to 3 decimals where two values stand in the middle."""
    runs = table(spark, folder, "tiny_run").where("latency_ms >= 0 and not isnan(latency_ms) and latency_ms < double('Infinity')").select(clean_key("query_id").alias("query_id"), "latency_ms").where("query_id is not null")
    return runs.groupBy("query_id").agg(F.count("*").alias("n"), tx.fixed(ev.median("latency_ms"), 3).alias("median_ms"))


def numeric_ids(spark, folder):
    """SO6: the first movies of each year by number."""
    from reelrank.operators.ranking import numeric_order

    t = cat.titles(spark, folder).where("year is not null")
    return cp.ranked_within(t, ["year"], numeric_order(F.col("id")), 5).select("year", "rank_no", "id")


def fallback_histogram(spark, folder):
    """AG23: how often each category stands as the reason of a trial; a trial is a run."""
    runs = table(spark, folder, "tiny_run").select(clean_key("query_id").alias("query_id")).where("query_id is not null")
    c = table(spark, folder, "queries").select(clean_key("_id").alias("query_id"), F.col("metadata.category").alias("fallback_reason")).where("query_id is not null").groupBy("query_id").agg(F.min("fallback_reason").alias("fallback_reason"))
    return ev.fallback_reasons(runs.join(c, "query_id", "left"))


def usage_totals(spark, folder):
    """AG23: sums of usage and their cost: a run's candidates go in, its results come out."""
    runs = table(spark, folder, "tiny_run").where(clean_key("query_id").isNotNull())
    usage = F.when(F.col("candidate_ids").isNotNull(), F.struct(F.size("candidate_ids").cast("bigint").alias("input_tokens"), F.coalesce(F.size("results"), F.lit(0)).cast("bigint").alias("output_tokens"), F.lit(0).cast("bigint").alias("cached_input_tokens")))
    u = ev.token_usage(runs.select(usage.alias("usage"), F.lit(False).alias("fast_path")), (0.5, 1.5, 0.1))
    return u.select("input_tokens", "output_tokens", "cached_input_tokens", "unreported_calls", tx.fixed(F.col("cost_usd"), 6).alias("cost_usd"))


def case_assessment(spark, folder):
    """AG24: each judged query as a case: its relevant documents expected, its latest run's first ten found."""
    judged = cat._judged(spark, folder).where("grade > 0").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("want"))
    top = ev.ranked(ev.latest_runs(table(spark, folder, "tiny_run"))).where(F.col("rank") <= 10).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("got"))
    none = F.array().cast("array<string>")
    j = judged.join(top, "query_id", "left").withColumn("got", F.coalesce("got", none))
    common = lambda ids: [ids.alias("ids"), none.alias("title_ids"), none.alias("genres"), F.lit("any").alias("genre_mode"), *[F.lit(None).cast("int").alias(c) for c in ev.CASE_FILTERS], F.lit(None).cast("string").alias("sort_field"), F.lit(None).cast("string").alias("sort_direction"), F.lit(False).alias("blocked")]
    expected = F.struct(*common(F.col("want")), none.alias("people"), F.lit(None).cast("map<string,string>").alias("roles"), F.lit(False).alias("ordered"), F.lit(None).cast("string").alias("unresolved_kind"), F.lit(False).alias("fast_path"), F.lit(None).cast("string").alias("local_mode"))
    actual = F.struct(*common(F.col("got")), F.array().cast("array<struct<id:string,role:string>>").alias("people"), none.alias("unavailable"), F.lit("model").alias("mode"))
    a = ev.assess_cases(j.select(F.col("query_id").alias("case_id"), expected.alias("expected"), actual.alias("actual")))
    return a.select("case_id", F.array_join("failed_checks", ",").alias("failed"), "passed", *[tx.fixed(F.col(m), 6).alias(m) for m in ("recall", "precision", "mrr", "ndcg10")])


def judge_agreement(spark, folder):
    """AG26: the reviews of each pair against its highest grade; a repetition is a year."""
    r = rv.latest_reviews(pe._reviews(spark, folder)).withColumn("item_id", F.concat_ws("|", "query_id", "doc_id"))
    gold = cat._judged(spark, folder).select(F.concat_ws("|", "query_id", "doc_id").alias("item_id"), F.col("grade").alias("gold"))
    a = rv.agreement(r.select("item_id", F.col("reviewer_id").alias("rep"), "grade").join(gold, "item_id"))
    return a.select(*[tx.fixed(F.col(c), 6).alias(c) for c in a.columns])


def judged_lists(spark, folder):
    """AG25: metrics over the judged results of each latest run alone."""
    lists = ev.ranked(ev.latest_runs(table(spark, folder, "tiny_run"))).join(cat._judged(spark, folder), ["query_id", "doc_id"]).select("query_id", "rank", "grade")
    m = rv.judged_metrics(lists)
    return m.select("query_id", tx.fixed(F.col("ndcg"), 6).alias("ndcg"), tx.fixed(F.col("precision_5"), 6).alias("precision_5"), "top1_relevant", "zero_relevant")


def _requests(spark, folder):
    return sr.plan(cat.search_queries(spark, folder), cat.genre_aliases(spark, folder)).where(F.size("genres") > 0).select("query_id", "text", "genres")


def _nominations(spark, folder):
    """The five strategies for the search queries that name a genre."""
    asked = cut(_requests(spark, folder))
    rows = cp.rating_evidence(cut(cat.records(spark, folder)))
    runs = table(spark, folder, "tiny_run").where("run_at is not null")
    early = runs.withColumn("run_at", F.timestamp_micros(-F.unix_micros(F.col("run_at").cast("timestamp"))))
    listed = lambda r, name: ev.ranked(ev.latest_runs(r)).join(asked.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= rv.STRATEGY_DEPTH).select("query_id", F.lit(name).alias("source"), "doc_id", "rank")
    judged = cat._judged(spark, folder).join(asked.select("query_id"), "query_id", "left_semi")
    existing = cp.ranked_within(judged, ["query_id"], [F.desc("grade"), "doc_id"], rv.POOL_SIZE, "rank").select("query_id", F.lit("existing").alias("source"), "doc_id", "rank")
    n = existing.unionByName(listed(runs, "production")).unionByName(listed(early, "baseline")).unionByName(rv.genre_nominations(asked, rows))
    return n.join(rows.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


def genre_nominations(spark, folder):
    """QY8: what quality and text nominate for each search query that names a genre."""
    return rv.genre_nominations(_requests(spark, folder), cp.rating_evidence(cat.records(spark, folder))).select("query_id", "source", "doc_id", "rank")


def genre_review_pool(spark, folder):
    """QY8, SO13, WN8, WN9: the pool of five strategies."""
    return rv.review_pool(_nominations(spark, folder))


def publication_readiness(spark, folder):
    """QY10, JN19: what the latest runs' first ten still need."""
    pool = cut(rv.interleave(rv.nominate(pe._lists(spark, folder))))
    status = rv.judgment_status(rv.latest_reviews(pe._reviews(spark, folder)))
    return rv.publication_readiness(ev.ranked(ev.latest_runs(table(spark, folder, "tiny_run"))), pool, status)


def review_problems(spark, folder):
    """QY9: judgments as reviews that can't be taken, by kind."""
    p = table(spark, folder, "provisional")
    events = p.select(clean_key(F.col("`query-id`")).alias("query_id"), clean_key(F.col("`corpus-id`")).alias("doc_id"), F.year("judged_at").cast("string").alias("reviewer_id"), F.col("score").alias("grade")).where("query_id is not null and doc_id is not null")
    pool = cut(rv.interleave(rv.nominate(pe._lists(spark, folder))))
    return rv.review_problems(events, pool).groupBy("problem").agg(F.count("*").alias("n"))


def request_checks(spark, folder):
    """FL13: documents' texts and lengths as requests: what each breaks."""
    d = table(spark, folder, "documents").where("doc_id is not null")
    w = F.create_map(F.lit("dice"), (F.pmod("doc_id", F.lit(7)) * 20 - 10).cast("double"))
    return va.request_problems(d.select(F.col("doc_id").alias("request_id"), F.left("text", F.lit(305)).alias("query"), F.when(F.pmod("doc_id", F.lit(5)) > 0, F.col("n_chars").cast("int")).alias("result_limit"), F.when(F.pmod("doc_id", F.lit(3)) == 0, w).alias("weights")))


def film_cards(spark, folder):
    """FL10, FL12."""
    c = va.film_cards(pe.records_with_people(spark, folder))
    return c.select("id", "title", "year", "rating_count", F.array_join("directors", "|").alias("directors"), F.array_join("cast", "|").alias("cast"))


def registry_stats(spark, folder):
    """ETL16, ETL17, FL11: entities and links of each kind, the public count of actors among them."""
    people = cut(pe._people(spark, folder))
    stats = va.registry_stats(people, {"genre": pe.entity_registry_genres(spark, folder), "tag": pe.entity_registry_tags(spark, folder)})
    shown = va.public_entities(people, "actor").where("movie_count > 0").agg(F.lit("shown").alias("kind"), F.count("*").alias("entities"), F.sum("movie_count").cast("bigint").alias("links"))
    return stats.unionByName(shown)


def movies_of_people(spark, folder):
    """JN13, JN14: movies with both people of every pair of an actor and a director of one movie."""
    c = pe.credits(spark, folder)
    key_of = F.concat(F.lit("person:name:"), tx.slug(F.col("name")))
    edges = cut(c.select(key_of.alias("entity_id"), "role", "movie_id").distinct())
    # every person is asked for once in each role, not once a pair; the pairs meet in their movies, and those of
    # a movie with many people are spread over salts
    asks = edges.select(F.col("entity_id").alias("query_id"), (F.col("role") == "director").cast("int").alias("group_no"), "entity_id", "role").distinct()
    people = edges.select("entity_id").distinct().select("entity_id", F.col("entity_id").alias("name"), F.array().cast("array<string>").alias("movie_ids"))
    records = edges.select(F.col("movie_id").alias("id")).distinct().select("id", F.array().cast("array<string>").alias("cast"), F.array().cast("array<string>").alias("directors"))
    held = cut(en.person_movies(asks, people, edges, records))
    a = held.where("group_no = 0").select("movie_id", F.col("query_id").alias("a"), F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int").alias("salt"))
    d = held.where("group_no = 1").select("movie_id", F.col("query_id").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return a.join(d, ["movie_id", "salt"]).select(F.concat_ws("+", "a", "d").alias("query_id"), "movie_id")


def movie_lookup(spark, folder):
    """FL7, SO10: the movies whose title holds "the m"."""
    r = cat.records(spark, folder)
    return en.lookup(r, "the m", 12).select("id", "title", "rating_count")


def entity_names(spark, folder):
    """FL6: the first page of people whose name holds "an"."""
    return en.page(pe._people(spark, folder), 1, 24, contains="An").select("entity_id", "movie_count", "total", "pages")


def judged_movies(spark, folder):
    """JN17."""
    return rv.judged_titles(cat._judged(spark, folder), cat.titles(spark, folder))


def teaching_subset(spark, folder):
    """ETL18: twenty fixed documents, as far as they exist."""
    found = cp.subset(cat.corpus(spark, folder), TEACHING)
    return found.select("_id", "title", F.col("metadata.rating_count").alias("rating_count"))


def unsupported_bounds(spark, folder):
    """PL16: queries that ask for a rating which the catalogue doesn't have."""
    q = pe._all_queries(spark, folder)
    n = F.pmod(F.length("text"), F.lit(10)).cast("string")
    asked = F.concat("text", F.lit(" "), n, F.when(F.pmod(F.length("text"), F.lit(3)) == 0, "+ on imdb").when(F.pmod(F.length("text"), F.lit(3)) == 1, ".5+ imdb").otherwise(" stars"))
    return q.select("query_id", unsupported(tx.exact_key(asked)).alias("unsupported"))


def typeahead_genres(spark, folder):
    """QY4, SO12: what the first two letters of every genre suggest among the genres."""
    g = pe.entity_registry_genres(spark, folder).select(F.col("entity_id").alias("id"), "name", F.col("movie_count").alias("weight"))
    q = g.select(F.lower(F.left("name", F.lit(2))).alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    return en.typeahead(q, g).select("query_id", "rank_no", "id", "score")


#: Parts into which the people of a movie are split where its pairs are made.
SALTS = 16
#: The documents of the teaching subset.
TEACHING = list(range(1, 400, 20))

_ALL = [judged_movies, teaching_subset, unsupported_bounds, typeahead_genres, report_comparison, category_deltas, latency_medians, numeric_ids, fallback_histogram, usage_totals, case_assessment, judge_agreement, judged_lists, genre_nominations, genre_review_pool, publication_readiness, review_problems, request_checks, film_cards, registry_stats, movies_of_people, movie_lookup, entity_names]
QUERIES = {f.__name__: f for f in _ALL}

_CT = f"""ct as (select {sql_key('_id')} query_id, min(metadata.category) category from queries where {sql_key('_id')} is not null group by 1)"""
_QR = f"""jd as (select {sql_key('"query-id"')} query_id, {sql_key('"corpus-id"')} doc_id, max(score) grade from provisional where score >= 0 and {sql_key('"query-id"')} is not null and {sql_key('"corpus-id"')} is not null group by 1, 2)"""
_SIDES = f"b0 as (with {_BASE_EVAL} select * from per), c0 as (with {_NOW_EVAL} select * from per)"
_RANKED = f"""lr as (select distinct query_id, results from (select {sql_key('query_id')} query_id, results, run_at, max(run_at) over (partition by {sql_key('query_id')}) m from tiny_run) where run_at = m and query_id is not null),
px as (select query_id, generate_subscripts(results, 1) p, unnest(results) r from lr), pf as (select query_id, {sql_key('r.doc_id')} doc_id, min(p) p from px where {sql_key('r.doc_id')} is not null group by 1, 2),
rk as (select query_id, doc_id, row_number() over (partition by query_id order by p) rnk from pf)"""


_EARLY = _RANKED.replace("max(run_at)", "min(run_at)").replace("run_at = m and", "run_at = m and run_at is not null and").replace("lr as", "lr0 as").replace("from lr)", "from lr0)").replace("px as", "px0 as").replace("from px where", "from px0 where").replace("pf as", "pf0 as").replace("from pf)", "from pf0)").replace("rk as", "rk0 as")


def _nominated() -> str:
    """gq: rows (query_id, source, doc_id, rnk) of quality and text."""
    q = fixed("len(list_intersect(wanted, genres))::double / greatest(len(wanted), len(genres), 1) * 0.55::double + bayes / 5 * 0.3::double + evidence * 0.15::double", 6)
    stop = "['" + "', '".join(rv.REVIEW_STOP_WORDS) + "']"
    score = fixed("case when len(terms) > 0 then len(list_filter(terms, lambda t: contains(told, t)))::double / len(terms) else 0.0 end * 0.6::double + len(list_intersect(wanted, genres))::double / len(wanted) * 0.4::double", 6)
    return f"""{RECORDS}, {evidence('rec')}, {SEARCHED}, {_parsed('qk')}, tl as (select id tid, list_sort(list(distinct trim(tag, {SQL_WS}))) tags from (select {sql_key('"movieId"')} id, tag from tags) where id is not null group by 1),
an as (select query_id, list_sort(list_distinct(genres)) wanted, list_filter({'list_distinct(regexp_extract_all(qkey, ' + chr(39) + '[a-z0-9]+' + chr(39) + '))'}, lambda x: not list_contains({STOP}, x) and not list_contains({stop}, x)) terms from parsed where len(genres) > 0),
sq as (select query_id, id, row_number() over (partition by query_id order by {q} desc, id::bigint, id) rnk from an join ev on len(list_intersect(wanted, genres)) = len(wanted)),
tg as (select ev.*, {key("array_to_string(coalesce(tags, []), ' ') || ' '")} told from ev left join tl on tid = ev.id), te0 as (select query_id, id, {score} score from an join tg on list_has_any(wanted, genres)),
te as (select *, row_number() over (partition by query_id order by score desc, id::bigint, id) rnk from te0 where score > 0),
gq as (select query_id, 'genre_quality' source, id doc_id, rnk from sq where rnk <= 10 union all select query_id, 'text_evidence', id, rnk from te where rnk <= 10)"""


_MEAN = {"precision_at_k": "avg(precision_at_k)", "recall_at_k": "avg(recall_at_k)", "recall_at_recall_k": "avg(recall_at_recall_k)", "mrr": "avg(reciprocal_rank)", "ndcg_at_k": "avg(ndcg_at_k)"}

ORACLE = {
    "judged_movies": f"""with {_QR}, {TITLES} select query_id, doc_id, grade, coalesce(nullif(title, ''), 'Film ' || doc_id) title, "year" from jd left join titles on id = doc_id""",
    "teaching_subset": f"""with {RECORDS} select id _id, source_title title, rating_count from rec where id in ({', '.join(f"'{i}'" for i in TEACHING)})""",
    "unsupported_bounds": f"""with a as (select {sql_key('_id')} query_id, min(text) t from queries where text is not null and {sql_key('_id')} is not null group by 1),
k as (select query_id, {key("t || ' ' || (length(t) % 10) || case length(t) % 3 when 0 then '+ on imdb' when 1 then '.5+ imdb' else ' stars' end")} k from a)
select query_id, 'IMDb rating >= ' || coalesce(nullif(regexp_extract(k, '\\b(\\d(?:\\.\\d)?)\\s*\\+\\s*(?:(?:in|on)\\s+)?imdb\\b', 1), ''), nullif(regexp_extract(k, '\\bimdb\\s*(\\d(?:\\.\\d)?)\\s*\\+', 1), '')) unsupported from k""",
    "typeahead_genres": f"""with {TITLES}, g as ({_MEMBERS('genre', 'select id, trim(g, ' + SQL_WS + ') n from (select id, unnest(genres) g from titles)')}), es as (select entity_id, "name" n, {key('"name"')} nk, movie_count from g),
qy as (select distinct lower(left(n, 2)) query_id, {key('lower(left(n, 2))')} qk from es), h as (select query_id, entity_id, n, movie_count, case when nk = qk then 4 when starts_with(nk, qk) then 3 else 2 end score from qy join es on contains(' ' || nk, ' ' || qk) where length(qk) >= 2)
select query_id, rank_no::int rank_no, entity_id id, score::int score from (select *, row_number() over (partition by query_id order by score desc, movie_count desc, n, entity_id) rank_no from h) where rank_no <= 6""",
    "report_comparison": f"with {_SIDES}, " + ", ".join(f"x{i} as (select (select {m} from b0) a, (select {m} from c0) b)" for i, m in enumerate(_MEAN.values())) + " " + " union all ".join(f"select '{k}' metric, {fixed('a', 6)} baseline, {fixed('b', 6)} \"current\", {fixed(fixed('b - a', 6), 5)} delta, b - a < -0.0001 is_regression from x{i}" for i, k in enumerate(_MEAN)),
    "category_deltas": f"""with {_SIDES}, {_CT}, d as (select coalesce(ct.category, 'uncategorized') category, c.reciprocal_rank - coalesce(b.reciprocal_rank, 0) r, c.recall_at_recall_k - coalesce(b.recall_at_recall_k, 0) k, coalesce(b.reciprocal_rank, 0) > 0 and c.reciprocal_rank = 0 l
  from c0 c left join b0 b using (query_id) left join ct using (query_id))
select category, count(*) queries, {fixed(fixed('avg(r)', 6), 5)} mean_rr_delta, {fixed(fixed('avg(k)', 6), 5)} mean_recall_delta, count(*) filter (l) lost from d group by 1""",
    "latency_medians": f"""select {sql_key('query_id')} query_id, count(*) n, {fixed('median(latency_ms)', 3)} median_ms from tiny_run where latency_ms >= 0 and isfinite(latency_ms) and {sql_key('query_id')} is not null group by 1""",
    "numeric_ids": f"""with {TITLES} select "year", n::int rank_no, id from (select "year", id, row_number() over (partition by "year" order by id::bigint, id) n from titles where "year" is not null) where n <= 5""",
    "fallback_histogram": f"""with {_CT} select category fallback_reason, count(*) trials from tiny_run t join ct on ct.query_id = {sql_key('t.query_id')} where category <> '' group by 1""",
    "usage_totals": f"""with u as (select candidate_ids is not null h, len(candidate_ids) i, coalesce(len(results), 0) o from tiny_run where {sql_key('query_id')} is not null)
select sum(case when h then i else 0 end)::bigint input_tokens, sum(case when h then o else 0 end)::bigint output_tokens, 0 cached_input_tokens, count(*) filter (not h) unreported_calls,
  {fixed('(sum(case when h then i else 0 end)::double * 0.5::double + sum(case when h then o else 0 end)::double * 1.5::double) / 1e6', 6)} cost_usd from u""",
    "case_assessment": f"""with {_QR}, {_RANKED}, w as (select query_id, list_sort(list(doc_id)) want from jd where grade > 0 group by 1), g as (select query_id, list(doc_id order by rnk) got from rk where rnk <= 10 group by 1),
c as (select query_id, want, coalesce(got, []) got from w left join g using (query_id)), h as (select *, list_transform(got, lambda d: list_contains(want, d)::int::double) hit from c),
m as (select *, coalesce(list_sum(hit), 0) hits, list_position(hit, 1.0) first, coalesce(list_sum(list_transform(hit, lambda x, i: x / log2(i + 1))), 0) dcg, list_sum(list_transform(want[1:10], lambda x, i: 1.0::double / log2(i + 1))) idl from h)
select query_id case_id, case when list_sort(got) = want then '' else 'results' end failed, list_sort(got) = want passed, {fixed('hits / len(want)', 6)} recall, {fixed('case when len(got) > 0 then hits / len(got) else 0.0::double end', 6)} "precision",
  {fixed('case when first > 0 then 1.0::double / first else 0.0::double end', 6)} mrr, {fixed('dcg / idl', 6)} ndcg10 from m""",
    "judge_agreement": f"""with {REVIEWS}, {_QR}, x as (select query_id, doc_id, lt.grade >= 2 good, jd.grade >= 2 gold, lt.grade g from lt join jd using (query_id, doc_id)), i as (select avg((lo <> hi)::int::double) v from (select min(g) lo, max(g) hi from x group by query_id, doc_id))
select {fixed('avg((good = gold)::int::double)', 6)} agreement, {fixed('avg(good::int::double) filter (gold)', 6)} recall, {fixed('avg((not good)::int::double) filter (not gold)', 6)} specificity, {fixed('any_value(v)', 6)} instability from x, i""",
    "judged_lists": f"""with {_QR}, {_RANKED}, l as (select query_id, rnk, grade, row_number() over (partition by query_id order by grade desc, rnk) i from rk join jd using (query_id, doc_id))
select query_id, {fixed("coalesce(sum(case when rnk <= 10 then (2.0::double ** grade - 1) / log2(rnk + 1) else 0 end) / nullif(sum(case when i <= 10 then (2.0::double ** grade - 1) / log2(i + 1) else 0 end), 0), 0)", 6)} ndcg,
  {fixed("count(*) filter (rnk <= 5 and grade >= 2)::double / nullif(count(*) filter (rnk <= 5), 0)", 6)} precision_5, bool_or(grade >= 2) filter (rnk = 1) top1_relevant, max(grade) < 2 zero_relevant from l group by 1""",
    "genre_nominations": f"with {_nominated()} select query_id, source, doc_id, rnk::int \"rank\" from gq",
    "genre_review_pool": f"""with {_nominated()}, {_QR}, {_RANKED}, {_EARLY},
nx as (select query_id, 'existing' source, 0 no, doc_id, rnk from (select *, row_number() over (partition by query_id order by grade desc, doc_id) rnk from jd where query_id in (select query_id from an)) where rnk <= 40
  union all select query_id, 'production', 1, doc_id, rnk from rk where rnk <= 10 and query_id in (select query_id from an) union all select query_id, 'baseline', 2, doc_id, rnk from rk0 where rnk <= 10 and query_id in (select query_id from an)
  union all select query_id, source, case when source = 'genre_quality' then 3 else 4 end, doc_id, rnk from gq),
fx as (select query_id, doc_id, min(case when no = 0 then rnk else 1073741824 + rnk * 5 + no end) turn, count(distinct source) filter (rnk <= 10) n_sources from nx where doc_id in (select id from rec) group by 1, 2),
px2 as (select *, row_number() over (partition by query_id order by turn, doc_id) place from fx)
select query_id, place::int place, doc_id, n_sources from px2 where place <= 40""",
    "publication_readiness": f"""with {POOL}, {REVIEWS}, {_RANKED}, h as (select rk.query_id, rk.doc_id, pl.doc_id is not null inp, final_grade is not null fin from rk left join pl using (query_id, doc_id) left join js using (query_id, doc_id) where rnk <= 10),
pr as (select query_id, count(*) top_count, count(*) filter (inp) in_pool, count(*) filter (inp and fin) finalized from h group by 1),
pg as (select query_id, count(*) >= 20 and bool_and(coalesce(n_reviews, 0) >= 2 and final_grade is not null) c from pl left join js using (query_id, doc_id) group by 1),
ac as (select *, case when in_pool < top_count then 'expand_pool' when finalized < in_pool then 'complete_reviews' else 'none' end "action" from pr)
select query_id, top_count, in_pool, finalized, "action", "action" = 'none' is_ready, coalesce(c, false) pool_complete from ac left join pg using (query_id)""",
    "review_problems": f"""with {POOL}, e as (select {sql_key('"query-id"')} query_id, {sql_key('"corpus-id"')} doc_id, year(judged_at)::varchar who, score from provisional),
x as (select case when pl.doc_id is null then 'not_in_pool' when coalesce(length(who), 0) not between 1 and 80 then 'bad_reviewer' when score is null or score not between 0 and 3 then 'bad_grade' end problem from e left join pl using (query_id, doc_id) where e.query_id is not null and e.doc_id is not null)
select problem, count(*) n from x where problem is not null group by 1""",
    "request_checks": """select doc_id request_id, case when text is null or trim(text) = '' or length(text) > 300 then 'query' when doc_id % 3 = 0 and doc_id % 7 * 20 - 10 not between 0 and 100 then 'weight'
  when doc_id % 5 > 0 and n_chars not between 1 and 9742 then 'result_limit' end problem from documents where doc_id is not null""",
    "film_cards": f"""with {RECORDS}, {CREDITS}, pl as (select movie_id mid, list_sort(list(distinct "name") filter (role = 'actor')) a, list_sort(list(distinct "name") filter (role = 'director')) d from cr group by 1)
select id, title, "year", rating_count, coalesce(array_to_string(d[1:3], '|'), '') directors, coalesce(array_to_string(a[1:6], '|'), '') "cast" from rec left join pl on mid = id""",
    "registry_stats": f"""with {PEOPLE}, {TITLES}, g as ({_MEMBERS('genre', 'select id, trim(g, ' + SQL_WS + ') n from (select id, unnest(genres) g from titles)')}), t as ({_MEMBERS("tag", f'''select {sql_key('"movieId"')} id, trim(tag, {SQL_WS}) n from tags''')}),
k as (select 'actor' kind, actor_movie_count n from people where actor_movie_count > 0 union all select 'director', director_movie_count from people where director_movie_count > 0 union all select 'genre', movie_count from g union all select 'tag', movie_count from t union all select 'shown', actor_movie_count from people where actor_movie_count > 0)
select kind, count(*) entities, sum(n)::bigint links from k group by 1""",
    "movies_of_people": f"""with {CREDITS}, e as (select distinct 'person:name:' || {slug('"name"')} eid, role, movie_id from cr), p as (select distinct a.eid a, d.eid d from e a join e d using (movie_id) where a.role = 'actor' and d.role = 'director')
select distinct p.a || '+' || p.d query_id, x.movie_id from p join e x on x.eid = p.a and x.role = 'actor' join e y on y.eid = p.d and y.role = 'director' and y.movie_id = x.movie_id""",
    "movie_lookup": f"""with {RECORDS} select id, title, rating_count from rec where id = 'the m' or contains(tkey, 'the m') order by tkey = 'the m' desc, starts_with(tkey, 'the m') desc, rating_count desc, title, id limit 12""",
    "entity_names": f"""with {PEOPLE}, k as (select * from people where contains(lower("name"), 'an')) select entity_id, movie_count, (select count(*) from k) total, ((select count(*) from k) + 23) // 24 pages from k order by movie_count desc, "name", entity_id limit 24""",
}
