"""Queries of the entity, correction, review and multilingual operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.operators import corpus as cp
from reelrank.operators import entities as en
from reelrank.operators import evaluation as ev
from reelrank.operators import multilingual as ml
from reelrank.operators import ranking as rk
from reelrank.operators import review as rv
from reelrank.operators.index import token_lookup
from reelrank.plans import catalogue as cat
from reelrank.plans import corrections as co
from reelrank.plans import multilingual as mp
from reelrank.plans import search as sr
from reelrank.plans.people_sql import ORACLE  # noqa: F401
from reelrank.runtime import clean_key, cut, table

NAME = "([A-Z][a-z]+ [A-Z][a-z]+)"


def credits(spark, folder):
    """(movie_id, role, person_id, name) as the texts tell them: who plays, who directs."""
    d = table(spark, folder, "documents").select(clean_key("movieId").alias("movie_id"), "text").where("movie_id is not null")
    of = lambda role, verb: d.select("movie_id", F.lit(role).alias("role"), F.lit(None).cast("string").alias("person_id"), F.explode(F.regexp_extract_all("text", F.lit(f"{NAME} {verb}"), 1)).alias("name"))
    return of("actor", "plays").unionByName(of("director", "directs"))


def _people(spark, folder):
    return cp.people(credits(spark, folder))


_all_queries = cat.all_queries


def records_with_people(spark, folder):
    """Records with the people that the texts name: cast and directors."""
    c = credits(spark, folder).select(F.col("movie_id").alias("id"), "role", "name").distinct()
    lists = c.groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("name")))).alias(f) for r, f in (("actor", "cast"), ("director", "directors"))])
    none = F.array().cast("array<string>")
    return cat.records(spark, folder).join(lists, "id", "left").withColumns({f: F.coalesce(f, none) for f in ("cast", "directors")})


def title_search_flagship(spark, folder):
    """QY1, QY2, QY6: the whole search of all queries, 100 records each: plans with corrections and
    people, candidates of all sources, every signal, boosts."""
    r = cut(records_with_people(spark, folder))
    found = sr.search(cat.all_queries(spark, folder), r, 100, cat.genre_aliases(spark, folder), people=_people(spark, folder), genres=table(spark, folder, "genre_names").select("genre"))
    return found.withColumn("sources", F.array_join("sources", ","))


def planned_search(spark, folder):
    """QY1, QY2, PL22, RK10, RK11, SO2, SO7: the search with whole plans, for all queries and, of every
    movie, the title with a letter missing and the last name of an actor."""
    r = cut(records_with_people(spark, folder))
    typos = r.where("length(title) > 5").select(F.concat(F.lit("typo:"), "id").alias("query_id"), F.expr("left(title, length(title) - 1)").alias("text"))
    stars = r.where("size(cast) > 0").select(F.concat(F.lit("star:"), "id").alias("query_id"), F.substring_index(F.array_min("cast"), " ", -1).alias("text"))
    q = cat.all_queries(spark, folder).unionByName(typos).unionByName(stars)
    found = sr.search(q, r, 20, cat.genre_aliases(spark, folder), people=_people(spark, folder), genres=table(spark, folder, "genre_names").select("genre"))
    return found.select("query_id", "rank_no", "id", "combined_score", "title_score", "field_score", "is_exact", "boost", "person_id")


def entity_registry_people(spark, folder):
    """ETL10, ETL11, ETL13, ETL14."""
    return _people(spark, folder).withColumn("roles", F.array_join("roles", ","))


def entity_registry_genres(spark, folder):
    """ETL10, ETL12."""
    r = cat.titles(spark, folder).select("id", F.explode("genres").alias("genre"))
    return cp.members(r, "genre", "genre", "id")


def entity_registry_tags(spark, folder):
    """ETL10, ETL15."""
    t = table(spark, folder, "tags").select(clean_key("movieId").alias("id"), "tag")
    return cp.members(t, "tag", "tag", "id")


def entity_page(spark, folder):
    """SO8, SO9, FL9: the second page of actors."""
    return en.page(_people(spark, folder), 2, 20, role="actor")


def entity_related(spark, folder):
    """JN16, SO9: the most rated movies of every genre."""
    edges = cat.titles(spark, folder).select(F.explode("genres").alias("entity_id"), F.col("id").alias("movie_id"))
    return en.related(edges, cat.records(spark, folder))


def typeahead_titles(spark, folder):
    """QY4, SO12: what the first six characters of each search query suggest."""
    q = cat.search_queries(spark, folder).withColumn("text", F.left(tx.exact_key(F.col("text")), F.lit(6)))
    r = cat.records(spark, folder).select("id", F.col("title").alias("name"), F.col("rating_count").alias("weight"))
    return en.typeahead(q, r).select("query_id", "rank_no", "id", "score")


def typeahead_people(spark, folder):
    """QY4: prefixes of people's own names."""
    p = _people(spark, folder).select(F.col("entity_id").alias("id"), "name", F.col("movie_count").alias("weight"))
    q = p.select(F.lower(F.left("name", F.lit(3))).alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    return en.typeahead(q, p).select("query_id", "rank_no", "id", "score")


def exact_people(spark, folder):
    """PL5, JN6, IX10: every name within a longer query, and all of the users' queries."""
    p = cut(_people(spark, folder))
    own = p.select(F.col("entity_id").alias("query_id"), F.concat(F.lit("films with "), F.col("name"), F.lit(" after 1990")).alias("text"))
    return co.exact_people(_all_queries(spark, folder).unionByName(own), p)


def partial_people(spark, folder):
    """PL6, JN11: last names without their last letter, looked up among all people."""
    p = _people(spark, folder)
    q = p.select(F.lower(F.substring_index("name", " ", -1)).alias("w")).where(F.length("w") >= 5).select(F.expr("left(w, length(w) - 1)").alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    return co.partial_people(q, p).select("query_id", "rank_no", "entity_id", "role", "popularity")


def fuzzy_person_join(spark, folder):
    """PL7, PL8, JN7, IX11: every name with a letter missing finds its person."""
    p = cut(_people(spark, folder))
    q = p.select("entity_id", F.concat(F.lit("films with "), F.lower("name")).alias("t")).select(F.col("entity_id").alias("query_id"), F.expr("left(t, length(t) - 1)").alias("text"))
    return co.person_corrections(q, p).select("query_id", "original", F.col("entity_id").alias("found_id"), "distance", "policy")


def genre_corrections(spark, folder):
    """PL9, JN10: every query, and all genres with their last letter missing."""
    names = table(spark, folder, "genre_names").select(tx.exact_key(F.col("genre")).alias("g")).where("g is not null")
    typos = names.select(F.concat(F.lit("typo:"), "g").alias("query_id"), F.concat(F.expr("left(g, length(g) - 1)"), F.lit(" movies")).alias("text"))
    return co.genre_corrections(_all_queries(spark, folder).unionByName(typos), table(spark, folder, "genre_names").select("genre")).select("query_id", "original", "replacement")


def control_corrections(spark, folder):
    """PL10, JN10: every query with "latset" before it."""
    q = _all_queries(spark, folder).withColumn("text", F.concat(F.lit("latset "), "text"))
    return co.control_corrections(q).select("query_id", "original", "replacement")


def recurring_title_phrases(spark, folder):
    """IX12, IX14."""
    return co.recurring_phrases(cat.titles(spark, folder))


def fuzzy_phrase_join(spark, folder):
    """PL12, JN8, IX13, WN4: every query, and all recurring phrases without their last letter."""
    phrases = cut(co.recurring_phrases(cat.titles(spark, folder)))
    typos = phrases.select(F.concat(F.lit("typo:"), "phrase").alias("query_id"), F.expr("left(phrase, length(phrase) - 1)").alias("text"))
    return co.phrase_corrections(co.title_targets(_all_queries(spark, folder).unionByName(typos)), phrases).select("query_id", "original", "replacement", "distance", "policy")


def title_corrections(spark, folder):
    """PL11-PL13, JN9, WN4 for every query."""
    return co.title_corrections(_all_queries(spark, folder), cat.titles(spark, folder))


def query_corrections(spark, folder):
    """PL14: the winning correction of each query."""
    genres = table(spark, folder, "genre_names").select("genre")
    return co.corrections(cut(_all_queries(spark, folder)), cut(cat.titles(spark, folder)), cut(_people(spark, folder)), genres)


def person_popularity_boost(spark, folder):
    """RK11, JN12, WN3, SO2: the records of each search query, those with its people first
    lifted by how known these are. A query's people are those of the records it found, the
    five with most movies."""
    q = cat.search_queries(spark, folder)
    r = cp.rating_evidence(cat.records(spark, folder))
    found = token_lookup(q, r).join(r.select("id", "title", "rating_count", "rating_evidence"), "id").withColumn("combined_score", tx.fixed(F.col("n_matched") / F.col("n_tokens") * 0.9, 6))
    base = cp.ranked_within(found, ["query_id"], [F.desc("combined_score"), F.desc("rating_count"), F.asc("id")], 100, "base_rank").withColumns({"prefix_match": F.lit(False), "title_intent": F.lit(False), "person_intent": F.lit(False)})
    base = cut(base)
    c = cut(credits(spark, folder).select(F.col("movie_id").alias("id"), F.lower("name").alias("person_id")).distinct())
    n = c.groupBy("person_id").agg(F.count("*").alias("popularity"))
    of_query = base.select("query_id", "id").join(c, "id").select("query_id", "person_id").distinct().join(n, "person_id")
    top = cp.ranked_within(of_query, ["query_id"], [F.desc("popularity"), F.asc("person_id")], 5, "person_rank")
    hints = base.select("query_id", "id").join(c, "id").join(top, ["query_id", "person_id"]).select("query_id", "id", "person_id", (F.col("person_rank") - 1).alias("person_rank"), "popularity")
    return rk.boost_people(base, hints).select("query_id", "rank_no", "id", "base_rank", "boost", "boosted_score", "occurrence", "person_id")


def _reviews(spark, folder):
    """Judgments as reviews: the reviewer is the year of the judgment."""
    p = table(spark, folder, "provisional")
    return p.select(clean_key(F.col("`query-id`")).alias("query_id"), clean_key(F.col("`corpus-id`")).alias("doc_id"), F.year("judged_at").cast("string").alias("reviewer_id"), F.col("score").alias("grade"), F.col("judged_at").alias("reviewed_at")).where("query_id is not null and doc_id is not null and grade >= 0")


def review_keep_last(spark, folder):
    """WN7."""
    return rv.latest_reviews(_reviews(spark, folder)).withColumn("reviewed_at", F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss"))


def judgment_status(spark, folder):
    """AG20."""
    return rv.judgment_status(rv.latest_reviews(_reviews(spark, folder)))


def _lists(spark, folder):
    """Nominating sources of each query: its latest run, its first run, its judgments."""
    runs = table(spark, folder, "tiny_run").select(clean_key("query_id").alias("query_id"), "results", "run_at").where("query_id is not null and run_at is not null")
    ends = runs.groupBy("query_id").agg(F.max("run_at").alias("hi"), F.min("run_at").alias("lo"))
    flat = runs.join(ends, "query_id").select("query_id", "run_at", "hi", "lo", F.explode("results").alias("r")).select("query_id", "run_at", "hi", "lo", clean_key(F.col("r.doc_id")).alias("doc_id"), F.col("r.score").alias("score")).where("doc_id is not null and score is not null and not isnan(score) and abs(score) < double('Infinity')")
    of = lambda name, no, rows: rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")).select("query_id", F.lit(name).alias("source"), F.lit(no).alias("source_no"), "doc_id", "score")
    judged = ev.qrels(table(spark, folder, "provisional")).select("query_id", F.lit("judged").alias("source"), F.lit(2).alias("source_no"), "doc_id", F.col("grade").cast("double").alias("score"))
    return of("current", 0, flat.where("run_at = hi")).unionByName(of("baseline", 1, flat.where("run_at = lo"))).unionByName(judged)


def pool_round_robin(spark, folder):
    """SO13, WN8, WN9, QY8."""
    return rv.interleave(rv.nominate(_lists(spark, folder)))


def review_progress(spark, folder):
    """AG19, JN18: the pool's documents against the reviews."""
    return rv.progress(rv.interleave(rv.nominate(_lists(spark, folder))), rv.judgment_status(rv.latest_reviews(_reviews(spark, folder))))


def baseline_compare(spark, folder):
    """JN20, AG27: the first run of each query against its latest."""
    judged = ev.qrels(table(spark, folder, "provisional"))
    runs = table(spark, folder, "tiny_run").where("run_at is not null")
    early = runs.withColumn("run_at", F.timestamp_micros(-F.unix_micros(F.col("run_at").cast("timestamp"))))
    m = ["precision_at_k", "reciprocal_rank", "ndcg_at_k"]
    out = ev.compare(ev.evaluate(judged, ev.latest_runs(early)), ev.evaluate(judged, ev.latest_runs(runs)), m)
    return out.select("query_id", *[tx.fixed(F.col(f"delta_{x}"), 6).alias(f"delta_{x}") for x in m], "is_worse")


def _trials(spark, folder):
    runs = table(spark, folder, "tiny_run").select(clean_key("query_id").alias("case_id"), "latency_ms", "results", "run_at").where("case_id is not null and run_at is not null")
    return runs.select("case_id", (F.size(F.coalesce("results", F.expr("array()"))) >= 10).cast("int").alias("passed"), F.date_format("run_at", "yyyy-MM").alias("month"), F.length("case_id").alias("width"))


def case_summary_grouping_sets(spark, folder):
    """AG22: runs with a full first page, overall, by month and by kind of key."""
    t = _trials(spark, folder).withColumn("kind", F.when(F.col("case_id").rlike("^q[0-9]{8}$"), "regular").otherwise("other"))
    return ev.grouping_report(t, ["month", "kind"], [F.count("*").alias("trials"), F.sum("passed").alias("passed")]).select("month", "kind", "trials", "passed")


def case_pass_rates(spark, folder):
    """AG21."""
    r = ev.case_rates(_trials(spark, folder), "case_id", "passed")
    return r.select("cases", "trials", *[tx.fixed(F.col(c), 6).alias(c) for c in ("pass_rate", "deviation", "low", "high")], "flaky")


def hash_shuffle_sample(spark, folder):
    """About a quarter of the movies, the same on every engine: by the hash alone."""
    m = table(spark, folder, "movies").select(clean_key("movieId").alias("id")).where("id is not null").distinct()
    return rv.hash_sample(m, "id", "calibration").select("id", tx.revision(F.col("id")).alias("revision"))


def hash_shuffle_every_fourth(spark, folder):
    """TX31, QY15: every fourth movie of the order by SHA-256."""
    m = table(spark, folder, "movies").select(clean_key("movieId").alias("id")).where("id is not null").distinct()
    return rv.calibration_sample(m, "id", "calibration").select("id", tx.revision(F.col("id")).alias("revision"))


def _alias_entities(spark, folder):
    return cat.titles(spark, folder).select(F.col("id").alias("entity_id"), F.col("title").alias("name"))


def alias_coverage(spark, folder):
    """IX16, AG31."""
    return ml.alias_coverage(ml.alias_catalog(_alias_entities(spark, folder)))


def unicode_alias_match(spark, folder):
    """TX19-TX25, IX16, IX17."""
    return ml.match_aliases(cat.search_queries(spark, folder), ml.alias_catalog(_alias_entities(spark, folder))).withColumn("score", tx.fixed(F.col("score"), 6))


def alias_suggestions(spark, folder):
    """IX18."""
    q = cat.search_queries(spark, folder).withColumn("text", F.left("text", F.lit(5)))
    return ml.suggest_aliases(q, ml.alias_catalog(_alias_entities(spark, folder))).select("query_id", "rank_no", "entity_id", "score")


def query_grounding(spark, folder):
    """IX19."""
    return ml.ground(cat.search_queries(spark, folder), ml.alias_catalog(_alias_entities(spark, folder))).withColumn("score", tx.fixed(F.col("score"), 6))


def genre_grammar(spark, folder):
    """PL23, QY3: the genres' names as requests in their three scripts, answered."""
    names = spark.createDataFrame([(f"{g}:{i}", n + " movies") for g, t in ml.GENRE_TERMS.items() for i, n in enumerate(t)] + [("pair", "comedy and drama films"), ("either", "horror ya thriller")], "query_id string, text string")
    supported = sorted(set(cat.genre_aliases(spark, folder).values()))
    return ml.retrieve(ml.genre_requests(names, supported), cp.rating_evidence(cat.records(spark, folder)))


def _multilingual(spark, folder):
    """(plans, records, people, credits) for all queries and every genre's names as requests."""
    r = cut(cp.rating_evidence(records_with_people(spark, folder)))
    c = cut(credits(spark, folder).select(F.concat(F.lit("person:name:"), tx.slug(F.col("name"))).alias("entity_id"), "role", "movie_id").distinct())
    people = cut(_people(spark, folder))
    asked = spark.createDataFrame([(f"{g}:{i}", n) for g, t in ml.GENRE_TERMS.items() for i, n in enumerate(t)], "query_id string, text string")
    films = ml.alias_catalog(r.where("title <> ''").select(F.col("id").alias("entity_id"), F.col("title").alias("name")))
    names = ml.alias_catalog(people.select("entity_id", "name"))
    plans = mp.plan_requests(cat.all_queries(spark, folder).unionByName(asked), r, cut(films), cut(names), people, table(spark, folder, "genre_names").select("genre"), cat.genre_aliases(spark, folder))
    return plans, r, people.select("entity_id", "name", F.array().cast("array<string>").alias("movie_ids")), c


def multilingual_plans(spark, folder):
    """PL20, PL24-PL26, JN21: how each request is read, without a model."""
    plans = _multilingual(spark, folder)[0]
    return plans.select("query_id", "mode", "intent", "strategy", F.size("title_matches").alias("n_titles"), F.size("groups").alias("n_people"), F.array_join(F.array_sort("genres"), "|").alias("genres"), "genre_mode", *mp.BOUNDS, "sort_field", F.array_join("unresolved", "; ").alias("unresolved"), "is_structured", "is_blocked")


def multilingual_answers(spark, folder):
    """QY3, SO5, JN13, JN14, FL3: the first 24 films of each request that is understood."""
    return mp.answer(*_multilingual(spark, folder)).select("query_id", "rank_no", "id", tx.fixed(F.col("score"), 6).alias("score"), "total")


def catalogue_match_band(spark, folder):
    """JN15: every title, a year off, finds its movie again."""
    t = cat.titles(spark, folder)
    people = credits(spark, folder).groupBy("movie_id").agg(F.collect_set("name").alias("people"))
    films = t.join(people.withColumnRenamed("movie_id", "id"), "id", "left").select("id", "title", "year", F.coalesce("people", F.array().cast("array<string>")).alias("people"))
    wanted = films.select(F.col("id").alias("candidate_id"), "title", (F.col("year") + 1).alias("year"), F.when(F.size("people") > 0, F.array_min("people")).alias("person"))
    return ml.match_catalogue(wanted, films)


def query_plans(spark, folder):
    """PL14, PL17-PL22: the whole plan of every query."""
    from reelrank.plans.planner import plan_queries

    p = plan_queries(_all_queries(spark, folder), cut(cat.titles(spark, folder)), cut(_people(spark, folder)), table(spark, folder, "genre_names").select("genre"), cat.genre_aliases(spark, folder))
    return p.select("query_id", "effective_query", "correction", F.array_join("person_ids", ",").alias("people"), F.array_join(F.array_sort("genres"), "|").alias("genres"), "year_min", "year_max", "rating_min", "title_query", "field_query", "strategy", "intent", F.array_join("concepts", " ").alias("concepts"), "sort_source")


def judgment_pool(spark, folder):
    """QY12, FL4, SO11: what each search query's filters keep where a missing year counts as
    0, the best rated first."""
    from reelrank.operators import index as ix

    r = cut(cat.records(spark, folder))
    plans = cut(sr.plan(cat.search_queries(spark, folder), cat.genre_aliases(spark, folder)))
    found = ix.filtered(plans.where("has_metadata"), r, null_year_is_zero=True)
    j = found.join(r.select("id", "title", "average_rating", "rating_count"), "id")
    return cp.ranked_within(j, ["query_id"], [F.desc_nulls_last("average_rating"), F.desc("rating_count"), F.asc("title"), F.asc("id")], 20).select("query_id", "rank_no", "id", "rating_count")


#: The weightings that are compared: focus, Bayesian rating, evidence.
EVIDENCE_STRATEGIES = [(15, 55, 30), (10, 20, 70), (10, 80, 10)]


def genre_evidence(spark, folder):
    """QY11, WN9, WN10: every genre's first ten by the raw average, then by three weightings of the
    structured score, pooled: each record's first strategy and best rank."""
    rows = cp.rating_evidence(cat.records(spark, folder))
    held = rows.select("*", F.explode(F.array_distinct("genres")).alias("genre")).withColumn("wanted", F.array("genre"))
    held = held.withColumn("genre_focus", rk.genre_focus(F.col("wanted"), F.col("genres"))[1])
    average = F.coalesce("average_rating", F.lit(0.0))
    scores = [F.struct(F.lit(0).alias("strategy"), average.alias("score"), F.lit(0.0).alias("average"))]
    scores += [F.struct(F.lit(i).alias("strategy"), rk.structured_genre_score(F.size("wanted"), dict(zip(("genre_focus", "bayesian_rating", "rating_evidence"), w))).alias("score"), F.when(F.col("eligible"), average).otherwise(0.0).alias("average")) for i, w in enumerate(EVIDENCE_STRATEGIES, 1)]
    lists = held.select("genre", "id", "title", "rating_count", F.explode(F.array(*scores)).alias("s")).select("genre", "id", "title", "rating_count", "s.*")
    top = cp.ranked_within(lists, ["genre", "strategy"], [F.desc("score"), F.desc("average"), F.desc("rating_count"), F.asc("title"), F.asc("id")], 10)
    return top.groupBy("genre", "id").agg(F.min("strategy").alias("first_strategy"), F.min("rank_no").alias("best_rank"), F.count("*").alias("n_strategies"))


_ALL = [title_search_flagship, planned_search, multilingual_plans, multilingual_answers, query_plans, judgment_pool, genre_evidence, entity_registry_people, entity_registry_genres, entity_registry_tags, entity_page, entity_related, typeahead_titles, typeahead_people, exact_people, partial_people, fuzzy_person_join, genre_corrections, control_corrections, recurring_title_phrases, fuzzy_phrase_join, title_corrections, query_corrections, person_popularity_boost, review_keep_last, judgment_status, pool_round_robin, review_progress, baseline_compare, case_summary_grouping_sets, case_pass_rates, hash_shuffle_sample, hash_shuffle_every_fourth, alias_coverage, unicode_alias_match, alias_suggestions, query_grounding, genre_grammar, catalogue_match_band]
QUERIES = {f.__name__: f for f in _ALL}
