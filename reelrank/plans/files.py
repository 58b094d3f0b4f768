"""Queries of the sources and sinks: the tables are written in each format and read again. The files
lie in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.operators import corpus as cp
from reelrank.operators import evaluation as ev
from reelrank.operators import review as rv
from reelrank.plans import catalogue as cat
from reelrank.plans import people as pe
from reelrank.plans import search as sr
from reelrank.plans.people_sql import PEOPLE, REVIEWS
from reelrank.plans.records import sql_key
from reelrank.plans.sql import EVAL, TITLES
from reelrank.plans.sql import ORACLE as CATALOGUE
from reelrank.plans.texts import ukey
from reelrank.runtime import checkpoint_dir, clean_key, table
from reelrank.sources import readers, sinks


def _place(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def corpus_jsonl(spark, folder):
    """SNK1, SNK2, SRC1, SRC2, SRC19: the corpus as JSONL, read again."""
    path = _place(spark)
    sinks.write_jsonl(cat.corpus(spark, folder), path)
    lines = readers.count_lines(spark, path)
    m = F.col("metadata")
    return readers.load_documents(spark, path).select("_id", "title", m["year"].alias("year"), m["rating_count"].alias("rating_count"), F.lit(lines).cast("bigint").alias("n_lines"))


def csv_tables(spark, folder):
    """SRC8: movies, tags and links as CSV, read with their schemas: the rows of each and their values."""
    out = None
    for name, cols in (("movies", ["movieId", "title", "genres"]), ("tags", ["userId", "movieId", "tag"]), ("links", ["movieId", "imdbId", "tmdbId"])):
        path = f"{_place(spark)}/{name}"
        flat = [F.regexp_replace(F.col(c), "[\r\n]", " ").alias(c) if t == "string" else F.col(c) for c, t in table(spark, folder, name).dtypes]
        table(spark, folder, name).select(*flat).write.option("header", True).option("escape", '"').option("nullValue", "\\N").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        back = readers.read_csv(spark, path, name, null="\\N")
        one = back.agg(F.lit(name).alias("tbl"), F.count("*").alias("n"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)], *[F.sum(F.length(F.col(c).cast("string"))).alias(f"length_{i}") for i, c in enumerate(cols)])
        out = one if out is None else out.unionByName(one)
    return out


def dataset_files(spark, folder):
    """SNK6, SRC3, SRC4, SRC5, SRC6, SRC12, SRC16, SRC20: documents, queries and judgments in their three
    files, loaded with all checks; judgments by category."""
    place = _place(spark)
    docs, q = cat.corpus(spark, folder), table(spark, folder, "queries").select(clean_key("_id").alias("_id"), "text", "metadata").where("_id is not null and text is not null").groupBy("_id").agg(F.min(F.struct("text", "metadata")).alias("q")).select("_id", "q.*")
    judged = ev.qrels(table(spark, folder, "provisional")).join(docs.select(F.col("_id").alias("doc_id")), "doc_id", "left_semi").join(q.select(F.col("_id").alias("query_id")), "query_id", "left_semi")
    known = judged.where("grade > 0").select("query_id").distinct()
    judged = judged.join(known, "query_id", "left_semi").select("query_id", "doc_id", "grade")
    lines, _ = sinks.draft_lines(q, judged)
    sinks.write_jsonl(docs, f"{place}/corpus.jsonl")
    lines.write.text(f"{place}/queries.jsonl")
    sinks.write_tsv(judged.select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("grade").alias("score")), f"{place}/qrels/test.tsv")
    ds = readers.load_dataset(spark, readers.first_readable(spark, [f"{place}/nowhere", place]))
    return ds.qrels.join(ds.queries.select(F.col("_id").alias("query_id"), "category"), "query_id").groupBy("category").agg(F.count("*").alias("judgments"), F.count_distinct("query_id").alias("queries"), F.sum("grade").cast("bigint").alias("grades"))


def run_jsonl(spark, folder):
    """SNK3, SRC7, SRC21: the latest runs as JSONL, loaded with all checks."""
    path = _place(spark)
    runs = ev.latest_runs(table(spark, folder, "tiny_run"))
    ok = lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf")))
    flat = runs.select("query_id", "latency_ms", F.explode("results").alias("r")).select("query_id", "latency_ms", clean_key(F.col("r.doc_id")).alias("doc_id"), F.col("r.score").alias("score")).where(F.col("doc_id").isNotNull() & ok(F.col("score")))
    best = flat.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    latency = runs.select("query_id", F.when(ok(F.col("latency_ms")) & (F.col("latency_ms") >= 0), F.col("latency_ms")).alias("latency_ms"))
    lists = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("l")).select("query_id", F.transform("l", lambda x: F.struct(x["doc_id"].alias("doc_id"), (-x["s"]).alias("score"))).alias("results"))
    sinks.write_jsonl(lists.join(latency, "query_id").select("query_id", "latency_ms", F.lit(None).cast("array<string>").alias("candidate_ids"), "results"), path)
    back = readers.load_run(spark, path)
    return back.select("query_id", F.col("latency_ms").isNotNull().alias("is_timed"), F.size("results").alias("n_results"), F.get(F.transform("results", lambda r: r["doc_id"]), F.lit(0)).alias("first_doc"), F.get(F.transform("results", lambda r: r["doc_id"]), F.size("results") - 1).alias("last_doc"))


def pool_tsv(spark, folder):
    """SNK5, TX32: the queries' texts as a TSV, tabs and line breaks as spaces, read again."""
    path = _place(spark)
    rows = table(spark, folder, "documents").select("doc_id", "text").where("doc_id is not null and text is not null")
    sinks.write_tsv(rows, path)
    back = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("maxCharsPerColumn", -1).csv(path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").alias("n"), F.substring("text", 1, 30).alias("head"))


def release_files(spark, folder):
    """SNK8, SRC17, SRC18, SRC19: a gzipped release with its manifest, verified and read again."""
    place = _place(spark)
    tables = {"movies": cat.titles(spark, folder).coalesce(4), "links": table(spark, folder, "links").coalesce(4)}
    sinks.write_release(tables, place, "release-1", "2999-01-01")
    manifest, found = readers.read_release(spark, place, "2026-01-01")
    whole = found.agg(F.bool_and("is_whole").alias("w")).first()[0]
    out = None
    for name in sorted(tables):
        one = spark.read.json(f"{place}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(bool(whole)).alias("is_whole"), F.lit(any(f.startswith(name) for f in manifest["files"])).alias("is_listed"))
        out = one if out is None else out.unionByName(one)
    return out


def report_lines(spark, folder):
    """SNK4, SNK9: the report by category as Markdown, line by line."""
    c = table(spark, folder, "queries").select(clean_key("_id").alias("query_id"), F.col("metadata.category").alias("category")).groupBy("query_id").agg(F.min("category").alias("category"))
    s = ev.by_category(ev.evaluate(cat._judged(spark, folder), ev.latest_runs(table(spark, folder, "tiny_run")), categories=c))
    lines = sinks.report_markdown(s.select("category", "queries").orderBy("category"), "By category").strip().split("\n")
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "line_no int, line string")


def case_cube(spark, folder):
    """SNK10: judgments by category of the query and by grade, with all totals."""
    c = table(spark, folder, "queries").select(clean_key("_id").alias("query_id"), F.col("metadata.category").alias("category")).where("query_id is not null").groupBy("query_id").agg(F.coalesce(F.min("category"), F.lit(readers.UNCATEGORIZED)).alias("category"))
    return sinks.case_workbook(cat._judged(spark, folder).join(c, "query_id").select("category", F.col("grade").cast("string").alias("status")))


def reviewed_files(spark, folder):
    """SNK7, ST6: queries whose documents all have a final grade, with their judgments, and the trail. Single
    reviews are adjudicated as they are."""
    reviews = rv.latest_reviews(pe._reviews(spark, folder))
    single = reviews.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.max("grade").alias("final_grade")).where("n = 1")
    status = rv.judgment_status(reviews, single)
    queries, judged = sinks.reviewed_split(status.select("query_id").distinct(), status)
    trail = rv.audit(reviews.select("query_id", "doc_id", "grade"), judged)
    per = trail.groupBy("query_id").agg(F.count_if(F.col("kind") == "review").alias("reviews"), F.count_if(F.col("kind") == "adjudication").alias("final"))
    return queries.join(per, "query_id")


def _payload(spark, folder):
    """What a film database would send: the people that the texts name, in the order of their names."""
    c = pe.credits(spark, folder).select("movie_id", "role", "name").distinct()
    ranked = c.groupBy(F.col("movie_id").alias("_id")).agg(F.array_sort(F.collect_set(F.when(F.col("role") == "actor", F.col("name")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("role") == "director", F.col("name")))).alias("d"))
    person = lambda n: F.struct(F.lit(None).cast("bigint").alias("id"), n.alias("name"))
    crew = lambda n: F.struct(F.lit(None).cast("bigint").alias("id"), n.alias("name"), F.lit("Director").alias("job"))
    other = F.array(F.struct(F.lit(None).cast("bigint").alias("id"), F.lit("Somebody Else").alias("name"), F.lit("Writer").alias("job")))
    tags = cp.tag_lists(table(spark, folder, "tags")).select(F.col("id").alias("_id"), "tags")
    none = F.array().cast("array<string>")
    r = ranked.join(tags, "_id", "left").withColumn("tags", F.array_sort(F.coalesce("tags", none)))
    return r.select("_id", F.struct(F.transform("a", person).alias("cast"), F.concat(other, F.transform("d", crew)).alias("crew")).alias("credits"), F.struct(F.transform("tags", person).alias("keywords")).alias("keywords"), F.lit("").alias("overview"), F.when(F.size("d") > 0, F.lit("/poster.jpg")).alias("poster_path"))


def enrichment_projection(spark, folder):
    """SRC11, SRC14, SRC15, TX28: the payloads' first twelve actors, directors and keywords, what is complete
    and what is still to be fetched."""
    e = readers.project_enrichment(_payload(spark, folder))
    done = e.withColumn("is_complete", readers.is_complete())
    todo = readers.pending(cat.titles(spark, folder).select(F.col("id").alias("_id")), e).withColumn("is_pending", F.lit(True))
    j = todo.join(done, "_id", "full")
    return j.select("_id", F.coalesce("is_pending", F.lit(False)).alias("is_pending"), F.coalesce("is_complete", F.lit(False)).alias("is_complete"), F.coalesce(F.size("cast"), F.lit(0)).alias("n_cast"), F.array_join(F.transform("directors", lambda p: p["name"]), "|").alias("directors"), tx.poster_url(F.col("poster_path"), "w342", "https://images.example").alias("poster"))


def enrichment_merge(spark, folder):
    """SRC13, ETL8, ETL9, JN2: the old cache (movies without directors) and the new payloads merged, and how
    many documents have enrichment."""
    e = readers.project_enrichment(_payload(spark, folder))
    _, counts = readers.merge_cache(e.where(F.size("directors") == 0), e.where(F.size("cast") > 0))
    names = lambda c: F.transform(c, lambda p: p["name"]).alias(c)
    docs = cp.enrich(cat.corpus(spark, folder), e.select("_id", names("cast"), names("directors"), names("keywords"), "overview"))
    return counts.crossJoin(F.broadcast(cp.coverage(docs)))  # one row each


def alias_import(spark, folder):
    """SRC22, ETL19: aliases of payloads (the title, its translation without the article) replace those of
    their source for the movies with an even number."""
    t = cat.titles(spark, folder).where("title <> ''").select(F.col("id").alias("_id"), "title")
    payload = t.select("_id", F.col("title").alias("original_title"), F.lit("en").alias("original_language"), F.array(F.struct(F.lit("hi").alias("language"), tx.without_article(F.col("title")).alias("title")), F.struct(F.lit("fr").alias("language"), F.lit("Autre").alias("title"))).alias("translations"), F.array(F.struct(F.lit("IN").alias("country"), F.concat("title", F.lit(" 1")).alias("title")), F.struct(F.lit("DE").alias("country"), F.lit("Anders").alias("title"))).alias("alternatives"))
    found = readers.movie_aliases(payload)
    even = t.where(F.pmod(F.col("_id").try_cast("bigint"), F.lit(2)) == 0).select("_id")
    old = t.select("_id", F.lit("old").alias("text"), F.lit("film").alias("source")).unionByName(t.select("_id", F.lit("own").alias("text"), F.lit("hand").alias("source")))
    fresh = found.join(even, "_id", "left_semi").select("_id", "text", F.lit("film").alias("source"))
    return readers.import_aliases(old, fresh, even, "film").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("_id").alias("movies"), F.count_if(F.col("text") == "old").alias("n_old"))


def search_run(spark, folder):
    """SNK3: the search's results as a run: how many of each query, the first and the last."""
    found = sr.to_run(sr.search(cat.search_queries(spark, folder), cat.records(spark, folder), 10, cat.genre_aliases(spark, folder)))
    return found.select("query_id", F.size("results").alias("n_results"))


_ALL = [corpus_jsonl, csv_tables, dataset_files, run_jsonl, pool_tsv, release_files, report_lines, case_cube, reviewed_files, enrichment_projection, enrichment_merge, alias_import]
QUERIES = {f.__name__: f for f in _ALL}

_KEYS = {c: sql_key(f'"{c}"') for c in ("movieId", "_id", "query-id", "corpus-id", "query_id")}
_QRELS = f"""jd as (select {_KEYS['query-id']} query_id, {_KEYS['corpus-id']} doc_id, max(score) grade from provisional
  where score >= 0 and {_KEYS['query-id']} is not null and {_KEYS['corpus-id']} is not null group by 1, 2)"""
_CATEGORY = f"""ct as (select {_KEYS['_id']} query_id, coalesce(min(metadata.category), 'uncategorized') category from queries where {_KEYS['_id']} is not null group by 1)"""
_NAMES = f"""{PEOPLE.split(', pm as')[0]}, nm as (select movie_id, list_sort(list(distinct "name") filter (role = 'actor')) a, list_sort(list(distinct "name") filter (role = 'director')) d from cr group by 1)"""

ORACLE = {
    "corpus_jsonl": f"""select _id, title, "year", rating_count, count(*) over () n_lines from ({CATALOGUE['corpus_documents']})""",
    "csv_tables": " union all ".join(
        f"select '{t}' tbl, count(*) n, " + ", ".join(f'count("{c}") n_{i}' for i, c in enumerate(cs)) + ", " + ", ".join(f'sum(length("{c}"::varchar))::bigint length_{i}' for i, c in enumerate(cs)) + f" from {t}"
        for t, cs in (("movies", ["movieId", "title", "genres"]), ("tags", ["userId", "movieId", "tag"]), ("links", ["movieId", "imdbId", "tmdbId"]))
    ),
    "dataset_files": f"""with {_QRELS}, qs as (select {_KEYS['_id']} query_id, min(struct_pack(t := text, m := metadata)) q from queries where text is not null and {_KEYS['_id']} is not null group by 1),
k as (select jd.* from jd join qs using (query_id) where doc_id in (select {_KEYS['movieId']} from movies where {_KEYS['movieId']} is not null)),
p as (select * from k where query_id in (select query_id from k where grade > 0))
select coalesce(q.m.category, 'uncategorized') category, count(*) judgments, count(distinct query_id) queries, sum(grade)::bigint grades from p join qs using (query_id) group by 1""",
    "run_jsonl": f"""with {EVAL.split('), px as')[0]}), f as (
  select query_id, {sql_key('r.doc_id')} doc_id, max(r.score) s from (select query_id, unnest(results) r from lr) where {sql_key('r.doc_id')} is not null and r.score is not null and isfinite(r.score) group by 1, 2)
select query_id, bool_or(coalesce(isfinite(latency_ms) and latency_ms >= 0, false)) is_timed, max(n)::int n_results, any_value(a) first_doc, any_value(z) last_doc
from (select query_id, count(*) n, arg_min(doc_id, (-s, doc_id)) a, arg_max(doc_id, (-s, doc_id)) z from f group by 1) join lr using (query_id) group by 1""",
    "alias_import": f"""with {TITLES}, t as (select id, title, coalesce(try_cast(id as bigint) % 2 = 0, false) even from titles where title <> ''),
a as (select id, count(distinct k) n from (select id, unnest([{ukey('title')}, {ukey("regexp_replace(title, '^(?i)(a|an|the)[ ]+', '')")}, {ukey("title || ' 1'")}]) k from t where even) where k <> '' group by 1)
select 'hand' source, count(*) n, count(*) movies, 0 n_old from t union all select 'film', (select sum(n) from a)::bigint + count(*) filter (not even), (select count(*) from a) + count(*) filter (not even), count(*) filter (not even) from t""",
    "pool_tsv": """with t as (select doc_id, regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g') x from documents where doc_id is not null and text is not null) select doc_id, length(x)::int n, substr(x, 1, 30) head from t""",
    "release_files": f"""select 'links' "name", count(*) n_rows, true is_whole, true is_listed from links union all select 'movies', count(distinct {_KEYS['movieId']}), true, true from movies""",
    "case_cube": f"with {_QRELS}, {_CATEGORY} select category, grade::varchar status, count(*) n from jd join ct using (query_id) group by cube (category, grade::varchar)",
    "report_lines": f"""with {_QRELS}, {_CATEGORY}, c as (select coalesce(ct.category, 'uncategorized') category, count(distinct query_id) n from jd left join ct using (query_id) group by 1)
select 0 line_no, '## By category' line union all select 1, '' union all select 2, '| category | queries |' union all select 3, '| --- | --- |' union all select (3 + row_number() over (order by category))::int, '| ' || category || ' | ' || n || ' |' from c""",
    "reviewed_files": f"""with {REVIEWS}, ok as (select query_id from js group by 1 having bool_and(final_grade is not null or n_reviews = 1))
select query_id, (select count(*) from lt where lt.query_id = ok.query_id) reviews, (select count(*) from js where js.query_id = ok.query_id) "final" from ok""",
    "enrichment_projection": f"""with {_NAMES}, m as (select distinct {_KEYS['movieId']} id from movies where {_KEYS['movieId']} is not null)
select coalesce(m.id, nm.movie_id) _id, m.id is not null and coalesce(len(d), 0) = 0 is_pending, coalesce(len(d), 0) > 0 is_complete, least(12, coalesce(len(a), 0))::int n_cast, case when nm.movie_id is not null then coalesce(array_to_string(d, '|'), '') end directors,
  case when len(d) > 0 then 'https://images.example/w342/poster.jpg' end poster from m full join nm on m.id = nm.movie_id""",
    "enrichment_merge": f"""with {_NAMES}, m as (select distinct {_KEYS['movieId']} id from movies where {_KEYS['movieId']} is not null), x as (select *, coalesce(len(d), 0) = 0 o, coalesce(len(a), 0) > 0 w from nm),
c as (select count(*) filter (w and not o) updated, count(*) filter (w and o) unchanged, count(*) filter (o and not w) kept, count(*) filter ((w or o) and coalesce(len(d), 0) = 0) without_poster from x)
select c.*, (select count(*) from m) documents, (select count(*) from m join nm on id = movie_id) enriched, round((select count(*) from m join nm on id = movie_id)::double / (select count(*) from m), 4) coverage from c""",
}
