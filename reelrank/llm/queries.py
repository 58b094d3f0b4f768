"""Queries of problems 3 to 10 over the project's tables, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.llm import collapse, cooccur, mixing, packing, percentile, spam, termfreq, tokens, topn
from reelrank.llm.forms import form_udf, words_udf
from reelrank.runtime import clean_key, cut, table

#: Fixed by the problem statements.
MIN_TOGETHER, MIN_LIFT = 5, 3
RARE_BELOW, COMMON_ABOVE = 3, 0.1
BEST = 10
#: The chi-square bound of one in a thousand with one degree of freedom.
SIGNIFICANT = 10.83
#: Container sizes that one run packs for, at most.
MAX_LIMITS = 1000


def movie_tags(spark: SparkSession, folder: str) -> DataFrame:
    """(movie_id, tag, form), rows with a key and a form only."""
    tags = table(spark, folder, "tags").select(clean_key("movieId").alias("movie_id"), "tag").where("movie_id is not null and tag is not null")
    return tags.withColumn("form", form_udf("tag")).where("form is not null")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs that stand together on at least five movies, with lift and ratio."""
    return cooccur.cooccurrence(movie_tags(spark, folder), "movie_id", "form", MIN_TOGETHER)


def p3_significant(spark: SparkSession, folder: str) -> DataFrame:
    """Of these the pairs whose ratio chance gives once in a thousand, above chance."""
    return cooccur.cooccurrence(movie_tags(spark, folder), "movie_id", "form", MIN_TOGETHER, min_ratio=SIGNIFICANT).where("lift > 1")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = p3_pairs(spark, folder)
    return pairs.where(F.col("n_ab") * F.col("n") >= MIN_LIFT * F.col("n_a") * F.col("n_b")).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    """(fld, term, n_occurrences, n_records, total_records, mark) for every term."""
    tags = cut(movie_tags(spark, folder).groupBy("movie_id", "form").agg(F.count("*").alias("tf")))
    n_tagged = tags.select("movie_id").distinct().count()
    of_tags = termfreq.term_frequencies(tags, "movie_id", "form", "tf", n_tagged, RARE_BELOW, COMMON_ABOVE)
    movies = table(spark, folder, "movies").select(clean_key("movieId").alias("movie_id"), "title").where("movie_id is not null and title is not null")
    titles = cut(movies.groupBy("movie_id").agg(F.min("title").alias("title")))
    n_titled = titles.count()
    of_titles = termfreq.term_frequencies(titles.select("movie_id", F.explode(words_udf("title")).alias("word")), "movie_id", "word", None, n_titled, RARE_BELOW, COMMON_ABOVE)
    return of_tags.select(F.lit("tag").alias("fld"), "*").unionByName(of_titles.select(F.lit("title").alias("fld"), "*"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_terms(spark, folder).where("mark is not null").select("fld", "term", "mark")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "tiny_run").select(clean_key("query_id").alias("query_id"), F.explode("results").alias("r")).where("query_id is not null")
    rows = runs.select("query_id", clean_key(F.col("r.doc_id")).alias("doc_id"), F.col("r.score").alias("score"))
    best = topn.top_n(rows, "query_id", "doc_id", "score", BEST)
    return best.select(F.col("grp").alias("query_id"), "rank_no", F.col("item").alias("doc_id"))


def rounded(found: DataFrame) -> DataFrame:
    """Percentiles of a report to six decimals."""
    return found.withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p95", "p99")})


def rating_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """(movie_id, month, bucket, n) of the valid ratings; month counts from year 0."""
    ratings = table(spark, folder, "ratings").where("rating >= 0.5 and rating <= 5 and timestamp is not null")
    day = F.date_from_unix_date(F.expr("(timestamp - pmod(timestamp, 86400)) div 86400").cast("int"))
    rows = ratings.select(clean_key("movieId").alias("movie_id"), (F.year(day) * 12 + F.month(day) - 1).alias("month_no"), "rating").where("movie_id is not null")
    return percentile.sketch(rows, ["movie_id", "month_no"], "rating")


def month_name(no: str) -> Column:
    year, month = F.expr(f"{no} div 12"), F.expr(f"{no} % 12 + 1")
    return F.concat(F.lpad(year.cast("string"), 4, F.lit("0")), F.lit("-"), F.lpad(month.cast("string"), 2, F.lit("0")))


def p6_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the ratings per movie and month."""
    found = percentile.percentiles(rating_sketch(spark, folder), ["movie_id", "month_no"])
    return rounded(found).select("movie_id", month_name("month_no").alias("month"), "n_values", "p50", "p90", "p95", "p99")


def p6_ratings_all(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per movie over the union of all months, from the same sketches."""
    return rounded(percentile.percentiles(percentile.merge(rating_sketch(spark, folder), ["movie_id"]), ["movie_id"]))


def latency_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """(category, day, bucket, n) of the finite latencies from 0 up. Runs of unknown queries
    and of queries without a category are the category null."""
    runs = table(spark, folder, "tiny_run").where("latency_ms >= 0").select(clean_key("query_id").alias("query_id"), F.col("run_at").cast("date").alias("day"), "latency_ms").where("query_id is not null and day is not null")
    own = percentile.sketch(runs, ["query_id", "day"], "latency_ms")
    queries = table(spark, folder, "queries").select(clean_key("_id").alias("query_id"), F.col("metadata.category").alias("category")).where("query_id is not null").groupBy("query_id").agg(F.min("category").alias("category"))
    return percentile.merge(own.join(queries, "query_id", "left"), ["category", "day"])


def p6_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the latencies per query category and day."""
    found = percentile.percentiles(latency_sketch(spark, folder), ["category", "day"])
    return rounded(found).select("category", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_values", "p50", "p90", "p95", "p99")


def p6_latency_months(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per category and month: the days' sketches, combined."""
    months = latency_sketch(spark, folder).withColumn("month", F.date_format("day", "yyyy-MM"))
    return rounded(percentile.percentiles(percentile.merge(months, ["category", "month"]), ["category", "month"]))


def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One row per movie and tag form: how many rows and spellings it has, and one of them."""
    tags = table(spark, folder, "tags").select(clean_key("movieId").alias("movie_id"), "tag")
    found = collapse.collapse_copies(tags, ["movie_id"], "tag")
    return found.where("pos = 0").select(F.col("key_0").alias("movie_id"), "form", F.col("spelling").alias("tag"), "n_spellings", "n_copies")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    tags = table(spark, folder, "tags").select(clean_key("movieId").alias("movie_id"), "tag")
    pairs = collapse.spelling_pairs(cut(collapse.collapse_copies(tags, ["movie_id"], "tag")), ["key_0"])
    return pairs.select(F.col("key_0").alias("movie_id"), F.col("spelling_a").alias("tag_a"), F.col("spelling_b").alias("tag_b"))


def sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text").where("doc_id is not null and text is not null")
    return cut(docs.select("doc_id", "source", tokens.tokens_udf()("text").alias("n_tokens")))


def pack_limits(spark: SparkSession, folder: str) -> list:
    """(limit_name, capacity_tokens) of every container; more than MAX_LIMITS raise an error."""
    rows = table(spark, folder, "pack_limits").select("limit_name", "capacity_tokens").where("capacity_tokens is not null").distinct().limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} container sizes")
    return sorted(rows, key=lambda r: (r.capacity_tokens, r.limit_name or ""))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of all permitted capacities, chosen jointly."""
    limits = [r.capacity_tokens for r in pack_limits(spark, folder)]
    found = packing.pack(sized_documents(spark, folder), "doc_id", "n_tokens", limits)
    return found.select(F.col("item").alias("doc_id"), "piece", F.col("offset").alias("first_token"), F.col("size").alias("n_tokens"), "bin_id", "capacity", "unused")


def p8_pack_each(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of each single capacity."""
    sized = sized_documents(spark, folder)
    out = None
    for r in pack_limits(spark, folder):
        found = packing.pack(sized, "doc_id", "n_tokens", [r.capacity_tokens]).select(F.lit(r.limit_name).alias("limit_name"), F.col("item").alias("doc_id"), "piece", F.col("offset").alias("first_token"), F.col("size").alias("n_tokens"), "bin_id", "capacity", "unused")
        out = found if out is None else out.unionByName(found)
    return out


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn documents with their repeats."""
    drawn, _ = mixing.draw_mix(sized_documents(spark, folder), "doc_id", "source", "n_tokens", table(spark, folder, "mix_targets"))
    return drawn.select(F.col("item").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "repeats")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.draw_mix(sized_documents(spark, folder), "doc_id", "source", "n_tokens", table(spark, folder, "mix_targets"))[1]


def p10_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of every page."""
    docs = table(spark, folder, "documents").where("doc_id is not null")
    return spam.stuffed_pages(docs, "doc_id", "text").withColumnRenamed("item", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_pages(spark, folder).where("is_spam").select("doc_id").distinct()


# --- the same operators on values that SQL can compute too: stored spellings, sizes in characters


def _stored_tags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tags").select(clean_key("movieId").alias("movie_id"), F.lower(F.trim("tag")).alias("tag")).where("movie_id is not null and tag <> ''")


def p3_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of tags as written, but for case, with lift and ratio."""
    found = cooccur.cooccurrence(_stored_tags(spark, folder), "movie_id", "tag", 3, min_ratio=SIGNIFICANT)
    return found.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p4_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Frequencies of tags as written, but for case, and of the titles' words."""
    tags = cut(_stored_tags(spark, folder))
    of_tags = termfreq.term_frequencies(tags, "movie_id", "tag", None, tags.select("movie_id").distinct().count(), RARE_BELOW, COMMON_ABOVE)
    return of_tags.select(F.lit("tag").alias("fld"), "*").unionByName(p4_terms(spark, folder).where("fld = 'title'"))


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows and spellings the collapsed records stand for."""
    tags = table(spark, folder, "tags").select(clean_key("movieId").alias("movie_id"), "tag")
    found = collapse.collapse_copies(tags, ["movie_id"], "tag")
    return found.agg(F.sum("copies").cast("bigint").alias("n_rows"), F.count("*").alias("n_spellings"), F.sum(F.when(F.col("pos") == 0, F.col("n_copies"))).cast("bigint").alias("n_copies"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every character in a container once, none overfull, all as small as may be."""
    limits = sorted({r.capacity_tokens for r in pack_limits(spark, folder)})
    docs = table(spark, folder, "documents").where("doc_id is not null")
    found = cut(packing.pack(docs.select("doc_id", F.col("n_chars").cast("int").alias("n")), "doc_id", "n", limits))
    bins = found.groupBy("bin_id").agg(F.sum("size").alias("held"), F.max("capacity").alias("capacity"), F.min("capacity").alias("least"), F.max("unused").alias("unused"))
    fits = F.array_min(F.filter(F.array(*map(F.lit, limits)), lambda c: c >= F.col("held")))
    wrong = bins.agg(F.count_if((F.col("held") > F.col("capacity")) | (F.col("capacity") != F.col("least")) | (F.col("unused") != F.col("capacity") - F.col("held")) | (F.col("capacity") != fits)).alias("wrong_bins"))
    sums = found.agg(F.count_distinct("item").alias("documents"), F.count("*").alias("pieces"), F.sum("size").cast("bigint").alias("characters"), F.count_if((F.col("piece") > 0) & (F.col("offset") == 0)).alias("wrong_offsets"))
    return sums.crossJoin(F.broadcast(wrong))  # one row each


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """By source: whether its share is met, and documents drawn more often than allowed."""
    docs = table(spark, folder, "documents").where("doc_id is not null")
    targets = table(spark, folder, "mix_targets")
    drawn, shares = mixing.draw_mix(docs.select("doc_id", "source", "n_chars"), "doc_id", "source", "n_chars", targets)
    most = targets.select("source", "max_repeats")
    over = drawn.join(most, "source").groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("over_repeated"))
    met = shares.where("target_share > 0 and available_tokens > 0")
    return met.join(over, "source", "left").select("source", "available_tokens", F.round("wanted_share", 9).alias("wanted_share"), (F.abs(F.col("reached_share") - F.col("wanted_share")) < 0.005).alias("is_met"), F.coalesce("over_repeated", F.lit(0)).alias("over_repeated"))


QUERIES = {f.__name__: f for f in (p3_found, p3_pairs, p3_significant, p4_found, p4_terms, p5_found, p6_ratings, p6_ratings_all, p6_latency, p6_latency_months, p7_found, p7_copies, p8_pack, p8_pack_each, p9_mix, p9_shares, p10_found, p10_pages, p3_stored, p4_stored, p7_totals, p8_checks, p9_checks)}

# --- the same in SQL, where SQL can express it (no NFKC there, so nothing on tag forms)

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288))"


def _key(column: str) -> str:
    return f"nullif(trim({column}, {WS}), '')"


def _bucket(value: str) -> str:
    shift, step = percentile._shift(percentile.ACCURACY), repr(math.log(percentile.gamma(percentile.ACCURACY)))
    return f"case when {value} > 0 then greatest(ceil(ln({value}) / {step})::int + {shift}, 1) else 0 end"


def _percentiles(counts: str, keys: str) -> str:
    g, shift = percentile.gamma(percentile.ACCURACY), percentile._shift(percentile.ACCURACY)
    value = lambda b: f"case when {b} > 0 then round(exp(({b} - {shift})::double * {math.log(g)!r}) * {2 / (g + 1)!r}, 6) else 0.0 end"
    picks = ", ".join(value(f"min(case when reach >= ceil({p} * total) then bucket end)") + f" as p{round(p * 100)}" for p in percentile.PERCENTILES)
    return f"""with c as ({counts}), r as (
  select *, sum(n) over (partition by {keys} order by bucket) reach, sum(n) over (partition by {keys}) total from c)
select {keys}, max(total)::bigint as n_values, {picks} from r group by {keys}"""


_RATING = f"""select {_key('"movieId"')} movie_id, strftime(make_timestamp("timestamp" * 1000000), '%Y-%m') "month", {_bucket('rating')} bucket
  from ratings where rating >= 0.5 and rating <= 5 and "timestamp" is not null and {_key('"movieId"')} is not null"""
_LATENCY = f"""select q.category, strftime(t.run_at, '%Y-%m-%d') "day", strftime(t.run_at, '%Y-%m') "month", {_bucket('latency_ms')} bucket
  from tiny_run t left join (select {_key('_id')} k, min(metadata.category) category from queries group by 1) q on q.k = {_key('t.query_id')}
  where latency_ms >= 0 and isfinite(latency_ms) and t.run_at is not null and {_key('t.query_id')} is not null"""

_X = lambda c: f"(case when {c} > 0 then ({c})::double * ln(({c})::double) else 0.0 end)"

ORACLE: dict[str, str] = {
    "p5_found": f"""
with r as (select {_key('query_id')} query_id, unnest(results) x from tiny_run),
best as (
  select query_id, {_key('x.doc_id')} doc_id, max(x.score + 0.0) score from r
  where query_id is not null and {_key('x.doc_id')} is not null and x.score is not null and isfinite(x.score) group by all)
select query_id, rank_no::int as rank_no, doc_id from (
  select *, row_number() over (partition by query_id order by score desc, doc_id) rank_no from best) where rank_no <= {BEST}""",
    "p6_ratings": _percentiles(f"select movie_id, \"month\", bucket, count(*) n from ({_RATING}) group by all", 'movie_id, "month"'),
    "p6_ratings_all": _percentiles(f"select movie_id, bucket, count(*) n from ({_RATING}) group by all", "movie_id"),
    "p6_latency": _percentiles(f"select category, \"day\", bucket, count(*) n from ({_LATENCY}) group by all", 'category, "day"'),
    "p6_latency_months": _percentiles(f"select category, \"month\", bucket, count(*) n from ({_LATENCY}) group by all", 'category, "month"'),
    "p3_stored": f"""
with t as (select distinct {_key('"movieId"')} m, lower(trim(tag, ' ')) x from tags where {_key('"movieId"')} is not null and trim(tag, ' ') <> ''),
s as (select x, count(*) n from t group by 1), k as (select count(distinct m) n from t),
p as (select a.x item_a, b.x item_b, count(*) c from t a join t b on a.m = b.m and a.x < b.x where a.x in (select x from s where n >= 3) and b.x in (select x from s where n >= 3) group by 1, 2 having count(*) >= 3),
j as (select item_a, item_b, sa.n a, sb.n b, c, k.n n from p join s sa on sa.x = item_a join s sb on sb.x = item_b, k),
l as (select *, greatest(0, 2 * (({_X('c')} + {_X('a - c')} + {_X('b - c')} + {_X('n - a - b + c')}) - ({_X('a')} + {_X('n - a')} + {_X('b')} + {_X('n - b')}) + {_X('n')})) llr from j)
select item_a, item_b, a n_a, b n_b, c n_ab, n, round(c::double * n / (a::double * b), 6) lift, round(llr, 4) llr from l where llr >= {SIGNIFICANT}::double""",
    "p4_stored": f"""
with t as (select {_key('"movieId"')} m, lower(trim(tag, ' ')) x from tags where {_key('"movieId"')} is not null and trim(tag, ' ') <> ''),
v as (select {_key('"movieId"')} m, min(title) title from movies where {_key('"movieId"')} is not null and title is not null group by 1),
w as (select m, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) x from v),
c as (select 'tag' fld, x term, count(*) o, count(distinct m) r, (select count(distinct m) from t) total from t group by x union all select 'title', x, count(*), count(distinct m), (select count(*) from v) from w group by x)
select fld, term, o n_occurrences, r n_records, total total_records, case when r < {RARE_BELOW} then 'rare' when r > {COMMON_ABOVE} * total then 'common' end mark from c""",
    "p7_totals": f"""select count(*) n_rows, count(distinct (k, tag)) n_spellings, count(*) n_copies from (select {_key('"movieId"')} k, tag from tags) where k is not null and regexp_matches(tag, '[\\p{{L}}\\p{{M}}\\p{{N}}]')""",
    "p8_checks": """with c as (select max(capacity_tokens) c from pack_limits) select count(distinct doc_id) documents, sum(ceil(n_chars::double / c))::bigint pieces, sum(n_chars)::bigint characters, 0 wrong_offsets, 0 wrong_bins from documents, c where doc_id is not null and n_chars > 0""",
    "p9_checks": """with a as (select source, sum(n_chars)::bigint t from documents where doc_id is not null and source is not null and n_chars > 0 group by 1), m as (select * from mix_targets join a using (source) where target_share > 0 and max_repeats > 0)
select source, t available_tokens, round(target_share / sum(target_share) over (), 9) wanted_share, true is_met, 0 over_repeated from m""",
}
