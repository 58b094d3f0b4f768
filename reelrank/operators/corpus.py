"""Corpus building (ETL*): movies with ratings, tags and links become documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.functions.text import display_title, fixed, slug
from reelrank.runtime import WHITE_SPACE, clean_key

NO_GENRES = "(no genres listed)"
#: Fixed values of rating statistics.
PRIOR, MIN_RATINGS, SCALE_TOP = 20, 5, 5


def split_year(title: Column) -> tuple[Column, Column]:
    """ETL4: (title without a trailing "(dddd)", year); no year is null."""
    pattern = r"(?s)^(.*?)\s*\((\d{4})\)\s*\z"
    year = F.nullif(F.regexp_extract(title, pattern, 2), F.lit("")).cast("int")
    return F.when(year.isNotNull(), F.btrim(F.regexp_extract(title, pattern, 1))).otherwise(F.btrim(title)), year


def split_genres(genres: Column) -> Column:
    """ETL5: names between bars; none for null, blank and the placeholder."""
    blank = genres.isNull() | (F.btrim(genres).isin("", NO_GENRES))
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(genres, r"\|"))


def rating_aggregate(ratings: DataFrame, key: str = "movieId", value: str = "rating") -> DataFrame:
    """ETL2: (id, rating_sum, rating_count). Partial sums meet per key, so a key with a
    third of all rows is no hot spot. Null and NaN ratings and null or blank keys don't
    count."""
    valid = ratings.select(clean_key(key).alias("id"), F.col(value).cast("double").alias("r")).where("id is not null and r is not null and not isnan(r)")
    return valid.groupBy("id").agg(F.sum("r").alias("rating_sum"), F.count("*").alias("rating_count"))


def tag_lists(tags: DataFrame, key: str = "movieId", tag: str = "tag", order: tuple[str, ...] = ("timestamp", "userId", "tag")) -> DataFrame:
    """ETL3: (id, tags): trimmed tags, one spelling per lower-cased tag, the first by
    `order`, in that order. Spellings are reduced by partial aggregation first, so a
    list holds distinct tags only."""
    word = F.btrim(F.col(tag), F.lit(WHITE_SPACE))
    rows = tags.select(clean_key(key).alias("id"), word.alias("t"), F.struct(*order).alias("o")).where("id is not null and t is not null and t <> ''")
    first = rows.groupBy("id", F.lower("t").alias("low")).agg(F.min(F.struct("o", "t")).alias("f"))
    ordered = first.groupBy("id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return ordered.select("id", F.transform("fs", lambda f: f["t"]).alias("tags"))


def search_text(parts: list[Column]) -> Column:
    """ETL7: the parts that hold anything, joined by ". "."""
    return F.concat_ws(". ", *[F.nullif(F.btrim(p), F.lit("")) for p in parts])


def build_corpus(movies: DataFrame, ratings: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """ETL1: one document per movie key: _id, title, text and metadata (JN1: three left
    joins). Of several rows with one key the least title and genres stand; a null title
    reads as ''."""
    base = movies.select(clean_key("movieId").alias("id"), "title", "genres").where("id is not null").groupBy("id").agg(F.min(F.struct("title", "genres")).alias("m"))
    link = links.select(clean_key("movieId").alias("id"), "imdbId", "tmdbId").where("id is not null").groupBy("id").agg(F.min(F.struct("imdbId", "tmdbId")).alias("l"))
    joined = base.join(rating_aggregate(ratings), "id", "left").join(tag_lists(tags), "id", "left").join(link, "id", "left")
    title, year = split_year(F.coalesce(F.col("m.title"), F.lit("")))
    genres = split_genres(F.col("m.genres"))
    tag_list = F.coalesce("tags", F.array().cast("array<string>"))
    imdb = F.nullif(F.btrim(F.col("l.imdbId")), F.lit(""))
    flat = joined.select("id", title.alias("title"), year.alias("year"), genres.alias("genres"), tag_list.alias("tags"), (F.col("rating_sum") / F.col("rating_count")).alias("average_rating"), F.coalesce("rating_count", F.lit(0)).cast("bigint").alias("rating_count"), F.concat(F.lit("tt"), imdb).alias("imdb_id"), F.col("l.tmdbId").alias("tmdb_id"))
    label = lambda name, list_: F.when(F.size(list_) > 0, F.concat(F.lit(name + ": "), F.array_join(list_, ", ")))
    text = search_text([F.col("title"), F.col("year").cast("string"), label("Genres", F.col("genres")), label("Tags", F.col("tags"))])
    meta = F.struct("year", "genres", "tags", fixed(F.col("average_rating"), 3).alias("average_rating"), "rating_count", "imdb_id", "tmdb_id")
    return flat.select(F.col("id").alias("_id"), "title", text.alias("text"), meta.alias("metadata"))


def enrich(corpus: DataFrame, enrichment: DataFrame) -> DataFrame:
    """ETL8/JN2: documents with cast, directors, keywords and overview. enrichment: (_id,
    cast array<string>, directors array<string>, keywords array<string>, overview string).
    Documents without any stay as they are (empty lists)."""
    tidy = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.btrim(x)), lambda x: x != ""))
    e = enrichment.select("_id", F.struct(*[tidy(F.col(c)).alias(c) for c in ("cast", "directors", "keywords")], F.coalesce("overview", F.lit("")).alias("overview")).alias("e"))
    label = lambda name, list_: F.when(F.size(list_) > 0, F.concat(F.lit(name + ": "), F.array_join(list_, ", ")))
    joined = corpus.join(e, "_id", "left")
    text = F.when(F.col("e").isNull(), F.col("text")).otherwise(search_text([F.col("text"), label("Directors", F.col("e.directors")), label("Cast", F.col("e.cast")), label("Keywords", F.col("e.keywords")), F.col("e.overview")]))
    empty = F.array().cast("array<string>")
    more = {c: F.coalesce(F.col(f"e.{c}"), empty) for c in ("cast", "directors", "keywords")}
    return joined.select("_id", "title", text.alias("text"), F.coalesce(F.col("e.overview"), F.lit("")).alias("overview"), *[v.alias(k) for k, v in more.items()], "metadata", F.col("e").isNotNull().alias("is_enriched"))


def subset(documents: DataFrame, ids: list[str]) -> DataFrame:
    """ETL18: the documents with these ids, in any order; ids that don't exist give no row."""
    return documents.where(F.col("_id").isin([str(i) for i in ids])) if ids else documents.limit(0)


def coverage(enriched: DataFrame) -> DataFrame:
    """ETL9: the share of documents with enrichment; null for none."""
    return enriched.agg(F.count("*").alias("documents"), F.count_if("is_enriched").alias("enriched"), F.round(F.avg(F.col("is_enriched").cast("int")), 4).alias("coverage"))


def records(corpus: DataFrame) -> DataFrame:
    """IX3's records: one flat row per document, displayed title, lists never null."""
    m = F.col("metadata")
    empty = F.array().cast("array<string>")
    return corpus.select(F.col("_id").alias("id"), display_title(F.col("title")).alias("title"), F.col("title").alias("source_title"), m["year"].alias("year"), F.coalesce(m["genres"], empty).alias("genres"), F.coalesce(m["tags"], empty).alias("tags"), m["average_rating"].alias("average_rating"), F.coalesce(m["rating_count"], F.lit(0)).alias("rating_count"))


def rating_evidence(rows: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """IX20/AG14-AG16: rows (.., average_rating, rating_count) with eligible (FL8: at least
    MIN_RATINGS), the Bayesian rating and the logarithmic evidence.

    The corpus mean and the largest count are one row, taken by one aggregation; the
    query plan joins that single row, its size known, to every record."""
    eligible = (F.col("rating_count") >= MIN_RATINGS) & F.col("average_rating").isNotNull()
    stats = (total if total is not None else rows).agg(
        F.coalesce(F.try_divide(F.sum(F.when(eligible, F.col("average_rating") * F.col("rating_count"))), F.sum(F.when(eligible, F.col("rating_count")))), F.lit(0.0)).alias("mean"),
        F.greatest(F.coalesce(F.max("rating_count"), F.lit(1)), F.lit(1)).alias("top"),
    ).first()  # one row
    mean, top = F.lit(float(stats["mean"])), F.lit(float(stats["top"]))
    n = F.col("rating_count").cast("double")
    bayes = F.when(eligible, (n * F.col("average_rating") + PRIOR * mean) / (n + PRIOR)).otherwise(F.lit(0.0))
    return rows.withColumns({"eligible": F.coalesce(eligible, F.lit(False)), "bayesian_rating": bayes, "rating_evidence": F.log1p(n) / F.log1p(top)})


# --- entity registry (ETL10-ETL17)


def people(credits: DataFrame) -> DataFrame:
    """ETL10/ETL11/ETL13/ETL14: one row per person with roles and distinct movie counts.

    credits: (movie_id, role `actor` or `director`, person_id nullable, name). A person is
    known by its id, else by the slug of the name; blank names are nobody. Counting is by
    two aggregations (person and movie, then person), without count-distinct's expansion."""
    name = F.btrim("name")
    named = credits.withColumn("name", name).where("name is not null and name <> '' and movie_id is not null")
    key = F.when(F.col("person_id").isNotNull(), F.concat(F.lit("person:id:"), F.col("person_id").cast("string"))).otherwise(F.concat(F.lit("person:name:"), slug(F.col("name"))))
    per_movie = named.groupBy(key.alias("entity_id"), "movie_id").agg(F.min("name").alias("name"), F.max((F.col("role") == "actor").cast("int")).alias("acts"), F.max((F.col("role") == "director").cast("int")).alias("directs"))
    out = per_movie.groupBy("entity_id").agg(F.min("name").alias("name"), F.count("*").alias("movie_count"), F.sum("acts").alias("actor_movie_count"), F.sum("directs").alias("director_movie_count"))
    roles = F.filter(F.array(F.when(F.col("actor_movie_count") > 0, "actor"), F.when(F.col("director_movie_count") > 0, "director")), lambda r: r.isNotNull())
    return out.withColumn("roles", roles)


def members(rows: DataFrame, kind: str, name: str, movie: str) -> DataFrame:
    """ETL10/ETL15: (entity_id, name, movie_count) of genres or tags, by slug; the least
    spelling gives the name."""
    valid = rows.select(F.btrim(F.col(name), F.lit(WHITE_SPACE)).alias("name"), F.col(movie).alias("movie")).where("name is not null and name <> '' and movie is not null")
    per = valid.groupBy(F.concat(F.lit(kind + ":"), slug(F.col("name"))).alias("entity_id"), "movie").agg(F.min("name").alias("name"))
    return per.groupBy("entity_id").agg(F.min("name").alias("name"), F.count("*").alias("movie_count"))


def tag_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """ETL15: tags of several sources, (movie_id, tag), as one list per movie and tag with
    the sorted names of its sources."""
    out = None
    for name, rows in sorted(sources.items()):
        one = rows.select("movie_id", F.lower(F.btrim("tag")).alias("tag"), F.lit(name).alias("source")).where("tag <> ''")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("movie_id", "tag").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def first_spelling(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """WN6: the first row of each key by `order`. One pass with a bounded aggregate, no
    window: a key of any number of rows is fine."""
    cols = rows.columns
    best = rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WN7: the last row of each key; upserts over an append-only table."""
    cols = rows.columns
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")).select("_row.*")


def ranked_within(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """WN8/WN10: the n first rows of each key; Spark limits each task's groups before the
    shuffle (window group limit)."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
