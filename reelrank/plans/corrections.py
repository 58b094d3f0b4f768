"""Spelling correction and entity linking for whole sets of queries (PL5-PL14, IX10-IX14): each
rule is a join, the winner of a query a bounded aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.operators.fuzzy import near_keys, near_tokens, windows, within_distance
from reelrank.operators.index import trigram_first
from reelrank.plans.metadata import GENRE_ALIASES, MEDIA_WORDS
from reelrank.runtime import cut

#: Words of a query that steer it.
CONTROL_WORDS = ["movie", "movies", "film", "films", "latest", "newest", "recent", "oldest", "rated", "rating", "ratings", "after", "before", "since", "with", "from", "about", "featuring", "starring", "directed", "director", "actor", "actress", "called", "named", "titled", "title", "contains", "minimum", "least", "imdb", "which", "is", "funny"]
#: The phrasings that name a role or a title.
DIRECTOR = r"\b(?:directed\s+by|director)\b"
ACTOR = r"\b(?:starring|featuring|with|actor|actress|cast)\b"
CLEAR_ACTOR = r"\b(?:starring|featuring|actor|actress|cast)\b"
TITLE_CONTEXT = r"\b(?:movie|film)?\s*(?:called|named|titled)\s+(.+)$"
TITLE_CONTAINS = r"\btitle\s+(?:contains?|containing|has|with)\s+(.+)$"
CORRECTION_CANDIDATES = 200


def prepared(queries: DataFrame) -> DataFrame:
    """(query_id, key, tokens, role): the planner's view of each query."""
    q = queries.select("query_id", tx.exact_key(F.col("text")).alias("key")).where("key <> ''")
    role = F.when(F.col("key").rlike(DIRECTOR), "director").when(F.col("key").rlike(ACTOR), "actor")
    return q.select("query_id", "key", tx.ordered_tokens(F.col("key")).alias("tokens"), role.alias("role"))


def person_role(preferred: Column) -> Column:
    has = lambda r: F.array_contains("roles", r)
    return F.when(preferred.isNotNull() & F.array_contains("roles", F.coalesce(preferred, F.lit(""))), preferred).when((F.col("director_movie_count") > F.col("actor_movie_count")) & has("director"), "director").when(has("actor"), "actor").otherwise(F.get("roles", F.lit(0)))


def exact_people(queries: DataFrame, people: DataFrame) -> DataFrame:
    """PL5/IX10: (query_id, phrase, start, entity_id, role): of each run of 2 to 4 tokens that
    is a name, the person with most movies (then the least id)."""
    phrase = people.select(F.array_join(tx.ordered_tokens(F.col("name")), " ").alias("phrase"), "entity_id", "roles", "movie_count", "actor_movie_count", "director_movie_count")
    hit = windows(prepared(queries), "tokens", 2, 4).join(phrase, "phrase").where(F.col("role").isNull() | F.array_contains("roles", F.coalesce("role", F.lit(""))))
    best = hit.groupBy("query_id", "phrase", "start").agg(F.min_by(F.struct("entity_id", person_role(F.col("role")).alias("role")), F.struct(-F.col("movie_count"), F.col("entity_id"))).alias("p"))
    return best.select("query_id", "phrase", "start", "p.entity_id", "p.role")


def partial_people(queries: DataFrame, people: DataFrame, n: int = 5) -> DataFrame:
    """PL6/JN11: for queries with one meaningful token of 3 letters or more, the n people
    whose name has a token that starts with it (whole for 3 letters), most movies first. Prefixes are
    an equi-join on the first three letters, then checked."""
    control = F.array(*map(F.lit, CONTROL_WORDS))
    q = prepared(queries).withColumn("left", F.filter("tokens", lambda t: ~F.array_contains(control, t))).where((F.size("left") == 1) & (F.length(F.get("left", F.lit(0))) >= 3))
    q = q.select("query_id", "role", F.get("left", F.lit(0)).alias("token")).withColumn("k", F.left("token", F.lit(3)))
    names = people.select("entity_id", "name", "roles", "movie_count", "actor_movie_count", "director_movie_count", F.posexplode(tx.ordered_tokens(F.col("name"))).alias("pos", "part")).where(F.length("part") >= 3).withColumn("k", F.left("part", F.lit(3)))
    hit = q.join(names, "k").where(F.startswith("part", F.col("token")) & (F.col("role").isNull() | F.array_contains("roles", F.coalesce("role", F.lit("")))))
    first = hit.groupBy("query_id", "role", "token", "entity_id", "name", "roles", "movie_count", "actor_movie_count", "director_movie_count").agg(F.min_by("part", "pos").alias("part"))
    ok = first.where((F.col("part") == F.col("token")) | (F.length("token") >= 4))
    shown = ok.withColumn("as_role", person_role(F.col("role")))
    role_count = F.when(F.col("as_role") == "director", F.col("director_movie_count")).otherwise(F.col("actor_movie_count"))
    counted = shown.withColumn("role_movie_count", role_count).withColumn("popularity", F.when(F.col("role").isNotNull(), F.col("role_movie_count")).otherwise(F.col("movie_count")))
    ranked = counted.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("popularity"), "name", "entity_id"))).where(F.col("rank_no") <= n)
    return ranked.select("query_id", "rank_no", "entity_id", "name", F.col("as_role").alias("role"), "movie_count", "role_movie_count", "popularity", F.round(F.least(F.lit(1.0), F.length("token") / F.length("part")), 3).alias("confidence"))


def person_corrections(queries: DataFrame, people: DataFrame) -> DataFrame:
    """PL7/PL8/JN7/IX11: (query_id, original, replacement, entity_id, distance, confidence, policy).
    Names within min(3, max(1, a fifth of their length)) edits and with similarity .82 of a
    run of as many tokens with the same initials."""
    q = prepared(queries)
    media = F.array(*map(F.lit, MEDIA_WORDS))
    known = exact_people(queries, people).select("query_id").distinct()
    q = q.where(F.col("role").isNotNull() | (F.size("tokens") == 2) | F.arrays_overlap("tokens", media)).join(known, "query_id", "left_anti")
    w = windows(q, "tokens", 2, 4).select("query_id", "key", "role", F.size("tokens").alias("n_query"), "start", "size", "phrase")
    names = people.select("entity_id", "name", "roles", "movie_count", F.array_join(tx.ordered_tokens(F.col("name")), " ").alias("full")).withColumn("n_name", F.size(F.split("full", " "))).where(F.col("n_name").between(2, 4))
    phrases = w.select("phrase", "size").distinct()
    near = within_distance(phrases, names.select("full", "n_name").distinct(), "phrase", "full", 3, tx.initials).where((F.col("size") == F.col("n_name")) & (F.col("phrase") != F.col("full")))
    longest = F.greatest(F.length("phrase"), F.length("full"))
    near = near.withColumn("similarity", 1 - F.col("distance") / longest).where((F.col("distance") <= F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.length("full") * F.lit(0.2))))) & (F.col("similarity") >= 0.82))
    hit = w.join(near.select("phrase", "full", "distance", "similarity"), "phrase").join(names, "full").where(F.col("role").isNull() | F.array_contains("roles", F.coalesce("role", F.lit(""))))
    clear = (F.col("n_query") == F.col("n_name")) | F.col("key").rlike(DIRECTOR) | F.col("key").rlike(CLEAR_ACTOR)
    hit = hit.withColumn("policy", F.when(clear, "automatic").otherwise("suggest"))
    best = hit.groupBy("query_id").agg(F.min_by(F.struct(F.col("phrase").alias("original"), F.col("name").alias("replacement"), "entity_id", "distance", F.round("similarity", 3).alias("confidence"), "policy"), F.struct(-F.col("similarity"), F.col("distance"), -F.col("movie_count"), F.col("entity_id"), F.col("start"))).alias("b"))
    return best.select("query_id", "b.*")


def genre_corrections(queries: DataFrame, genres: DataFrame) -> DataFrame:
    """PL9/JN10: (query_id, original, replacement, confidence): the first token of 4 letters or
    more at distance 1 from terms of just one genre, in a query about films. genres: (genre)."""
    fixed = queries.sparkSession.createDataFrame([(a, g) for a, g in GENRE_ALIASES.items()], "term string, genre string")
    terms = genres.where("genre is not null").select(tx.exact_key(F.col("genre")).alias("term"), "genre").unionByName(fixed).where(F.size(tx.ordered_tokens(F.col("term"))) == 1).distinct()
    media = F.array(*map(F.lit, MEDIA_WORDS))
    q = prepared(queries).where(F.arrays_overlap("tokens", media) | F.col("key").rlike(r"\b(?:genre|after|before|since|latest|newest|recent)\b"))
    toks = q.select("query_id", F.posexplode("tokens").alias("pos", "token")).where((F.length("token") >= 4) & ~F.col("token").isin(list(GENRE_ALIASES)))
    near = near_tokens(toks.select("token").distinct(), terms, "token", "term")
    one = near.groupBy("token").agg(F.count_distinct("genre").alias("n"), F.min("term").alias("term"), F.min("genre").alias("genre")).where("n = 1")
    hit = toks.join(one, "token").groupBy("query_id").agg(F.min_by(F.struct("token", "term", "genre"), "pos").alias("b"))
    confidence = F.round(1 - F.lit(1.0) / F.greatest(F.length("b.token"), F.length("b.genre")), 3)
    return hit.select("query_id", F.col("b.token").alias("original"), F.col("b.term").alias("replacement"), confidence.alias("confidence"))


def control_corrections(queries: DataFrame) -> DataFrame:
    """PL10: (query_id, original, replacement, confidence): the first token near just one
    control word."""
    words = queries.sparkSession.createDataFrame([(w,) for w in CONTROL_WORDS], "term string")
    toks = prepared(queries).select("query_id", F.posexplode("tokens").alias("pos", "token")).where((F.length("token") >= 4) & ~F.col("token").isin(CONTROL_WORDS))
    near = near_tokens(toks.select("token").distinct(), words, "token", "term")
    one = near.groupBy("token").agg(F.count("*").alias("n"), F.min("term").alias("term")).where("n = 1")
    hit = toks.join(one, "token").groupBy("query_id").agg(F.min_by(F.struct("token", "term"), "pos").alias("b"))
    return hit.select("query_id", F.col("b.token").alias("original"), F.col("b.term").alias("replacement"), F.round(1 - F.lit(1.0) / F.greatest(F.length("b.token"), F.length("b.term")), 3).alias("confidence"))


def alias_list() -> Column:
    """IX14: the distinct edit texts of a title, without what follows a bracket, without the article."""
    full = tx.edit_text(F.col("title"))
    bare = tx.edit_text(F.regexp_replace("title", r"\s+\([^)]*\).*$", ""))
    cut = lambda c: F.regexp_replace(c, r"^(?:a|an|the)\s+", "")
    return F.array_distinct(F.filter(F.array(full, bare, cut(full), cut(bare)), lambda a: a != ""))


def title_aliases(records: DataFrame) -> DataFrame:
    """IX14: (id, title, alias)."""
    return records.select("id", "title", F.explode(alias_list()).alias("alias"))


def recurring_phrases(records: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """IX12: (phrase, movie_count): the first 2 to 4 tokens of titles, articles aside, that
    at least two movies share."""
    toks = (title_aliases(records) if aliases is None else aliases).select("id", tx.ordered_tokens(F.regexp_replace("alias", r"^(?:(?:a|an|the)\s+)+(?=\S)", "")).alias("t"))
    prefixes = F.expr("transform(sequence(2, 4), k -> if(size(t) >= k, array_join(slice(t, 1, k), ' '), null))")
    rows = toks.select("id", F.explode(F.filter(prefixes, lambda p: p.isNotNull())).alias("phrase")).distinct()
    return rows.groupBy("phrase").agg(F.count("*").alias("movie_count")).where("movie_count >= 2")


def title_targets(queries: DataFrame) -> DataFrame:
    """PL11: (query_id, target, is_contextual)."""
    q = prepared(queries)
    named = F.coalesce(F.nullif(F.regexp_extract("key", TITLE_CONTEXT, 1), F.lit("")), F.nullif(F.regexp_extract("key", TITLE_CONTAINS, 1), F.lit("")))
    target = F.when(named.isNotNull(), tx.exact_key(named)).when(F.size("tokens") <= 8, F.array_join("tokens", " "))
    return q.select("query_id", target.alias("target"), named.isNotNull().alias("is_contextual")).where("target is not null and target <> ''")


def phrase_corrections(targets: DataFrame, phrases: DataFrame) -> DataFrame:
    """PL12/JN8/IX13/WN4: targets (query_id, target, is_contextual) of 2 to 4 tokens with a
    recurring phrase of the same shape, every token within 1, 2 together, similarity .8,
    and no other phrase as near. The join key is the shape with the first token's near keys."""
    t = targets.withColumn("tt", tx.ordered_tokens(F.col("target"))).where(F.size("tt").between(2, 4))
    t = t.withColumn("exact", F.array_join("tt", " ")).join(phrases.select(F.col("phrase").alias("exact")), "exact", "left_anti")
    block = lambda toks: F.transform(near_keys(F.get(toks, F.lit(0))), lambda k: F.concat_ws("|", tx.phrase_shape(toks), k))
    a = t.withColumn("k", F.explode(block(F.col("tt"))))
    b = phrases.withColumn("pt", F.split("phrase", " ")).withColumn("k", F.explode(block(F.col("pt"))))
    pairs = a.join(b, "k").drop("k").distinct()
    pairs = pairs.withColumn("ds", F.zip_with("tt", "pt", lambda x, y: tx.correction_distance(x, y))).withColumn("distance", F.aggregate("ds", F.lit(0), lambda s, x: s + x))
    ok = pairs.where((F.array_max("ds") <= 1) & F.col("distance").between(1, 2)).withColumn("similarity", 1 - F.col("distance") / F.greatest(F.length("target"), F.length("phrase"))).where("similarity >= 0.8")
    order = W.partitionBy("query_id").orderBy("distance", F.desc("movie_count"), "phrase")
    two = ok.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("distance").over(order)).where((F.col("r") == 1) & (F.col("next").isNull() | (F.col("next") > F.col("distance"))))
    policy = F.when(F.size(F.filter("ds", lambda d: d > 0)) > 1, "automatic").otherwise("suggest")
    return two.select("query_id", F.col("target").alias("original"), tx.title_case(F.col("phrase")).alias("replacement"), "distance", F.round("similarity", 3).alias("confidence"), policy.alias("policy"))


def title_corrections(queries: DataFrame, records: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """PL13/JN9/WN4: (query_id, original, replacement, distance, confidence, policy). Recurring
    phrases come first; else of the 200 titles that share most trigrams the nearest alias, if near
    enough and .08 clear of the next title. Queries that are a title need none. aliases: those of
    title_aliases, where the caller holds them."""
    aliases = cut(title_aliases(records)) if aliases is None else aliases
    targets = cut(title_targets(queries).withColumn("etext", tx.edit_text(F.col("target"))).join(aliases.select(F.col("alias").alias("etext")).distinct(), "etext", "left_anti"))
    by_phrase = cut(phrase_corrections(targets.drop("etext"), recurring_phrases(records, aliases)))
    rest = targets.join(by_phrase.select("query_id"), "query_id", "left_anti")
    # every different target once, every title's aliases once: neither is made again for a pair
    held = cut(records.select("id", "title", alias_list().alias("aliases")))
    near = trigram_first(rest.select(F.col("target").alias("query_id"), F.col("target").alias("text")).distinct(), held, CORRECTION_CANDIDATES, "aliases")
    pairs = near.select(F.col("query_id").alias("target"), "id", "title", F.explode("aliases").alias("alias"))
    # a title less like the target than .72 neither wins nor comes within .08 of a winner; a swap is two edits
    longest = F.greatest(F.length("target"), F.length("alias"))
    most = (F.floor(longest * F.lit(0.3)) + 1).cast("int")
    pairs = pairs.where((F.abs(F.length("target") - F.length("alias")) <= most) & (F.call_function("levenshtein", F.col("target"), F.col("alias"), most) >= 0))
    d = tx.correction_distance(F.col("target"), F.col("alias"))
    pairs = cut(pairs.withColumn("distance", d).withColumn("similarity", 1 - F.col("distance") / longest))
    best = pairs.groupBy("id", "title", "target").agg(F.max_by(F.struct("similarity", "distance"), F.struct("similarity", -F.col("distance"))).alias("b"))
    order = W.partitionBy("target").orderBy(F.desc("b.similarity"), "b.distance", "title", "id")
    top = best.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("b.similarity").over(order)).where("r = 1")
    n = F.size(tx.ordered_tokens(F.col("target")))
    ok = top.where((F.col("b.similarity") >= F.when(n == 1, 0.8).otherwise(0.86)) & (F.col("b.distance") <= F.greatest(F.lit(2), F.floor(F.length("target") * F.lit(0.15)))) & (F.col("next").isNull() | (F.col("b.similarity") - F.col("next") >= 0.08)))
    policy = F.when(F.col("is_contextual") | ((n == 1) & (F.length("target") >= 9)), "automatic").otherwise("suggest")
    by_title = rest.join(ok, "target").select("query_id", F.col("target").alias("original"), F.col("title").alias("replacement"), F.col("b.distance").alias("distance"), F.round("b.similarity", 3).alias("confidence"), policy.alias("policy"))
    return by_phrase.unionByName(by_title)


def corrections(queries: DataFrame, records: DataFrame, people: DataFrame, genres: DataFrame, autocorrect: bool = True, aliases: DataFrame | None = None) -> DataFrame:
    """PL14: each query's winning correction: (query_id, entity_type, original, replacement,
    confidence, policy, effective_query, suggested_query). Queries that are a title get none.
    Without autocorrect, automatic ones are suggestions."""
    aliases = cut(title_aliases(records)) if aliases is None else aliases
    titles = aliases.select(F.col("alias").alias("etext")).distinct()
    q = cut(queries.select("query_id", "text").withColumn("etext", tx.edit_text(F.col("text"))).join(titles, "etext", "left_anti").select("query_id", "text"))
    cols = ["query_id", "entity_type", "original", "replacement", "confidence", "policy"]
    kind = lambda df, name, policy=None: df.withColumn("entity_type", F.lit(name)).withColumn("policy", F.lit(policy) if policy else F.col("policy")).select(*cols)
    found = kind(person_corrections(q, people), "person").unionByName(kind(title_corrections(q, records, aliases), "title")).unionByName(kind(genre_corrections(q, genres), "genre", "automatic")).unionByName(kind(control_corrections(q), "control", "automatic"))
    p = prepared(q)
    in_title = F.col("key").rlike(TITLE_CONTEXT) | F.col("key").rlike(TITLE_CONTAINS)
    has_genre = F.max((F.col("entity_type") == "genre").cast("int")).over(W.partitionBy("query_id"))
    place = lambda *names: F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col("entity_type")]
    order = F.when(F.col("role").isNotNull(), place("person", "title", "genre", "control")).when(in_title, place("title", "person", "genre", "control")).when(F.col("_genre") == 1, place("genre", "person", "title", "control")).otherwise(place("person", "title", "genre", "control"))
    ranked = found.withColumn("_genre", has_genre).join(p, "query_id").withColumn("_o", order)
    best = ranked.groupBy("query_id", "key").agg(F.min_by(F.struct(*cols[1:]), "_o").alias("b")).select("query_id", "key", "b.*")
    fixed = tx.replace_term(F.col("key"), F.col("original"), tx.exact_key(F.col("replacement")))
    policy = F.col("policy") if autocorrect else F.lit("suggest")
    return best.withColumn("policy", policy).select(*cols, F.when(F.col("policy") == "automatic", fixed).otherwise(F.col("key")).alias("effective_query"), F.when(F.col("policy") == "suggest", fixed).alias("suggested_query"))
