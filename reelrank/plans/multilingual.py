"""Planning and answering requests in Hindi, Hindi in Latin letters and English (PL20, PL24-PL26, JN13,
JN14, JN21, FL15, FL16, SO5, QY3): an interpretation of each request, given or made here, is
resolved against the catalogue's aliases and answered, for a whole table of requests in one job.

An interpretation is a row of INTERPRETATION. Language models may make them elsewhere; here they are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.operators import entities as en
from reelrank.operators import index as ix
from reelrank.operators import multilingual as ml
from reelrank.operators import ranking as rk
from reelrank.plans import corrections as co
from reelrank.plans.planner import plan_queries
from reelrank.runtime import cut

MENTION = "struct<text:string,alternatives:array<string>>"
PERSON = "struct<text:string,alternatives:array<string>,role:string>"
BOUNDS = ["year_min", "year_max", "rating_min", "count_min"]
INTERPRETATION = f"query_id string, title {MENTION}, people array<{PERSON}>, genres array<string>, genre_mode string, year_min int, year_max int, rating_min double, count_min bigint, sort_field string, sort_direction string, unresolved array<string>, evidence array<string>"
SORT_FIELDS, DIRECTIONS, ROLES = ["year", "rating", "ratingCount"], ["asc", "desc"], ["actor", "director"]
#: Words beside people that are no title.
ROLE_WORDS = r"\b(?:movies?|films?|starring|featuring|directed|by|with|actor|director)\b"
LONGEST = 300
#: Blocks of films that requests without genres meet.
BLOCKS = 64


def _columns() -> list[tuple[str, str]]:
    return [tuple(f.simpleString().split(":", 1)) for f in _schema().fields]


def _schema():
    from pyspark.sql import types as T

    return T._parse_datatype_string(INTERPRETATION)


def interpretation(**given: Column) -> list[Column]:
    """The columns of INTERPRETATION, empty but for the given ones."""
    out = []
    for name, kind in _columns():
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit("any") if name == "genre_mode" else F.lit(None).cast(kind)
        out.append(given.get(name, empty).cast(kind).alias(name) if name != "query_id" else F.col("query_id"))
    return out


def uncovered(text: Column, spans: Column) -> Column:
    """text with blanks where one of the spans stands, in all its places."""
    inside = lambda i: F.exists(spans, lambda e: (F.length(e) > 0) & F.exists(F.sequence(F.greatest(F.lit(1), i - F.length(e) + 1), i), lambda s: F.substring(text, s, F.length(e)) == e))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.when(inside(i), F.lit(" ")).otherwise(F.substring(text, i, F.lit(1)))), "")


def interpretation_problems(queries: DataFrame, interpretations: DataFrame, genres: list[str]) -> DataFrame:
    """FL15/FL16: (query_id, problem): the first rule an interpretation of a query (query_id, text) breaks, null
    for none. Genres must be known, modes, roles and sorts of the fixed kinds, years in order, every span
    quoted from the query, and the evidence must cover all its words."""
    j = queries.select("query_id", "text").join(interpretations, "query_id")
    none = F.array().cast("array<string>")
    spans = F.concat(F.coalesce("evidence", none), F.coalesce(F.transform("people", lambda p: p["text"]), none), F.when(F.col("title").isNotNull(), F.array("title.text")).otherwise(none), F.coalesce("unresolved", none))
    known = F.array(*map(F.lit, genres)) if genres else none
    shape = F.col("people").isNull() | F.col("genres").isNull() | F.col("unresolved").isNull() | F.col("evidence").isNull() | ~F.coalesce(F.col("genre_mode").isin("any", "all"), F.lit(False))
    shape = shape | F.exists("people", lambda p: p["role"].isNotNull() & ~p["role"].isin(ROLES)) | (F.col("sort_field").isNotNull() & ~(F.col("sort_field").isin(SORT_FIELDS) & F.coalesce(F.col("sort_direction").isin(DIRECTIONS), F.lit(False))))
    # cut, so that the UDF of the normal form is evaluated by itself
    rest = cut(j.withColumn("_rest", uncovered(F.col("text"), F.coalesce("evidence", none))))
    rest = cut(rest.withColumn("_left", tx.unicode_key(tx.unicode_text(F.col("_rest")))))
    problem = (
        F.when(F.coalesce(shape, F.lit(True)), "shape")
        .when(F.size(F.array_except("genres", known)) > 0, "unknown_genre")
        .when(F.col("year_min") > F.col("year_max"), "year_order")
        .when(F.exists(spans, lambda s: s.isNull() | (F.btrim(s) == "") | ~F.contains(F.col("text"), s)), "span")
        .when(F.col("_left") != "", "coverage")
    )
    return rest.select("query_id", problem.alias("problem"))


def resolve_mentions(mentions: DataFrame, aliases: DataFrame, fuzzy: bool) -> DataFrame:
    """JN21: mentions (query_id, no, text, alternatives) -> (query_id, no, entity_id, score, alias). What
    equals the words of the request is preferred; else the best of these and the alternatives."""
    ids = F.struct("query_id", "no")
    first = mentions.select(F.to_json(ids).alias("query_id"), "text").where("text is not null")
    exact = cut(ml.match_aliases(first, aliases, fuzzy=False))
    left = mentions.withColumn("_id", F.to_json(ids)).join(exact.select(F.col("query_id").alias("_id")).distinct(), "_id", "left_anti")
    every = left.select("_id", F.posexplode(F.concat(F.array("text"), F.coalesce("alternatives", F.array().cast("array<string>")))).alias("i", "text")).where("text is not null")
    found = ml.match_aliases(every.select(F.to_json(F.struct("_id", "i")).alias("query_id"), "text"), aliases, fuzzy=fuzzy)
    best = found.select(F.get_json_object("query_id", "$._id").alias("query_id"), "entity_id", "score", "text").groupBy("query_id", "entity_id").agg(F.max_by(F.struct("score", "text"), F.struct("score", "text")).alias("b")).select("query_id", "entity_id", "b.score", "b.text")
    back = F.from_json("query_id", "query_id string, no int")
    return exact.unionByName(best).select(back.alias("k"), "entity_id", "score", F.col("text").alias("alias")).select("k.query_id", "k.no", "entity_id", "score", "alias")


def compile_interpretations(interpretations: DataFrame, movies: DataFrame, persons: DataFrame, people: DataFrame) -> DataFrame:
    """PL24: interpretations (and their mode) as plans: (query_id, mode, intent, strategy, has_title, title_matches
    array<struct<id,score>>, groups array<struct<no,entity_id,role>>, genres, genre_mode, the bounds, sort,
    unresolved, is_structured, is_blocked). movies, persons: their aliases; people: (entity_id, roles).

    A title or person that isn't found, and a person that several may be, are unresolved; plans with anything
    unresolved, or with nothing recognised, are blocked."""
    i = cut(interpretations)
    titles = resolve_mentions(i.where("title is not null").select("query_id", F.lit(0).alias("no"), "title.text", "title.alternatives"), movies, True)
    t = titles.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("entity_id").alias("id"), "score"))).alias("title_matches"))
    asked = i.select("query_id", F.posexplode("people").alias("no", "p")).select("query_id", "no", "p.*")
    held = resolve_mentions(asked.select("query_id", "no", "text", "alternatives"), persons, False).join(asked.select("query_id", "no", "role"), ["query_id", "no"]).join(people.select("entity_id", "roles"), "entity_id")
    held = held.where(F.col("role").isNull() | F.array_contains("roles", F.coalesce("role", F.lit(""))))
    per = asked.join(held.groupBy("query_id", "no").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id")), ["query_id", "no"], "left")
    open_ = F.when(F.col("n").isNull(), F.concat(F.lit("Person not found: "), "text")).when(F.col("n") > 1, F.concat(F.lit("Ambiguous person: "), "text"))
    g = per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.struct("no", "entity_id", "role")))).alias("groups"), F.array_sort(F.collect_list(F.when(open_.isNotNull(), F.struct("no", open_.alias("u"))))).alias("_open"))
    p = i.join(t, "query_id", "left").join(g, "query_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    p = p.withColumns({"title_matches": empty("title_matches", "array<struct<id:string,score:double>>"), "groups": empty("groups", "array<struct<no:int,entity_id:string,role:string>>"), "has_title": F.col("title").isNotNull()})
    lost = F.when(F.col("has_title") & (F.size("title_matches") == 0), F.array(F.concat(F.lit("Title not found: "), "title.text"))).otherwise(F.array().cast("array<string>"))
    p = p.withColumn("unresolved", F.concat("unresolved", lost, F.transform(empty("_open", "array<struct<no:int,u:string>>"), lambda x: x["u"])))
    bounded = F.coalesce(*[F.col(b).cast("double") for b in BOUNDS]).isNotNull()
    filters = (F.size("genres") > 0) | bounded
    exact = F.col("has_title") & (F.size("title_matches") > 0) & F.forall("title_matches", lambda m: m["score"] == 1) & ~filters & (F.size("groups") == 0)
    intent = F.when(exact, "exact_title").when(F.size("groups") > 0, "person_discovery").when(filters, "filtered_discovery").when(F.col("sort_field").isNotNull(), "sorted_discovery").otherwise("general_search")
    known = F.col("has_title") | (F.size("people") > 0) | filters | F.col("sort_field").isNotNull()
    return p.select(
        "query_id", "mode", intent.alias("intent"), F.when(exact, "exact_title").when(filters, "structured").otherwise("dual").alias("strategy"), "has_title", "title_matches", "groups", "genres", "genre_mode", *BOUNDS, "sort_field", "sort_direction",
        "unresolved", ((F.size("genres") > 0) & ~F.col("has_title") & (F.size("people") == 0)).alias("is_structured"), ((F.size("unresolved") > 0) | ~known).alias("is_blocked"),
    )


def local_interpretations(queries: DataFrame, records: DataFrame, movies: DataFrame, persons: DataFrame, people: DataFrame, genres: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """PL25: an interpretation of each query (query_id, text) without a model. A person's whole name; else, in
    Devanagari, a title or nothing; else what the planner reads: genres, bounds, sort, people, and a
    title out of what is left."""
    q = cut(queries.select("query_id", "text"))
    name = cut(ml.match_aliases(q, persons, fuzzy=False).select("query_id").distinct())
    mention = F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("alternatives"))
    person = F.array(F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("alternatives"), F.lit(None).cast("string").alias("role")))
    whole = {"evidence": F.array("text")}
    by_name = q.join(name, "query_id").select(*interpretation(people=person, **whole))
    rest = q.join(name, "query_id", "left_anti").withColumn("_deva", F.col("text").rlike(r"\p{IsDevanagari}"))
    deva = cut(rest.where("_deva"))
    seen = ml.match_aliases(deva, movies).select("query_id").distinct().withColumn("_hit", F.lit(True))
    by_title = deva.join(seen, "query_id", "left").select(*interpretation(title=F.when(F.col("_hit").isNotNull(), mention), unresolved=F.when(F.col("_hit").isNull(), F.array("text")).otherwise(F.array().cast("array<string>")), **whole))
    other = cut(rest.where("not _deva").select("query_id", tx.unicode_text(F.col("text")).alias("text"), F.col("text").alias("raw")))
    plans = plan_queries(other.select("query_id", "text"), records, people, genres, names, False)
    linked = co.exact_people(other.select("query_id", "text"), people).join(people.select("entity_id", "name"), "entity_id")
    linked = linked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("start", F.col("phrase").alias("text"), F.array("name").alias("alternatives"), F.col("role")))).alias("_p"))
    j = other.join(plans.drop("text"), "query_id").join(linked, "query_id", "left")
    people_of = F.transform(F.coalesce("_p", F.array().cast("array<struct<start:int,text:string,alternatives:array<string>,role:string>>")), lambda x: F.struct(x["text"].alias("text"), x["alternatives"].alias("alternatives"), x["role"].alias("role")))
    j = j.withColumn("_people", people_of)
    bare = F.array_join(tx.ordered_tokens(F.col("title_query")), " ")
    for_people = F.aggregate("_people", bare, lambda acc, x: F.replace(F.replace(acc, x["text"], F.lit("")), F.lower(F.element_at(x["alternatives"], 1)), F.lit("")))
    j = j.withColumn("_title", F.btrim(F.regexp_replace(F.regexp_replace(for_people, ROLE_WORDS, ""), r"\s+", " ")))
    nothing = (F.col("_title") == "") & (F.size("_people") == 0) & (F.size("genres") == 0) & F.col("sort_source").isNull() & F.coalesce(*[F.col(b).cast("double") for b in BOUNDS]).isNull()
    text = F.when(nothing, F.col("raw")).when(F.col("_title") != "", F.col("_title"))
    title = F.when(text.isNotNull(), F.struct(text.alias("text"), F.array().cast("array<string>").alias("alternatives")))
    lost = F.when(F.col("unsupported").isNotNull(), F.array("unsupported")).otherwise(F.array().cast("array<string>"))
    sorted_ = F.col("sort_source").isNotNull()
    by_plan = j.select(*interpretation(title=title, people=F.col("_people"), genres=F.col("genres"), genre_mode=F.col("genre_mode"), **{b: F.col(b) for b in BOUNDS}, sort_field=F.when(sorted_, "year"), sort_direction=F.when(sorted_, "desc"), unresolved=lost, evidence=F.array("raw")))
    return by_name.unionByName(by_title).unionByName(by_plan)


def plan_requests(queries: DataFrame, records: DataFrame, movies: DataFrame, persons: DataFrame, people: DataFrame, genres: DataFrame, names: dict[str, str] | None = None, interpretations: DataFrame | None = None) -> DataFrame:
    """PL26/PL20: plans for queries (query_id, text) of 1 to 300 characters; each different text is planned once.
    A text that is a title's alias is that title; else a request for one or two genres is read by the grammar;
    else a given interpretation (text, columns of INTERPRETATION but query_id) is taken if it is valid; the rest
    is read without a model. `mode` says which: exact_alias, local_genre, model, or fallback and why."""
    ok = queries.where("text is not null and trim(text) <> ''").where(F.length("text") <= LONGEST)
    texts = cut(ok.select("text").distinct().withColumn("query_id", F.sha2("text", 256)))
    supported = sorted(r.genre for r in genres.where("genre is not null").distinct().limit(1001).collect())
    if len(supported) > 1000:
        raise ValueError("more than 1000 genres")
    mention = F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("alternatives"))
    exact = cut(ml.match_aliases(texts, movies, fuzzy=False).select("query_id").distinct())
    one = texts.join(exact, "query_id").select(*interpretation(title=mention, evidence=F.array("text")), F.lit("exact_alias").alias("mode"))
    left = texts.join(exact, "query_id", "left_anti")
    local = cut(ml.genre_requests(left, supported).select("query_id", F.col("genres").alias("_g"), F.col("genre_mode").alias("_m")))
    two = left.join(local, "query_id").select(*interpretation(genres=F.col("_g"), genre_mode=F.col("_m"), evidence=F.array("text")), F.lit("local_genre").alias("mode"))
    left = cut(left.join(local, "query_id", "left_anti"))
    out = one.unionByName(two)
    reason = F.lit("fallback:model_disabled")
    if interpretations is not None:
        given = cut(texts.select("query_id", "text").join(interpretations, "text").join(left.select("query_id"), "query_id", "left_semi"))
        judged = cut(interpretation_problems(left, given.select(*[c for c, _ in _columns()]), supported))
        out = out.unionByName(given.join(judged.where("problem is null").select("query_id"), "query_id", "left_semi").select(*[c for c, _ in _columns()], F.lit("model").alias("mode")))
        bad = judged.where("problem is not null").select("query_id", F.lit("fallback:invalid_output").alias("_why"))
        left = cut(left.join(judged.where("problem is null").select("query_id"), "query_id", "left_anti").join(bad, "query_id", "left"))
        reason = F.coalesce("_why", reason)
    why = left.select("query_id", reason.alias("mode"))
    rest = local_interpretations(left.select("query_id", "text"), records, movies, persons, people, genres, names)
    plans = compile_interpretations(out.unionByName(rest.join(why, "query_id")), movies, persons, people)
    return ok.select("query_id", F.sha2("text", 256).alias("_t")).join(plans.withColumnRenamed("query_id", "_t"), "_t").drop("_t")


def answer(plans: DataFrame, records: DataFrame, people: DataFrame, credits: DataFrame, n: int = 24) -> DataFrame:
    """QY3/SO5/JN13/JN14: (query_id, rank_no, id, score, total): the first n records of each plan that isn't blocked:
    of its titles, with all its people, within its filters; sorted before they are cut, nulls last, then by
    score. records: with rating evidence, cast and directors; people: (entity_id, name, movie_ids); credits:
    (entity_id, role, movie_id)."""
    content = ["has_title", "title_matches", "groups", "genres", "genre_mode", "is_structured", "sort_field", "sort_direction", *BOUNDS]
    asked = cut(plans.where("not is_blocked").withColumn("_r", F.sha2(F.to_json(F.struct(*content)), 256)))
    # every different request is answered once, whatever the number of queries that make it
    p = cut(asked.select(F.col("_r").alias("query_id"), *content).dropDuplicates(["query_id"]))
    r = cut(records.select("id", "title", "year", "genres", "average_rating", "rating_count", "eligible", "bayesian_rating", "rating_evidence", "cast", "directors"))
    titles = p.where("has_title").select("query_id", F.explode("title_matches").alias("m")).select("query_id", "m.id", F.col("m.score").alias("title_score"))
    groups = cut(p.select("query_id", F.explode("groups").alias("g")).select("query_id", F.col("g.no").alias("group_no"), "g.entity_id", "g.role"))
    n_groups = groups.groupBy("query_id").agg(F.count("*").alias("_n"))
    of_people = en.person_movies(groups, people, credits, r).groupBy("query_id", "movie_id").agg(F.count("*").alias("_held")).join(n_groups, "query_id").where("_held = _n").select("query_id", F.col("movie_id").alias("id"))
    of_people = cut(of_people)
    with_people = titles.join(of_people, ["query_id", "id"], "left_semi").join(n_groups, "query_id", "left_semi").unionByName(titles.join(n_groups, "query_id", "left_anti"))
    none = F.lit(None).cast("double")
    only_people = of_people.join(p.where("not has_title").select("query_id"), "query_id", "left_semi").withColumn("title_score", none)
    request = ["query_id", F.col("genres").alias("wanted"), (F.col("genre_mode") == "all").alias("mode_all"), "is_structured", "sort_field", "sort_direction", *BOUNDS]
    film = r.drop("cast", "directors")
    named = with_people.unionByName(only_people).join(ix.sent(p.select(*request)), "query_id").join(film, "id")
    # by filters alone, or none: films meet requests by the first of the wanted genres that they have, else block by block;
    # requests go to the films, so that of a pair nothing is shuffled but what is among a task's first
    bare = p.where("not has_title").join(n_groups, "query_id", "left_anti").select(*request)
    blocks = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.concat(F.lit("\x00"), i.cast("string")))
    keys = F.when(F.size("wanted") > 0, F.array_distinct("wanted")).otherwise(blocks)
    block = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("string"))
    keyed = film.withColumn("_k", F.explode(F.array_distinct(F.concat("genres", F.array(block)))))
    first = (F.size("wanted") == 0) | (F.get(F.array_intersect("wanted", "genres"), F.lit(0)) == F.col("_k"))
    listed = keyed.join(ix.sent(bare.withColumn("_k", F.explode(keys))), "_k").where(first).drop("_k").withColumn("title_score", none)
    kept = named.unionByName(listed).where(ix.matches_filters(*[F.col(c) for c in ("genres", "year", "average_rating", "rating_count", "wanted", "mode_all", *BOUNDS)]))
    held, focus = rk.genre_focus(F.col("wanted"), F.col("genres"))
    kept = kept.withColumns({"genre_focus": focus, "genre_matches": held})
    structured = F.when(F.col("is_structured"), rk.structured_genre_score(F.size("wanted"))).otherwise(0.0)
    kept = kept.withColumn("structured", structured).withColumn("score", F.coalesce("title_score", "structured"))
    rating = F.when(F.col("eligible"), F.col("average_rating"))
    value = F.when(F.col("sort_field") == "rating", rating).when(F.col("sort_field") == "ratingCount", F.col("rating_count").cast("double")).when(F.col("sort_field") == "year", F.col("year").cast("double"))
    signed = F.when(F.col("sort_direction") == "asc", value).otherwise(-value)
    order = [signed.asc_nulls_last(), F.desc("score"), F.desc("genre_matches"), F.desc("structured"), F.coalesce(rating, F.lit(0.0)).desc(), F.desc("rating_count"), "title", "id"]
    ranked = kept.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank_no") <= n)
    total = kept.groupBy("query_id").agg(F.count("*").alias("total"))
    answers = ranked.join(total, "query_id").select(F.col("query_id").alias("_r"), "rank_no", "id", "score", "total")
    return asked.select("query_id", "_r").join(answers, "_r").select("query_id", "rank_no", "id", "score", "total")
