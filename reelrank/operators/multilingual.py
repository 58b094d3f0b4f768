"""Unicode aliases, grounding and the genre grammar in three scripts (IX16-IX19, PL23, QY3,
JN15)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.operators.fuzzy import windows
from reelrank.operators.index import near_texts, shared_terms
from reelrank.runtime import cut, sized_broadcast

#: How genres are called, by genre.
GENRE_TERMS = {
    "Action": ["एक्शन", "एक्शन वाली", "मारधाड़", "मार धाड़", "action"],
    "Adventure": ["एडवेंचर", "साहसिक", "रोमांचक साहसिक", "adventure"],
    "Animation": ["एनिमेशन", "एनीमेशन", "एनिमेटेड", "कार्टून", "animation", "animated", "cartoon"],
    "Children": ["बच्चों की", "बच्चों के लिए", "bachchon ki", "bachon ki", "kids", "children"],
    "Comedy": ["कॉमेडी", "हास्य", "मजेदार", "मज़ेदार", "हँसाने वाली", "हंसाने वाली", "comedy", "comedies", "mazedar", "majedar", "hasane wali", "hansane wali"],
    "Crime": ["क्राइम", "अपराध", "अपराध वाली", "crime"],
    "Documentary": ["डॉक्यूमेंट्री", "वृत्तचित्र", "documentary", "documentaries"],
    "Drama": ["ड्रामा", "drama"],
    "Fantasy": ["फैंटेसी", "फंतासी", "fantasy"],
    "Film-Noir": ["फिल्म नोयर", "film-noir", "film noir"],
    "Horror": ["हॉरर", "डरावनी", "डरावना", "डरावने", "horror", "darawani", "darawane", "darawni", "daravni", "daravani", "daravne"],
    "Musical": ["म्यूजिकल", "संगीतमय", "musical", "musicals"],
    "Mystery": ["मिस्ट्री", "रहस्य", "रहस्यमय", "mystery", "rahasya", "rahasyamay"],
    "Romance": ["रोमांस", "रोमांटिक", "प्रेम", "प्यार वाली", "romance", "romantic", "pyaar wali", "pyar wali"],
    "Sci-Fi": ["साइंस फिक्शन", "विज्ञान कथा", "science fiction", "sci-fi", "sci fi", "vigyan katha"],
    "Thriller": ["थ्रिलर", "thriller"],
    "War": ["युद्ध", "युद्ध वाली", "जंग वाली", "war", "yudh", "yuddh", "jung wali"],
    "Western": ["वेस्टर्न", "western"],
    "IMAX": ["आईमैक्स", "imax"],
}
SHORTLIST, ALIAS_HEAD, MAX_WORDS, MAX_WINDOW = 30, 12, 32, 5


def alias_catalog(entities: DataFrame) -> DataFrame:
    """IX16: (entity_id, pos, text, source, language, script, key): the name, the name without
    a bracketed year, then `aliases` array<struct<text, source, language>> of entities
    (entity_id, name, aliases); of one key the first of an entity."""
    own = F.array(F.struct(F.col("name").alias("text"), F.lit("catalogue").alias("source"), F.lit("und").alias("language")), F.struct(F.regexp_replace("name", r"\s*\(\d{4}\)\s*$", "").alias("text"), F.lit("catalogue").alias("source"), F.lit("und").alias("language")))
    more = F.transform(F.coalesce("aliases", F.expr("array()")), lambda a: F.struct(a["text"].alias("text"), a["source"].alias("source"), F.coalesce(a["language"], F.lit("und")).alias("language"))) if "aliases" in entities.columns else None
    rows = entities.select("entity_id", F.posexplode(F.concat(own, more) if more is not None else own).alias("pos", "a")).select("entity_id", "pos", "a.*").where("text is not null")
    keyed = rows.withColumn("script", tx.script_of(F.col("text"))).withColumn("normal", tx.unicode_text(F.col("text"))).withColumn("key", tx.unicode_key(F.col("normal"))).where("key <> ''")
    first = keyed.groupBy("entity_id", "key").agg(F.min_by(F.struct("pos", "text", "source", "language", "script"), "pos").alias("f"))
    return first.select("entity_id", "f.*", "key")


def alias_coverage(aliases: DataFrame) -> DataFrame:
    """AG31: one row: entities, aliases, and entities with an alias in Devanagari."""
    per = aliases.groupBy("entity_id").agg(F.count("*").alias("n"), F.max((F.col("script").isin("devanagari", "mixed")).cast("int")).alias("deva"))
    return per.agg(F.count("*").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("aliases"), F.coalesce(F.sum("deva"), F.lit(0)).alias("with_devanagari"))


def _features(key: Column) -> dict[str, Column]:
    """Arrays of a key: tokens, graphemes and grapheme trigrams."""
    return {"toks": F.split(key, " "), "chars": tx.graphemes(key), "grams": tx.grapheme_trigrams(tx.graphemes(key))}


def match_aliases(queries: DataFrame, aliases: DataFrame, fuzzy: bool = True, prefix: bool = False) -> DataFrame:
    """IX17: (query_id, entity_id, score, text): each entity's best alias for each query. An equal
    key scores 1, a prefix .9, full token coverage .8; else, with trigram dice of .3, four
    graphemes and similarity .65, .65 times the similarity. Queries with an equal key anywhere
    look no further. Candidates come from equi-joins on keys, rarest tokens and prefixes, and from counts of trigrams."""
    q = queries.select("query_id", tx.unicode_text(F.col("text")).alias("normal")).select("query_id", tx.unicode_key(F.col("normal")).alias("qkey")).where("qkey <> ''")
    q = cut(q.withColumns({f"q{k}": v for k, v in _features(F.col("qkey")).items()}))
    a = cut(aliases.select("entity_id", "pos", "text", F.col("key").alias("akey")).withColumns({f"a{k}": v for k, v in _features(F.col("akey")).items()}))
    best = lambda df: df.groupBy("query_id", "entity_id").agg(F.max_by(F.struct("score", "text"), F.struct("score", -F.col("pos"))).alias("b")).select("query_id", "entity_id", "b.score", "b.text")
    exact = q.join(a, F.col("qkey") == F.col("akey")).select("query_id", "entity_id", "pos", "text", F.lit(1.0).alias("score"))
    scored = exact
    if prefix:
        k = a.withColumn("k", F.left("akey", F.lit(2)))
        started = q.where(F.length("qkey") >= 2).withColumn("k", F.left("qkey", F.lit(2))).join(k, "k").where(F.startswith("akey", F.col("qkey")) & (F.col("akey") != F.col("qkey")))
        scored = scored.unionByName(started.select("query_id", "entity_id", "pos", "text", F.lit(0.9).alias("score")))
    if fuzzy:
        left = q.join(exact.select("query_id").distinct(), "query_id", "left_anti")
        # every query word in the alias: its rarest word nominates; a query that repeats a word is covered by none
        words = a.select("entity_id", "pos", F.explode(F.array_distinct("atoks")).alias("k"))
        held = words.groupBy("k").agg(F.count("*").alias("n"))
        asked = left.where(F.size("qtoks") == F.size(F.array_distinct("qtoks"))).select("query_id", "qtoks", F.explode("qtoks").alias("k")).join(held, "k", "left")
        rarest = asked.groupBy("query_id").agg(F.max(F.col("n").isNull()).alias("lost"), F.min_by(F.struct("k", "qtoks"), F.struct("n", "k")).alias("r")).where(~F.col("lost")).select("query_id", "r.*")
        inside = rarest.join(words, "k").join(a.select("entity_id", "pos", "text", "atoks"), ["entity_id", "pos"]).where(F.size(F.array_except("qtoks", "atoks")) == 0)
        scored = scored.unionByName(inside.select("query_id", "entity_id", "pos", "text", F.lit(0.8).alias("score")))
        # near by trigrams: counted and compared in the task that has the alias; .36, as a similarity of .65 is rounded
        place = F.to_json(F.struct("entity_id", "pos"))
        asked = left.where(F.size("qchars") >= 4).select("query_id", F.col("qgrams").alias("grams"), F.col("qchars").alias("chars"))
        hit = cut(near_texts(asked, a.select(place.alias("id"), F.col("agrams").alias("grams"), F.col("achars").alias("chars")), 0.3, 0.36))
        at = F.from_json("id", "entity_id string, pos int")
        hit = hit.select("query_id", at.alias("at"), "distance").select("query_id", "at.*", "distance").join(left.select("query_id", "qchars", "qtoks"), "query_id")
        pairs = sized_broadcast(hit, hit.count()).join(a.select("entity_id", "pos", "text", "achars", "atoks"), ["entity_id", "pos"])
        covered = (F.size("qtoks") == F.size(F.array_distinct("qtoks"))) & (F.size(F.array_except("qtoks", "atoks")) == 0)
        near = 1 - F.col("distance") / F.greatest(F.size("qchars"), F.size("achars"))
        scored = scored.unionByName(pairs.where(~covered).withColumn("near", near).where("near >= 0.65").select("query_id", "entity_id", "pos", "text", (0.65 * F.col("near")).alias("score")))
    return best(scored)


def suggest_aliases(queries: DataFrame, aliases: DataFrame, n: int = 8) -> DataFrame:
    """IX18: the n first entities whose alias starts with the text (two characters or more)."""
    q = queries.where(F.length(F.btrim("text")) >= 2)
    found = match_aliases(q, aliases, fuzzy=False, prefix=True)
    ranked = found.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "text", "entity_id")))
    return ranked.where(F.col("rank_no") <= n)


def ground(queries: DataFrame, aliases: DataFrame, n: int = 5) -> DataFrame:
    """IX19: (query_id, rank_no, entity_id, alias, matched_text, score): the n entities that the
    words of each query may mean. Runs of 1 to 5 of the first 32 words nominate with 100 + their
    length for an equal alias, 2 per word, 1 per trigram; the 30 best are compared with the runs
    whose length differs by at most 1: 1 for equal, .85 times the similarity from .65 on (dice .45)."""
    q = queries.select("query_id", tx.unicode_text(F.col("text")).alias("normal")).select("query_id", F.slice(tx.unicode_tokens(F.col("normal")), 1, MAX_WORDS).alias("ws")).where(F.size("ws") > 0)
    w = cut(windows(q, "ws", 1, MAX_WINDOW).select("query_id", F.col("size").alias("wsize"), F.col("phrase").alias("wkey")).distinct().withColumns({f"w{k}": v for k, v in _features(F.col("wkey")).items() if k != "toks"}))
    a = cut(aliases.select("entity_id", "pos", F.col("text").alias("alias"), F.col("key").alias("akey")).withColumns({f"a{k}": v for k, v in _features(F.col("akey")).items()}))
    whole = tx.grapheme_trigrams(tx.graphemes(F.array_join("ws", " ")))
    exact = w.join(a, F.col("wkey") == F.col("akey")).select("query_id", "entity_id", "wkey", (F.lit(100) + F.col("wsize")).alias("points")).distinct()
    # a word counts twice: as two terms
    twice = lambda ws: F.flatten(F.transform(F.array_distinct(ws), lambda t: F.array(F.concat(F.lit("\x00"), t), F.concat(F.lit("\x01"), t))))
    asked = cut(q.select("query_id", F.concat(F.array_distinct(whole), twice("ws")).alias("grams")))
    held = cut(a.groupBy("entity_id").agg(F.array_distinct(F.flatten(F.collect_list(F.concat("agrams", twice("atoks"))))).alias("grams")).withColumnRenamed("entity_id", "id"))
    # the first by words and trigrams and those with an equal alias: no other can be on the short list
    base = shared_terms(asked, held, SHORTLIST, exact=True).select("query_id", F.col("id").alias("entity_id"), F.col("n_matched").alias("points"))
    sure = exact.groupBy("query_id", "entity_id").agg(F.sum("points").alias("points")).join(asked, "query_id").join(held.select(F.col("id").alias("entity_id"), F.col("grams").alias("has")), "entity_id")
    sure = sure.select("query_id", "entity_id", (F.col("points") + F.size(F.array_intersect("grams", "has"))).alias("points"))
    points = base.unionByName(sure).groupBy("query_id", "entity_id").agg(F.max("points").alias("points"))
    short = points.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("points"), "entity_id"))).where(F.col("r") <= SHORTLIST).select("query_id", "entity_id")
    has_exact = exact.select("query_id", "entity_id").distinct().withColumn("is_exact", F.lit(True))
    usable = short.join(has_exact, ["query_id", "entity_id"], "left").join(a, "entity_id")
    head = usable.withColumn("i", F.row_number().over(W.partitionBy("query_id", "entity_id").orderBy("pos"))).where(F.col("is_exact").isNotNull() | (F.col("i") <= ALIAS_HEAD))
    pairs = head.join(w, "query_id").where(F.abs(F.size("atoks") - F.col("wsize")) <= 1)
    same = F.col("akey") == F.col("wkey")
    pairs = pairs.where(same | (F.col("is_exact").isNull() & (F.length("wkey") >= 4)))
    dice = F.try_divide(2.0 * F.size(F.array_intersect("wgrams", "agrams")), F.size("wgrams") + F.size("agrams"))
    pairs = pairs.withColumn("dice", dice).where(same | (F.col("dice") >= 0.45))
    near = 1 - F.when(~same, tx.grapheme_distance_udf("wchars", "achars")) / F.greatest(F.size("wchars"), F.size("achars"))
    scored = pairs.withColumn("near", near).withColumn("score", F.when(same, 1.0).when(F.col("near") >= 0.65, 0.85 * F.col("near"))).where("score is not null")
    best = scored.groupBy("query_id", "entity_id").agg(F.max_by(F.struct("alias", F.col("wkey").alias("matched_text"), "score", "wsize"), F.struct("score", -F.col("pos"), "wsize", "wkey")).alias("b"))
    ranked = best.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("b.score"), F.desc("b.wsize"), "entity_id"))).where(F.col("rank_no") <= n)
    return ranked.select("query_id", "rank_no", "entity_id", "b.alias", "b.matched_text", "b.score")


def genre_requests(queries: DataFrame, supported: list[str]) -> DataFrame:
    """PL23: (query_id, genres, genre_mode) of queries that ask for one or two genres and
    nothing else, in Hindi, Hindi in Latin letters or English; others give no row."""
    known = {}
    for genre, names in GENRE_TERMS.items():
        if genre in supported:
            for name in [genre, *names]:
                known[" ".join(unicodedata.normalize("NFC", name).lower().replace("-", " ").split())] = genre
    terms = queries.sparkSession.createDataFrame(sorted(known.items()), "part string, genre string") if known else queries.sparkSession.createDataFrame([], "part string, genre string")
    q = queries.select("query_id", tx.unicode_text(F.col("text")).alias("t"))
    strip = lambda c, p: F.regexp_replace(c, p, "")
    t = F.btrim(strip(F.col("t"), "[.!?।]+$"))
    t = strip(t, "^(?:show me|show|मुझे|mujhe) ")
    t = strip(t, " (?:दिखाओ|दिखाइए|dikhao|dikhaiye)$")
    t = strip(t, " (?:फिल्में|फ़िल्में|फिल्म|फ़िल्म|मूवीज़|मूवीज|movies?|films?|filmein|filme)$")
    t = strip(t, " (?:वाली|wali)$")
    q = q.withColumn("t", t)
    q = q.withColumn("both", F.col("t").rlike(" (?:दोनों|dono|both)$")).withColumn("u", strip(F.col("t"), " (?:दोनों|dono|both)$"))
    q = cut(q.withColumn("has_or", F.col("u").rlike(" (?:या|or|ya) ")).withColumn("parts", F.split("u", " (?:और|and|aur|या|or|ya) ")))
    # the whole request and its parts, as they are and with the suffix that some terms have
    wanted = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("t").alias("p"))), F.transform("parts", lambda x, i: F.struct(i.alias("at"), x.alias("p"))))
    forms = q.select("query_id", F.explode(wanted).alias("w")).select("query_id", "w.at", F.posexplode(F.array(F.col("w.p"), F.concat(F.col("w.p"), F.lit(" वाली")), F.concat(F.col("w.p"), F.lit(" wali")))).alias("form", "part"))
    hit = forms.join(F.broadcast(terms), "part").groupBy("query_id", "at").agg(F.min_by("genre", "form").alias("genre"))  # terms: the fixed list above
    per = hit.groupBy("query_id").agg(F.max(F.when(F.col("at") == -1, F.col("genre"))).alias("single"), F.max(F.when(F.col("at") == 0, F.col("genre"))).alias("a"), F.max(F.when(F.col("at") == 1, F.col("genre"))).alias("b"))
    j = q.join(per, "query_id")
    two = (F.size("parts") == 2) & ~(F.col("has_or") & F.col("both")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    genres = F.when(F.col("single").isNotNull(), F.array("single")).when(two, F.array_distinct(F.array("a", "b")))
    mode = F.when(F.col("single").isNotNull() | F.col("has_or"), "any").otherwise("all")
    return j.select("query_id", genres.alias("genres"), mode.alias("genre_mode")).where("genres is not null")


def match_catalogue(candidates: DataFrame, films: DataFrame) -> DataFrame:
    """JN15: (candidate_id, film_id): films (id, title, year, people array<string>) with the same
    judged title (TX26), years at most 1 apart (a null year agrees with any) and, where
    the candidate names a person, that person (TX27); of several the least id."""
    toks = lambda c: F.split(c, " ")
    a = candidates.select("candidate_id", tx.judged_title_udf("title").alias("k"), F.col("year").alias("y1"), F.when(F.col("person").isNotNull() & (F.btrim("person") != ""), toks(tx.person_key_udf("person"))).alias("p1")).where("k <> ''")
    b = films.select(F.col("id").alias("film_id"), tx.judged_title_udf("title").alias("k"), F.col("year").alias("y2"), "people").where("k <> ''")
    people = b.select("film_id", F.explode("people").alias("person")).select("film_id", toks(tx.person_key_udf("person")).alias("ts")).groupBy("film_id").agg(F.collect_set("ts").alias("p2"))
    pairs = a.join(b.drop("people"), "k").where(F.col("y1").isNull() | F.col("y2").isNull() | (F.abs(F.col("y1") - F.col("y2")) <= 1)).join(people, "film_id", "left")
    ok = F.col("p1").isNull() | F.coalesce(F.exists("p2", lambda t: tx.same_person(F.col("p1"), t)), F.lit(False))
    return pairs.where(ok).groupBy("candidate_id").agg(F.min("film_id").alias("film_id"))


def retrieve(requests: DataFrame, records: DataFrame, sort: str | None = None, descending: bool = True, n: int = 24) -> DataFrame:
    """QY3/SO5: requests (query_id, genres, genre_mode) answered from records with rating evidence:
    filtered, ranked by the structured genre score, sorted by `sort` (year, average_rating or
    rating_count; nulls last, averages of too few ratings are null) *before* the first n are kept."""
    from reelrank.operators import ranking as rk
    from reelrank.operators.index import matches_filters

    r = records.withColumn("average_rating", F.when(F.col("eligible"), F.col("average_rating"))) if sort == "average_rating" else records
    q = requests.select("query_id", F.col("genres").alias("wanted"), (F.col("genre_mode") == "all").alias("mode_all")).withColumn("g", F.explode("wanted"))
    none = F.lit(None).cast("double")
    pairs = q.join(r.withColumn("g", F.explode(F.array_distinct("genres"))), "g").where(matches_filters(F.col("genres"), F.col("year"), none, F.col("rating_count"), F.col("wanted"), F.col("mode_all"), none, none, none, none)).drop("g").dropDuplicates(["query_id", "id"])
    _, focus = rk.genre_focus(F.col("wanted"), F.col("genres"))
    scored = pairs.withColumn("genre_focus", focus).withColumn("score", rk.structured_genre_score(F.size("wanted")))
    first = [] if sort is None else [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()]
    ranked = scored.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(*first, F.desc("score"), F.desc("rating_count"), "title", "id")))
    return ranked.where(F.col("rank_no") <= n).select("query_id", "rank_no", "id", "score")
