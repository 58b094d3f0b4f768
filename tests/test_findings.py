"""What the review of round 2 found: the work that queries hand on, not only their results."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reelrank.functions.text import grapheme_distance
from reelrank.operators import entities as en
from reelrank.operators import index as ix
from reelrank.operators import multilingual as ml
from reelrank.operators.fuzzy import within_distance
from reelrank.plans import corrections as co
from reelrank.plans import judging as ju
from reelrank.plans import multilingual as mp
from reelrank.plans import people as pe
from reelrank.plans import search as sr
from reelrank.plans.planner import plan_queries
from reelrank.runtime import cut

from test_search import grams


def _texts(rng, n):
    return [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_trigram_pairs_stay_in_tasks(spark, monkeypatch):
    """no pair is shuffled before it is counted, and each task hands on the best alone; in one pass or many, whole or by halves."""
    rng = random.Random(7)
    titles, texts = _texts(rng, 300), [*_texts(rng, 40), "", "-"]
    r = spark.createDataFrame([(f"m{k}", t) for k, t in enumerate(titles)], "id string, title string")
    q = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, text string")
    want = {}
    for k, t in enumerate(texts):
        for j, u in enumerate(titles):
            m = len(set(grams(t)) & set(grams(u)))
            if m >= max(2, -(-len(grams(t)) * 12 // 100)):
                want[f"q{k}", f"m{j}"] = (m, len(grams(t)), len(grams(u)))
    for cells, a_pass in ((1 << 21, 300_000), (256, 100)):
        monkeypatch.setattr(ix, "CELLS", cells)
        monkeypatch.setattr(ix, "GRAMS_A_PASS", a_pass)
        for held in (None, ix.trigram_postings(r)):
            got = ix.trigram_lookup(q, r, held)
            assert {(x.query_id, x.id): (x.n_matched, x.n_query, x.n_title) for x in got.collect()} == want
            assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
        top = lambda rows: {tuple(x) for x in rows.selectExpr("query_id", "id", "n_matched", "row_number() over (partition by query_id order by n_matched desc, dice desc, id) r").where("r <= 5").collect()}
        assert top(ix.trigram_nearest(q, r, 5)) == top(ix.trigram_lookup(q, r))


def test_trigram_task_hands_on_its_best(monkeypatch):
    """of many records a task returns about as many rows a query as are asked for."""
    rng = random.Random(8)
    titles = _texts(rng, 2000)
    queries = pa.table({"query_id": ["a", "b"], "grams": ["".join(grams("abcd eab")), "".join(grams("cab"))]})
    monkeypatch.setattr(ix, "CELLS", 512)
    rows = pa.RecordBatch.from_pydict({"id": [str(k) for k in range(len(titles))], "grams": ["".join(grams(t)) for t in titles]})
    few, every = (sum(x.num_rows for x in ix.GramCounter(queries, ["id"], n)([rows])) for n in (3, None))
    assert 6 <= few < 60 < every


def test_movies_of_people_asks_once(spark, monkeypatch):
    """as many requests as people, however many pairs they make."""
    rows = [("m1", r, None, f"{r} {k}") for r in ("actor", "director") for k in range(30)] + [("m2", "actor", None, "actor 0"), ("m2", "director", None, "actor 0"), ("m3", "actor", None, "lone")]
    monkeypatch.setattr(pe, "credits", lambda *_: spark.createDataFrame(rows, "movie_id string, role string, person_id string, name string"))
    asked, whole = [], en.person_movies
    monkeypatch.setattr(en, "person_movies", lambda groups, *a: asked.append(groups.count()) or whole(groups, *a))
    got = sorted(tuple(r) for r in ju.movies_of_people(spark, "").collect())
    of = lambda a, d: f"person:name:{a}+person:name:{d}"
    assert got == sorted([(of(f"actor-{a}", f"director-{d}"), "m1") for a in range(30) for d in range(30)] + [(of("actor-0", "actor-0"), "m2")])
    assert asked == [62]


def test_trigram_first(spark, monkeypatch):
    """the first of each query alone, ties by title and id, in whatever blocks and chunks."""
    rng = random.Random(9)
    titles, texts = _texts(rng, 400), [*_texts(rng, 60), "", "zz"]
    titles += titles[:40]
    r = spark.createDataFrame([(f"m{k}", t) for k, t in enumerate(titles)], "id string, title string")
    q = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, text string")
    want = set()
    for k, t in enumerate(texts):
        g = set(grams(t))
        hits = [(-len(g & set(grams(u))), u, f"m{j}") for j, u in enumerate(titles)]
        want |= {(f"q{k}", t, i, u, -m) for m, u, i in sorted(h for h in hits if -h[0] >= max(2, -(-len(g) * 12 // 100)))[:7]}
    for cells in (1 << 21, 512):
        monkeypatch.setattr(ix, "CELLS", cells)
        assert {tuple(x) for x in ix.trigram_first(q, r, 7).collect()} == want


def _no_pairs(*_):
    raise AssertionError("pairs of queries and titles by trigram are shuffled")


def test_corrections_keep_pairs_in_blocks(spark, monkeypatch):
    """F8, F6: the corrections and the whole plans take the first titles of each query only; a title beyond the 200th is no rival."""
    monkeypatch.setattr(ix, "_trigram_hits", _no_pairs)
    rows = [("a", "Interstellar"), ("b", "Glory Road"), *((f"x{k}", f"Meadow {k:03d} harbor interlude stellar") for k in range(230))]
    r = spark.createDataFrame(rows, "id string, title string")
    q = spark.createDataFrame([("q1", "intersteler"), ("q2", "glory road"), ("q3", "movie called glry road")], "query_id string, text string")
    people = spark.createDataFrame([("p", "Dana Ray", ["actor"], 1, 1, 0)], "entity_id string, name string, roles array<string>, movie_count int, actor_movie_count int, director_movie_count int")
    genres = spark.createDataFrame([("Drama",)], "genre string")
    got = {x.query_id: (x.entity_type, x.replacement, x.policy) for x in co.corrections(q, r, people, genres).collect()}
    assert got == {"q1": ("title", "Interstellar", "automatic"), "q3": ("title", "Glory Road", "automatic")}
    plans = {x.query_id: (x.effective_query, x.correction) for x in plan_queries(q, r, people, genres).collect()}
    assert plans == {"q1": ("interstellar", "title"), "q2": ("glory road", None), "q3": ("movie called glory road", "title")}


def test_corrections_ask_each_target_once(spark, monkeypatch):
    """F8: queries of one text are looked up once; each keeps its own policy."""
    asked, whole = [], co.trigram_first
    monkeypatch.setattr(co, "trigram_first", lambda q, *a: asked.append(q.count()) or whole(q, *a))
    r = spark.createDataFrame([("a", "The Interstellar (part two)"), ("b", "Glory Road")], "id string, title string")
    q = spark.createDataFrame([("q1", "intersteler"), ("q2", "Intersteler"), ("q3", "movie called glry road"), ("q4", "glry road"), ("q5", "nothing alike")], "query_id string, text string")
    got = {x.query_id: (x.original, x.replacement, x.distance, x.policy) for x in co.title_corrections(q, r).collect()}
    title, road = ("intersteler", "The Interstellar (part two)", 2, "automatic"), ("glry road", "Glory Road", 1)
    assert got == {"q1": title, "q2": title, "q3": (*road, "automatic"), "q4": (*road, "suggest")}
    assert asked == [3]


def test_near_names_are_not_broadcast(spark):
    """the hundreds of keys of each text are never sent whole to the driver, however few texts an estimate sees."""
    a, b = (spark.createDataFrame([(x,) for x in t], f"{c} string") for c, t in (("a", ["jane rowe", "jon"]), ("b", ["jane roe", "joan", "bob"])))
    near = within_distance(a, b, "a", "b", 2)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in near.collect()} == {("jane rowe", "jane roe", 1), ("jon", "joan", 1), ("jon", "bob", 2)}
    alike = within_distance(a, b, "a", "b", 2, lambda c: F.left(c, F.lit(1)))
    assert {tuple(x) for x in alike.collect()} == {("jane rowe", "jane roe", 1), ("jon", "joan", 1)}


def test_grounding_counts_in_tasks(spark, monkeypatch):
    """of all aliases that share something with a query few rows leave the tasks; an equal alias with a late id is on the short list all the same."""
    handed, whole = [], ml.shared_terms
    monkeypatch.setattr(ml, "shared_terms", lambda *a, **k: handed.append(whole(*a, **k)) or handed[-1])
    names = [(f"e{k:04d}", 0, f"Harbor night {k}") for k in range(400)] + [("z", 0, "Harbor night"), ("zz", 0, "Harbour nights")]
    aliases = spark.createDataFrame(names, "entity_id string, pos int, text string").withColumn("key", F.lower("text"))
    q = spark.createDataFrame([("q", "the harbor night again"), ("r", "harbour night"), ("s", "night harbor harbor")], "query_id string, text string")
    got = {(x.query_id, x.rank_no): x.entity_id for x in ml.ground(q, aliases).collect()}
    assert got["q", 1] == "z" and got["r", 1] == "zz"
    tasks = handed[0].rdd.getNumPartitions()
    assert handed[0].count() <= 3 * ml.SHORTLIST * tasks < 3 * 402 * tasks
    found = {(x.query_id, x.entity_id): round(x.score, 6) for x in ml.match_aliases(q, aliases).collect()}
    assert found["r", "zz"] == round(0.65 * (1 - 1 / 14), 6) and ("s", "e0001") not in found


def test_candidates_merge_by_hash(spark):
    """sources of a pair are merged by a hash aggregate, before and after the shuffle; their names in order."""
    records = spark.createDataFrame([("a", "Glory Road", "Glory Road", ["Drama"]), ("b", "Road to Fury", "Road to Fury", ["Comedy"])], "id string, title string, source_title string, genres array<string>").withColumns({"year": F.lit(1990), "average_rating": F.lit(4.0), "rating_count": F.lit(9).cast("bigint")})
    plans = cut(sr.plan_alone(spark.createDataFrame([("q", "glory road"), ("d", "drama movies")], "query_id string, text string"), {"drama": "Drama"}))
    found = sr.candidates(plans, records, cut(ix.best_field(sr.field_matches(plans, records))))
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(x.query_id, x.id): x.sources for x in found.collect()}
    assert got["q", "a"] == ["exact", "token", "trigram"] and got["d", "a"] == ["metadata"] and got["q", "b"] == ["token", "trigram"]


def test_signals_of_no_weight_are_not_computed(spark):
    """without a weight for order no pair goes to Python; scores are those of all six contributions."""
    records = spark.createDataFrame([("a", "Glory Road", "Glory Road", ["Drama"]), ("b", "Road to Glory", "Road to Glory", ["Comedy"])], "id string, title string, source_title string, genres array<string>").withColumns({"year": F.lit(1990), "average_rating": F.lit(4.0), "rating_count": F.lit(9).cast("bigint")})
    plans = cut(sr.plan_alone(spark.createDataFrame([("q", "glory road")], "query_id string, text string"), {}))
    fields = cut(ix.best_field(sr.field_matches(plans, records)))
    found = cut(sr.candidates(plans, records, fields))
    weights = {"token_coverage": 40, "ordered_coverage": 0, "phrase_match": 0, "proximity": 0, "dice": 30, "edit_similarity": 30}
    scored = sr.score(plans, found, records, fields, weights)
    slim = scored.select("id", "title_score")
    assert "ArrowEvalPython" not in slim._jdf.queryExecution().executedPlan().toString()
    fixed = lambda x: math.floor(x * 1e6 + 0.5) / 1e6
    for r in scored.collect():
        assert r.title_score == fixed(sum(fixed(r[k] * w / 100) for k, w in weights.items()))


def test_ranking_keeps_narrow_pairs(spark, monkeypatch):
    """what is kept of all scored pairs for the boosts has no tokens and trigrams, and rows without a person are not regrouped."""
    kept, whole = [], sr.cut
    monkeypatch.setattr(sr, "cut", lambda df: kept.append(df.columns) or whole(df))
    rows = [("a", "Glory Road", ["Dana Ray"]), ("b", "Ray of Light", []), ("c", "The Long Way", ["Dana Ray"]), ("d", "Quiet Harbor", ["Ann Lee"])]
    records = spark.createDataFrame([(i, t, t, ["Drama"], c, []) for i, t, c in rows], "id string, title string, source_title string, genres array<string>, cast array<string>, directors array<string>").withColumns({"year": F.lit(1990), "average_rating": F.lit(4.0), "rating_count": F.lit(9).cast("bigint")})
    people = spark.createDataFrame([("p", "Dana Ray", ["actor"], 2, 2, 0)], "entity_id string, name string, roles array<string>, movie_count int, actor_movie_count int, director_movie_count int")
    found = sr.search(spark.createDataFrame([("q", "ray"), ("r", "glory road")], "query_id string, text string"), records, people=people, genres=spark.createDataFrame([("Drama",)], "genre string"))
    assert any("combined_score" in c for c in kept) and not any({"q_grams", "r_grams"} & {*c} for c in kept if "combined_score" in c)
    assert {(x.query_id, x.id, x.person_id, x.boost > 0) for x in found.collect()} >= {("q", "a", "p", True), ("q", "c", "p", True), ("q", "b", None, False), ("r", "a", None, False)}


def test_distances_of_many_pairs():
    """the distances that decide which records stay are exact, for texts of any length."""
    rng = random.Random(3)
    one, other = (["".join(rng.choice("abc d0") for _ in range(rng.choice(sizes))) for _ in range(60)] for sizes in ([1, 3, 20, 63, 64, 65, 90], [1, 2, 8, 25, 64, 100]))
    q, r = np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60)
    got = ix.Distances(pa.array(one))(q, ix.Texts(pa.array(other)), r)
    assert got.tolist() == [grapheme_distance(one[a], other[b]) for a, b in zip(q, r)]


def test_search_scores_contenders_alone(spark, monkeypatch):
    """of records that trigrams alone nominate only those that can be among the results are handed on; results stay."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(3, 7))) for _ in range(40)] + ["the", "of", "in"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = [(f"m{k}", t, t, ["Drama"], rng.sample(words, 2), [], []) for k, t in enumerate(titles)]
    records = spark.createDataFrame(rows, "id string, title string, source_title string, genres array<string>, tags array<string>, cast array<string>, directors array<string>").withColumns({"year": F.lit(1990), "average_rating": F.lit(4.0), "rating_count": F.lit(9).cast("bigint")})
    texts = [t[:-1] for t in titles[:12] if len(t) > 5] + ["the of", "in", "abc", *words[:4]]
    queries = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, text string")
    whole, sizes = sr.candidates, []

    def counted(plans, records, fields, index=None, first=None, weights=None):
        out = cut(whole(plans, records, fields, index, first if few else None, weights))
        sizes.append(out.count())
        return out

    monkeypatch.setattr(sr, "candidates", counted)
    got = []
    for few in (True, False):
        got.append(sorted(map(tuple, sr.search(queries, records, 5).collect()), key=str))
    assert got[0] == got[1] and len(got[0]) > 60 and sizes[0] <= sizes[1] - 100


def test_equal_requests_are_answered_once(spark, monkeypatch):
    """films meet each different request once, and no pair of a film and a request is shuffled before a task's best are taken."""
    films = [(str(k), f"Film {k}", 1990 + k % 7, ["Drama", "War"][: 1 + k % 2], 3.0 + k % 3, 9, [], [], True, 3.5, 0.5) for k in range(60)]
    r = spark.createDataFrame(films, "id string, title string, year int, genres array<string>, average_rating double, rating_count bigint, cast array<string>, directors array<string>, eligible boolean, bayesian_rating double, rating_evidence double")
    asked = [(f"q{k}", False, [], [], g, m, y, None, None, None, s, s and "desc", bool(g), False) for k in range(20) for g, m, y, s in [((["War", "Drama"], "all", None, None), (["War", "Drama"], "any", None, None), ([], "any", 1995, None), ([], "any", None, "year"))[k % 4]]]
    plans = spark.createDataFrame(asked, "query_id string, has_title boolean, title_matches array<struct<id:string,score:double>>, groups array<struct<no:int,entity_id:string,role:string>>, genres array<string>, genre_mode string, year_min int, year_max int, rating_min double, count_min bigint, sort_field string, sort_direction string, is_structured boolean, is_blocked boolean")
    people = spark.createDataFrame([], "entity_id string, name string, movie_ids array<string>")
    sent, whole = [], ix.sent
    monkeypatch.setattr(ix, "sent", lambda df: sent.append(df.select("query_id").distinct().count()) or whole(df))
    got = mp.answer(plans, r, people, spark.createDataFrame([], "entity_id string, role string, movie_id string"), 5)
    assert max(sent) == 4
    want = {0: 30, 1: 60, 2: sum(f[2] >= 1995 for f in films), 3: 60}
    rows = got.collect()
    assert len(rows) == 100 and all(x.total == want[int(x.query_id[1:]) % 4] for x in rows)
    assert len({(int(x.query_id[1:]) % 4, x.rank_no, x.id, x.score) for x in rows}) == 20


def test_near_aliases_are_compared_in_tasks(spark, monkeypatch):
    """what is handed on of aliases near by trigrams are those near enough, in one pass or many."""
    rng = random.Random(4)
    one, other = ([[rng.choice(["a", "b", "c", "क्ष", "ह"]) for _ in range(rng.choice([4, 6, 9, 70]))] for _ in range(n)] for n in (30, 80))
    three = lambda t: sorted({"".join(["^", *t, "$"][i : i + 3]) for i in range(len(t))})
    q, r = (spark.createDataFrame([(str(k), three(t), t) for k, t in enumerate(ts)], f"{c} string, grams array<string>, chars array<string>") for c, ts in (("query_id", one), ("id", other)))
    want = {(str(i), str(j), grapheme_distance(a, b)) for i, a in enumerate(one) for j, b in enumerate(other) if 2 * len({*three(a)} & {*three(b)}) / (len(three(a)) + len(three(b))) >= 0.3 and grapheme_distance(a, b) <= 0.36 * max(len(a), len(b))}
    for a_pass in (300_000, 100):
        monkeypatch.setattr(ix, "GRAMS_A_PASS", a_pass)
        assert {tuple(x) for x in ix.near_texts(q, r, 0.3, 0.36).collect()} == want and want


def test_records_are_written_once_a_core(spark):
    """the copies of the records that blocks of queries meet don't grow with the partitions of shuffles."""
    r = spark.createDataFrame([(f"m{k}", f"Silver Harbor {k}") for k in range(30)], "id string, title string")
    q = spark.createDataFrame([("q", "silver harbr")], "query_id string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        for out in (ix.trigram_first(q, r, 3), ix.trigram_contenders(q, r, 3, 0.15, 0.15)):
            assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
            assert out.count() >= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
