"""What the review of round 1 found missing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from reelrank.operators import entities as en
from reelrank.operators import evaluation as ev
from reelrank.operators import ranking as rk
from reelrank.operators import review as rv
from reelrank.operators.packed import explode_packed


def test_median(spark):
    rows = spark.createDataFrame([("odd", 3.00049), ("odd", 1.0), ("odd", 9.0), ("even", 1.0), ("even", 2.0011), ("even", 0.0), ("even", 7.0), ("none", None)], "k string, v double")
    assert dict(rows.groupBy("k").agg(ev.median("v")).collect()) == {"odd": 3.00049, "even": 1.501, "none": None}


def test_numeric_order(spark):
    ids = ["q10", "q9", "q-2", "Q1", "q1b", "2", "10", "q" + "9" * 30, "q02"]
    rows = spark.createDataFrame([(x,) for x in ids], "id string")
    assert [r.id for r in rows.orderBy(*rk.numeric_order(F.col("id"))).collect()] == ["2", "10", "q-2", "Q1", "q1b", "q02", "q9", "q10", "q" + "9" * 30]


SIDE = "ids array<string>, title_ids array<string>, genres array<string>, genre_mode string, year_min int, year_max int, rating_min double, count_min int, sort_field string, sort_direction string, blocked boolean"
CASES = f"case_id string, expected struct<{SIDE}, people array<string>, roles map<string,string>, ordered boolean, unresolved_kind string, fast_path boolean, local_mode string>, actual struct<{SIDE}, people array<struct<id string, role string>>, unavailable array<string>, mode string>"


def test_assess_cases(spark):
    side = lambda ids, genres=(), year=None: (ids, [], list(genres), "all", year, None, None, None, None, None, False)
    expected = lambda ids, *a, ordered=False, kind=None: (*side(ids, *a), ["p"], {"p": "actor"}, ordered, kind, False, None)
    actual = lambda ids, *a, role="actor", missing=(): (*side(ids, *a), [("p", role)], list(missing), "model")
    rows = [
        ("good", expected(["a", "b"], ("X", "Y")), actual(["b", "a"], ("Y", "X"))),
        ("order", expected(["a", "b"], ordered=True), actual(["b", "a"])),
        ("part", expected(["a", "b"], (), 1990), actual(["x", "a", "y"], role="director", missing=["mood: sad"])),
        ("kind", expected(["a"], kind="mood"), actual(["a"], missing=["mood: sad"])),
        ("lost", expected(["a"]), actual([])),
        ("empty", expected([]), actual([])),
        ("extra", expected([]), actual(["x"])),
    ]
    got = {r.case_id: r for r in ev.assess_cases(spark.createDataFrame(rows, CASES), live=True).collect()}
    assert {k: r.failed_checks for k, r in got.items()} == {"good": [], "order": ["order"], "part": ["roles", "filters", "unresolved", "results"], "kind": [], "lost": ["results"], "empty": [], "extra": ["results"]}
    assert all(r.passed == (not r.failed_checks) for r in got.values())
    metrics = {k: (r.recall, r.precision, r.mrr, r.ndcg10) for k, r in got.items()}
    assert metrics["good"] == (1.0, 1.0, 1.0, 1.0) and metrics["lost"] == (0.0, 0.0, 0.0, 0.0)
    assert metrics["part"] == pytest.approx((0.5, 1 / 3, 0.5, 0.6309297535714575 / 1.6309297535714575))
    assert metrics["empty"] == (None, None, None, None) and metrics["extra"] == (None, 0.0, None, None)


def test_token_usage(spark):
    trials = spark.createDataFrame([("timeout", False, None), ("timeout", False, (100, 10, 40)), (None, True, None), ("", False, (50, 5, None)), ("bad", None, None)], "fallback_reason string, fast_path boolean, usage struct<input_tokens int, output_tokens int, cached_input_tokens int>")
    assert dict(ev.fallback_reasons(trials).collect()) == {"timeout": 2, "bad": 1}
    assert tuple(ev.token_usage(trials).first()) == (150, 15, 40, 2, None, None)
    errors = trials.where("usage.input_tokens = 100").select("usage")
    # 250 input tokens of which 80 cached, 25 output tokens; 6 attempts
    assert tuple(ev.token_usage(trials, (2.0, 8.0, 1.0), errors).first()) == pytest.approx((150, 15, 40, 2, 620 / 1e6, 620 / 6e6))
    with pytest.raises(ValueError):
        ev.token_usage(trials, (2.0, float("nan"), 1.0))


def test_person_movies(spark):
    people = spark.createDataFrame([("c", "Ann Cee", ["9"]), ("l", "Bob Ell", ["movie:movielens:5", "6"]), ("n", "Cy Enn", [])], "entity_id string, name string, movie_ids array<string>")
    credits = spark.createDataFrame([("c", "actor", "movie:movielens:1"), ("c", "director", "2")], "entity_id string, role string, movie_id string")
    records = spark.createDataFrame([("7", ["Cy Enn", "Bob Ell"], []), ("8", None, ["Cy Enn"]), ("9", ["Ann Cee"], ["Ann Cee"])], "id string, cast array<string>, directors array<string>")
    asked = [(p, r) for p in ("c", "l", "n", "unknown") for r in (None, "actor", "director", "writer")]
    groups = spark.createDataFrame([(f"{p}:{r}", 0, p, r) for p, r in asked], "query_id string, group_no int, entity_id string, role string")
    got = {}
    for r in en.person_movies(groups, people, credits, records).collect():
        got.setdefault(r.query_id, set()).add(r.movie_id)
    assert got == {"c:None": {"1", "2"}, "c:actor": {"1"}, "c:director": {"2"}, "l:None": {"5", "6"}, "l:actor": {"7"}, "l:writer": {"7"}, "n:None": {"7", "8"}, "n:actor": {"7"}, "n:director": {"8"}, "n:writer": {"7", "8"}}


def test_plans_and_corrections_of_every_query(spark, tmp_path):
    """Not only of those whose number is divisible by 20."""
    from reelrank.plans import people

    rows = {"queries": ([("q1", "interstelar"), ("q20", "interstelar"), ("q21", "horror movies"), ("own", "heat")], "_id string, text string"), "movies": ([("1", "Interstellar (2014)", "Drama"), ("2", "Heat (1995)", "Crime")], "movieId string, title string, genres string")}
    rows |= {"documents": ([("1", "Jane Roe plays a pilot.")], "movieId string, text string"), "genre_names": ([("Drama",), ("Crime",)], "genre string")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    ids = lambda query: {r.query_id for r in query(spark, str(tmp_path)).collect()}
    assert ids(people.query_plans) == {"q1", "q20", "q21", "own"}
    assert ids(people.title_corrections) == ids(people.query_corrections) == {"q1", "q20"}


def test_compound_genres_without_drama(spark, tmp_path):
    from reelrank.plans import catalogue as cat

    rows = {"movies": ([("1", "A (2000)", "Comedy|Romance"), ("2", "B (2000)", "Romance|Comedy|Drama"), ("3", "C (2000)", "Comedy")], "movieId string, title string, genres string")}
    rows |= {"ratings": ([("1", "1", 4.0, 1)], "userId string, movieId string, rating double, timestamp long"), "tags": ([("1", "1", "x", 1)], "userId string, movieId string, tag string, timestamp long"), "links": ([("1", "1", "1")], "movieId string, imdbId string, tmdbId string")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.genre, r.other, r.rank_no, r.id) for r in cat.QUERIES["compound_genre_pairs_topk"](spark, str(tmp_path)).collect()}
    assert got == {("Comedy", "Romance", 1, "1"), ("Comedy", "Romance", 2, "2"), ("Comedy", "Drama", 1, "2"), ("Drama", "Romance", 1, "2")}


@pytest.mark.parametrize("n", [1, 4, 5, 3001])
def test_every_fourth_of_the_order(spark, n):
    items = [f"m{i}" for i in range(n)]
    rows = spark.createDataFrame([(x,) for x in [*items, None]], "item string")
    order = sorted(items, key=lambda x: hashlib.sha256(f"s\0{x}".encode()).hexdigest())
    assert {r.item for r in rv.calibration_sample(rows, "item", "s").collect()} == set(order[::4])


def test_names_by_join_as_inline(spark):
    """Beyond the bound on inline names the same names are seen."""
    names = ["Song, Stage", '"Quoted", Name', "Odd (Name), End)", "[A], b", "'Tis, So", "A Very Long Name, Of Many Words", "Plain, One", "x,", "É, É", "\tTab, Name"]
    texts = ['"Quoted", Name|x', "y; Odd (Name), End)", "[A], b, c", "'Tis, So|'Tis", '"Song, Stage" "Plain, One"', "[Song, Stage] | [Plain, One]", "          [ Song, Stage          ]", "  A Very Long Name, Of Many Words            |z", "x,, x", "[x,]", "É, É/É", "Tab, Name", "Plain, One & Song, Stage", '"a"Plain, One', "Song, Stagehand", "A Very Long Name, Of Many Others"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, genres string")
    vocabulary = spark.createDataFrame([(n,) for n in names], "genre string")
    inline, joined = ([tuple(r) for r in explode_packed(df, "genres", ["id"], vocabulary, inline_names=n).orderBy("id", "pos").collect()] for n in (1000, 0))
    assert joined == inline and ("0", 1, '"Quoted", Name') in inline and ("1", 2, "Odd (Name), End)") in inline
