"""Requests in three scripts: interpretations, plans, answers."""

import pytest
from pyspark.sql import functions as F

from reelrank.operators import corpus as cp
from reelrank.operators import multilingual as ml
from reelrank.plans import multilingual as mp

FILMS = [
    ("1", "Dil Se", 1998, ["Drama", "Romance"], 4.0, 30, ["Shah Rukh Khan"], []),
    ("2", "Test Horror", 2011, ["Horror"], 3.5, 20, ["Shah Rukh Khan"], []),
    ("3", "Old Horror", 2010, ["Horror"], 4.5, 40, [], []),
    ("4", "New Horror", 2020, ["Horror"], 5.0, 1, [], []),
    ("5", "Newest Horror", 2025, ["Horror"], 4.0, 50, [], []),
    ("15", "Lagaan", 2001, ["Drama"], 4.3, 100, ["Aamir Khan"], []),
    ("13", "Interstellar", 2014, ["Sci-Fi", "Drama"], 4.5, 200, [], ["Christopher Nolan"]),
]
PEOPLE = [("person:1", "Shah Rukh Khan", ["actor"]), ("person:2", "Aamir Khan", ["actor"]), ("person:3", "Christopher Nolan", ["director"])]


@pytest.fixture(scope="module")
def world(spark):
    r = spark.createDataFrame(FILMS, "id string, title string, year int, genres array<string>, average_rating double, rating_count bigint, cast array<string>, directors array<string>").withColumn("source_title", F.col("title"))
    people = spark.createDataFrame([(i, n, ro, 2, 2 * ("actor" in ro), 2 * ("director" in ro)) for i, n, ro in PEOPLE], "entity_id string, name string, roles array<string>, movie_count bigint, actor_movie_count bigint, director_movie_count bigint")
    alias = "array<struct<text:string,source:string,language:string>>"
    films = spark.createDataFrame([("1", "Dil Se", [("दिल से", "reviewed", "hi")])] + [(f[0], f[1], []) for f in FILMS[1:]], f"entity_id string, name string, aliases {alias}")
    named = spark.createDataFrame([("person:1", "Shah Rukh Khan", [("khan", "reviewed", "en")]), ("person:2", "Aamir Khan", [("khan", "reviewed", "en"), ("आमिर खान", "reviewed", "hi")]), ("person:3", "Christopher Nolan", [])], f"entity_id string, name string, aliases {alias}")
    genres = spark.createDataFrame([("Horror",), ("Drama",), ("Romance",), ("Sci-Fi",)], "genre string")
    credits = spark.createDataFrame([("person:1", "actor", "1"), ("person:1", "actor", "movie:movielens:2"), ("person:2", "actor", "15"), ("person:3", "director", "13")], "entity_id string, role string, movie_id string")
    return cp.rating_evidence(r), ml.alias_catalog(films), ml.alias_catalog(named), people, genres, credits


def run(spark, world, texts, given=None, n=24):
    records, movies, persons, people, genres, credits = world
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")
    plans = mp.plan_requests(q, records, movies, persons, people, genres, interpretations=given)
    found = mp.answer(plans, records, people.select("entity_id", "name", F.array().cast("array<string>").alias("movie_ids")), credits, n)
    p = {texts[int(r.query_id)]: r for r in plans.collect()}
    a = {}
    for r in found.orderBy("query_id", "rank_no").collect():
        a.setdefault(texts[int(r.query_id)], []).append(r["id"])
    return p, a


def test_without_a_model(spark, world):
    texts = ["Dil Se", "दिल से", "डरावनी फिल्में दिखाओ", "horror or drama movies", "khan", "आमिर खान", "कुछ भी नहीं", "horror movies after 2010", "latest horror movies", "directed by christopher nolan", "zzzz qqqq", "", "x" * 301]
    p, a = run(spark, world, texts)
    assert set(p) == set(texts[:-2])
    assert p["Dil Se"]["mode"] == "exact_alias" and p["Dil Se"].intent == "exact_title" and a["Dil Se"] == ["1"] == a["दिल से"]
    assert p["डरावनी फिल्में दिखाओ"]["mode"] == "local_genre" and set(a["डरावनी फिल्में दिखाओ"]) == {"2", "3", "4", "5"}
    assert set(a["horror or drama movies"]) == {"1", "2", "3", "4", "5", "13", "15"}
    assert p["khan"].is_blocked and p["khan"].unresolved == ["Ambiguous person: khan"] and "khan" not in a
    assert a["आमिर खान"] == ["15"]
    assert p["कुछ भी नहीं"].is_blocked and p["कुछ भी नहीं"].unresolved == ["कुछ भी नहीं"]
    assert p["horror movies after 2010"].intent == "filtered_discovery" and set(a["horror movies after 2010"]) == {"2", "4", "5"}
    assert p["latest horror movies"].sort_field == "year" and a["latest horror movies"][0] == "5"
    assert a["directed by christopher nolan"] == ["13"] and p["directed by christopher nolan"].intent == "person_discovery"
    assert p["zzzz qqqq"].unresolved == ["Title not found: zzzz qqqq"] and p["zzzz qqqq"]["mode"] == "fallback:model_disabled"


def given(spark, rows):
    return spark.createDataFrame(rows, "text string, " + mp.INTERPRETATION.split(", ", 1)[1])


def test_given_interpretations(spark, world):
    ok = "शाहरुख की 2000 से पहले की फिल्में"
    bad = "sholay ke baad ki films"
    rows = [
        (ok, None, [("शाहरुख", ["Shah Rukh Khan"], "actor")], [], "any", None, 1999, None, None, "rating", "desc", [], [ok]),
        (bad, None, [], ["Horror"], "any", None, None, None, None, None, None, [], ["sholay ke"]),
    ]
    newest = "सबसे नई horror"
    rows.append((newest, None, [], ["Horror"], "any", None, None, None, None, "year", "desc", [], [newest]))
    best = "best rated horror ever"
    rows.append((best, None, [], ["Horror"], "any", None, None, None, None, "rating", "desc", [], [best]))
    p, a = run(spark, world, [ok, bad, newest, best], given(spark, rows))
    assert a[newest] == ["5", "4", "2", "3"]
    assert a[best] == ["3", "5", "2", "4"]  # an average of one rating counts as none
    assert run(spark, world, [newest], given(spark, rows), n=2)[1][newest] == ["5", "4"]  # sorted before it is cut
    assert p[ok]["mode"] == "model" and a[ok] == ["1"] and p[ok].groups[0].entity_id == "person:1"
    assert p[bad]["mode"] == "fallback:invalid_output" and p[bad].is_blocked


def test_interpretation_rules(spark):
    q = spark.createDataFrame([(k, "horror films by Nolan") for k in "abcdefgh"], "query_id string, text string")
    base = {"title": None, "people": [], "genres": ["Horror"], "genre_mode": "any", "year_min": None, "year_max": None, "rating_min": None, "count_min": None, "sort_field": None, "sort_direction": None, "unresolved": [], "evidence": ["horror films", "by Nolan"]}
    cases = {"a": ({}, None), "b": ({"genres": ["Nope"]}, "unknown_genre"), "c": ({"year_min": 2001, "year_max": 1999}, "year_order"), "d": ({"unresolved": ["absent"]}, "span"), "e": ({"evidence": ["horror films"]}, "coverage"), "f": ({"people": [("Nolan", [], "singer")]}, "shape"), "g": ({"sort_field": "year"}, "shape"), "h": ({"evidence": ["horror fi", "ilms by", " Nolan"]}, None)}
    rows = [(k, *{**base, **change}.values()) for k, (change, _) in cases.items()]
    got = {r.query_id: r.problem for r in mp.interpretation_problems(q, spark.createDataFrame(rows, mp.INTERPRETATION), ["Horror"]).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}


def test_empty(spark, world):
    p, a = run(spark, world, ["", "   "])
    assert p == {} and a == {}
