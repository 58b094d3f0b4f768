"""The search with whole plans: corrections, people, clusters."""

import random

import pytest
from pyspark.sql import functions as F

from reelrank.operators import corpus as cp
from reelrank.operators import index as ix
from reelrank.operators import ranking as rk
from reelrank.operators.packed import explode_packed
from reelrank.plans import search as sr

SCHEMA = "id string, title string, source_title string, year int, genres array<string>, tags array<string>, average_rating double, rating_count bigint, cast array<string>, directors array<string>"


@pytest.fixture(scope="module")
def world(spark):
    titles = [("1", "Copper Meadow", 1990, "Drama"), ("2", "Silver Harbor", 1991, "Comedy"), ("3", "Mellow One", 1992, "Drama"), ("4", "Mellow Two", 1993, "Drama"), ("5", "Mellow Three", 1994, "Comedy"), ("6", "Quiet Orchard", 1995, "Drama"), ("7", "Paper Umbrella", 1996, "Comedy")]
    people = {"1": ["Ada Mellow"], "2": ["Ada Mellow", "Bo Lind"], "6": ["Bo Lind"], "7": ["Ada Mellow"]}
    rows = [(i, t, t, y, [g], [], 4.0, 10 + int(i), people.get(i, []), ["Cy Harbor"] if i == "6" else []) for i, t, y, g in titles]
    records = spark.createDataFrame(rows, SCHEMA)
    credits = records.select(F.col("id").alias("movie_id"), F.lit("actor").alias("role"), F.lit(None).cast("string").alias("person_id"), F.explode("cast").alias("name"))
    directed = records.select(F.col("id").alias("movie_id"), F.lit("director").alias("role"), F.lit(None).cast("string").alias("person_id"), F.explode("directors").alias("name"))
    return records, cp.people(credits.unionByName(directed)), spark.createDataFrame([("Drama",), ("Comedy",)], "genre string")


def run(spark, world, texts, **more):
    records, people, genres = world
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")
    out = {}
    for r in sr.search(q, records, 5, people=people, genres=genres, **more).orderBy("query_id", "rank_no").collect():
        out.setdefault(texts[int(r.query_id)], []).append(r)
    return out


def test_planned_search(spark, world):
    got = run(spark, world, ["films called coper meadow", "Silver Harbor", "lind", "mellow", "starring Ada Mellow", "directed by cy harbor", ""])
    assert got["films called coper meadow"][0]["id"] == "1"  # corrected
    assert got["Silver Harbor"][0]["id"] == "2" and got["Silver Harbor"][0].is_exact
    lind = got["lind"]
    assert {r["id"] for r in lind[:2]} == {"2", "6"} and all(r.boost > 0 and r.person_id == "person:name:bo-lind" for r in lind[:2])
    # the first record of a person is lifted most
    assert lind[0].boost > lind[1].boost
    # three titles go on from the word: the title is meant, and they come before the person's films
    assert {r["id"] for r in got["mellow"][:3]} == {"3", "4", "5"}
    assert {r["id"] for r in got["starring Ada Mellow"][:3]} == {"1", "2", "7"}
    assert got["directed by cy harbor"][0]["id"] == "6"
    assert "" not in got


def test_without_autocorrect_the_text_stays(spark, world):
    got = run(spark, world, ["films called coper meadow"], autocorrect=False)
    assert all(not r.is_exact for r in got.get("films called coper meadow", []))
    with pytest.raises(ValueError):
        run(spark, world, ["x"], weights={"dice": -1})
    with pytest.raises(ValueError):
        sr.search(world[0].select(F.col("id").alias("query_id"), F.col("title").alias("text")), world[0], 0)


def test_an_index_answers_alike(spark, world, tmp_path):
    records, people, genres = world
    q = spark.createDataFrame([("1", "mellow"), ("2", "drama movies after 1991"), ("3", "silver harbr"), ("4", "lind")], "query_id string, text string")
    index = ix.build_index(records)
    ix.save_index(index, str(tmp_path / "index"))
    results = [sorted(map(tuple, sr.search(q, r, 5, people=people, genres=genres).collect())) for r in (records, index, ix.load_index(spark, str(tmp_path / "index")))]
    assert results[0] == results[1] == results[2] and len(results[0]) > 8
    with pytest.raises(Exception):
        ix.save_index(index, str(tmp_path / "index"))


def test_people_of_many_records(spark):
    base = spark.createDataFrame([("q", str(k), k, 0.5, 0.2) for k in range(1, 7)], "query_id string, id string, base_rank int, combined_score double, rating_evidence double")
    base = base.withColumns({"prefix_match": F.lit(False), "title_intent": F.lit(False), "person_intent": F.lit(False), "title": F.col("id"), "rating_count": F.lit(1)})
    hints = spark.createDataFrame([("q", "4", "p", 0, 8), ("q", "2", "p", 0, 8), ("q", "5", "r", 1, 2)], "query_id string, id string, person_id string, person_rank int, popularity bigint")
    got = {r["id"]: r for r in rk.boost_people(base, hints).collect()}
    assert got["2"].occurrence == 1 and got["4"].occurrence == 2 and got["1"].occurrence is None
    assert got["2"].boost == pytest.approx(0.06 + 0.002) and got["4"].boost == pytest.approx(0.042426 + 0.002, abs=1e-6) and got["5"].boost == pytest.approx(0.015 + 0.002)
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1].rank_no)] == ["2", "4", "5", "1", "3", "6"]


def test_names_of_any_number_are_seen_alike(spark):
    """Random names and fields: the same values whether names travel with the machine or are joined."""
    rnd = random.Random(5)
    parts = ["a", "b", "Song", "'80s", "'", '"', ", ", "|", " ", "Best of", "(x)", "[", "]", "É", "&", " & ", "-", "\t", ";", "“", "”", "\\"]
    names = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5))).strip() for _ in range(60)} - {""}) + ["'80s, Best of", "Rock 'n' Roll, Live"]
    texts = ["".join(rnd.choice(parts + names) for _ in range(rnd.randrange(1, 7))) for _ in range(1500)] + ["'80s, Best of", "x|'80s, Best of", "'80s, Best of; y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, g string")
    vocabulary = spark.createDataFrame([(n,) for n in names], "genre string")
    inline, joined = ({tuple(r) for r in explode_packed(df, "g", ["id"], vocabulary, inline_names=n).collect()} for n in (1000, 0))
    assert inline == joined and (1500, 1, "'80s, Best of") in inline
