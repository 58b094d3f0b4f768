"""Text functions, indexes, ranking and search against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.operators import corpus as cp
from reelrank.operators import index as ix
from reelrank.operators import ranking as rk
from reelrank.plans import metadata as md
from reelrank.plans import search as sr

TITLES = ["Mad Max: Fury Road", "Road to Fury", "Glory Road", "Toy Story", "Goodfellas", "Crime Busters", "Interstellar", "Meadow, The", "An Odd_Kite – Again", "Amélie", "", "Fury", "The Fury Road Road Fury", "Harbor", "Harbor Lights", "Harbor Nights", "A Harbor Song"]
STOP = set(tx.QUERY_STOP_WORDS)


def key(s):
    return re.sub(r"[\s﻿]+", " ", re.sub("[_–—]", " ", s.lower())).strip()


def toks(s):
    return re.findall("[a-z0-9]+", key(s))


def grams(s):
    body = re.sub("[^a-z0-9]+", " ", key(s)).strip()
    p = f"^{body}$"
    return list(dict.fromkeys(p[i : i + 3] for i in range(len(p) - 2))) if body else []


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def fixed(x, d):
    return math.floor(x * 10.0**d + 0.5) / 10.0**d


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).collect()[0][0]


def test_text_functions(spark):
    for t in [*TITLES, "  Two   spaces_x ", "ÉTÉ", "a-b c"]:
        assert one(spark, t, tx.exact_key) == key(t)
        assert one(spark, t, tx.ordered_tokens) == toks(t)
        assert one(spark, t, tx.trigrams) == grams(t)
    assert one(spark, None, tx.exact_key) == "" and one(spark, None, tx.trigrams) == []
    assert one(spark, "Meadow, The", tx.display_title) == "The Meadow" and one(spark, "x, the y", tx.display_title) == "x, the y"
    assert one(spark, "Meadow, The", tx.title_keys) == ["meadow, the", "the meadow", "meadow"]
    assert one(spark, "movies about the mad max", tx.query_tokens) == ["about", "mad", "max"]
    assert len(one(spark, "Interstellar", tx.trigrams)) == 12
    assert one(spark, "lord of the rings", tx.title_case) == "Lord of the Rings"
    assert one(spark, "शहर", tx.script_of) == "devanagari" and one(spark, "a शहर", tx.script_of) == "mixed" and one(spark, "12", tx.script_of) == "other"
    assert one(spark, "  २०१०  ", tx.unicode_text) == "2010"
    assert len(one(spark, "क़िला", lambda c: tx.graphemes(tx.nfc_udf(c)))) == 2
    assert one(spark, "Björk  Ångström", tx.person_key_udf) == "bjork angstrom"
    assert one(spark, "Ünïted!!", tx.slug) == "n-ted" and one(spark, "!!", tx.slug) == "unknown"
    pairs = [("abcd", "abdc", 1), ("abcd", "acbd", 1), ("abcd", "badc", 2 + 1), ("a", "b", 1), ("abc", "ab", 1), ("", "", 0), ("ab", "ab", 0), ("abcd", "cbad", 2)]
    for a, b, d in pairs:
        got = spark.createDataFrame([(a, b)], "a string, b string").select(tx.correction_distance(F.col("a"), F.col("b"))).collect()[0][0]
        assert got == (d if d != 3 else lev(a, b)), (a, b)
    df = spark.createDataFrame([("the faruy road", "faruy", "fury"), ("faruyx road", "faruy", "fury"), ("a+b c", "a+b", "z")], "t string, a string, b string")
    assert [r[0] for r in df.select(tx.replace_term(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["the fury road", "faruyx road", "z c"]
    assert [r[0] for r in df.select(tx.contains_term(F.col("t"), F.col("a"))).collect()] == [True, False, True]


def brute_align(q, t):
    """All increasing matches: longest, narrowest span, earliest query start, earliest title start."""
    best = (0, 0, 0, 0)
    out = (0, -1, -1)

    def go(i, j, path):
        nonlocal best, out
        if path:
            r = (len(path), -(path[-1][1] - path[0][1] + 1), -path[0][0], -path[0][1])
            if out[0] == 0 or r > best:
                best, out = r, (len(path), path[0][1], path[-1][1])
        for a in range(i, len(q)):
            for b in range(j, len(t)):
                if q[a] == t[b]:
                    go(a + 1, b + 1, path + [(a, b)])

    go(0, 0, [])
    return out


def test_alignment_length_and_span():
    rnd = random.Random(1)
    for _ in range(300):
        q = rnd.sample("abcde", rnd.randrange(0, 5))
        t = [rnd.choice("abcdex") for _ in range(rnd.randrange(0, 8))]
        got, expect = tx.align(q, t), brute_align(q, t)
        assert got[0] == expect[0]
    assert tx.align(["fury", "road"], toks("Road to Fury"))[0] == 1
    assert tx.align(["mad", "road"], toks("Mad Max Fury Road")) == (2, 0, 3)


def brute_signals(query, title):
    q = [t for t in dict.fromkeys(toks(query)) if t not in STOP]
    t = toks(title)
    n, first, last = tx.align(q, t)
    span = last - first + 1 if n else 0
    qg, tg = grams(query), grams(title)
    both = len(set(qg) & set(tg))
    qe, te = (re.sub("[^a-z0-9]+", " ", key(x)).strip() for x in (query, title))
    m = max(len(qe), len(te))
    return {
        "token_coverage": fixed(sum(x in t for x in q) / len(q), 4) if q else 0.0, "ordered_coverage": fixed(n / len(q), 4) if q else 0.0, "proximity": fixed(n / span, 4) if span else 0.0,
        "phrase_match": float(bool(q) and n == len(q) == span), "dice": fixed(2 * both / (len(qg) + len(tg)), 4) if qg or tg else 0.0, "edit_similarity": fixed(1 - lev(qe, te) / m, 4) if m else 1.0,
    }


def test_title_signals_and_score(spark):
    queries = ["mad max fury road", "fury road", "mda mx fuy raod", "the", "", "harbor", "road fury", "intersteler", "odd kite again", "toy story"]
    rows = [(i, q, t) for i, (q, t) in enumerate((q, t) for q in queries for t in TITLES)]
    df = spark.createDataFrame(rows, "i int, q string, t string")
    pairs = df.select("i", "q", "t", *rk.query_features(F.col("q")), *rk.record_features(F.col("t")))
    weights = rk.effective_weights(None, rk.TITLE_WEIGHTS)
    got = rk.title_signals(pairs).withColumn("score", rk.combined_score(weights)).collect()
    assert len(got) == len(rows)
    for r in got:
        expect = brute_signals(r.q, r.t)
        assert {k: r[k] for k in expect} == pytest.approx(expect, abs=1.01e-4), (r.q, r.t)
        assert r.score == pytest.approx(sum(r[k] * w for k, w in weights.items()), abs=5e-6) and 0 <= r.score <= 1


def test_weights():
    assert rk.effective_weights({"dice": 0}, rk.TITLE_WEIGHTS)["token_coverage"] == round(25 / 85, 6)
    for bad in ({"dice": -1}, {"dice": 101}, {"dice": math.nan}, {"dice": "1"}, dict.fromkeys(rk.TITLE_WEIGHTS, 0)):
        with pytest.raises(ValueError):
            rk.effective_weights(bad, rk.TITLE_WEIGHTS)


def records(spark):
    rows = [(str(i), t, t, 1990 + i, ["Comedy"] if i % 2 else ["Drama", "Horror"], [f"tag {i}"], 3.0 + i / 10, i) for i, t in enumerate(TITLES)]
    return spark.createDataFrame(rows, "id string, title string, source_title string, year int, genres array<string>, tags array<string>, average_rating double, rating_count bigint")


def test_lookups(spark):
    r = records(spark)
    q = spark.createDataFrame([("a", "Fury Road"), ("b", "intersteler"), ("c", "the meadow"), ("d", ""), ("e", "meadow")], "query_id string, text string")
    exact = {(x.query_id, x.id) for x in ix.exact_matches(q, r).collect()}
    assert exact == {("c", "7"), ("e", "7")}
    tok = {(x.query_id, x.id): x.n_matched for x in ix.token_lookup(q, r).collect()}
    assert tok[("a", "0")] == 2 and tok[("a", "2")] == 1 and ("b", "6") not in tok
    tri = ix.trigram_lookup(q, r).collect()
    best = max((x for x in tri if x.query_id == "b"), key=lambda x: x.n_matched)
    assert best.id == "6"
    for x in tri:
        qg, tg = grams(dict(q.collect())[x.query_id]), grams(TITLES[int(x.id)])
        assert x.n_matched == len(set(qg) & set(tg)) >= max(2, math.ceil(0.12 * len(qg)))
    assert ix.trigram_lookup(q.limit(0), r).count() == 0 and ix.token_lookup(q, r.limit(0)).count() == 0


def test_field_lookup(spark):
    rows = [("1", ["Tom Cruise", "Ann Lee"], ["Jo March"], ["Comedy"], ["spy"], "A spy comes home to the cold city"), ("2", ["Tom Hanks"], ["Tom Cruise"], ["War"], [], "Nothing"), ("3", [], [], [], [], "")]
    r = spark.createDataFrame(rows, "id string, cast array<string>, directors array<string>, genres array<string>, tags array<string>, overview string")
    q = spark.createDataFrame([("a", "tom cruise"), ("b", "tom"), ("c", "spy comedy"), ("d", "movies with tom cruise"), ("e", "spy city home")], "query_id string, text string")
    got = {(x.query_id, x.id): (x.field, x.score, x.exact_entity) for x in ix.best_field(ix.field_lookup(q, r)).collect()}
    assert got[("a", "1")] == ("cast", 1.0, True) and got[("a", "2")] == ("directors", 0.95, True)
    assert got[("b", "1")] == ("cast", 0.9, False) and got[("d", "1")] == ("cast", 1.0, True)
    assert got[("c", "1")][0] == "genres" and got[("c", "1")][1] == pytest.approx(0.375)
    assert got[("e", "1")][0] == "tags" or got[("e", "1")][0] == "overview"
    only = ix.field_lookup(q, r, ["directors"]).select("field").distinct().collect()
    assert [x.field for x in only] == ["directors"]


@pytest.mark.parametrize(
    "text,genres,mode,lo,hi,rating,count,residual",
    [
        ("comedy", ["Comedy"], "any", None, None, None, None, []),
        ("romantic comedy", ["Comedy", "Romance"], "all", None, None, None, None, []),
        ("science fiction thriller", ["Sci-Fi", "Thriller"], "any", None, None, None, None, []),
        ("crime and drama movies from the 1990s", ["Crime", "Drama"], "all", 1990, 1999, None, None, []),
        ("horror from 1995 to 2005", ["Horror"], "any", 1995, 2005, None, None, []),
        ("war films after 1980 before 1990", ["War"], "any", 1981, 1989, None, None, []),
        ("since 1980", [], "any", 1980, None, None, None, []),
        ("from 1999", [], "any", 1999, 1999, None, None, []),
        ("western rated above 3.5 with at least 50 ratings", ["Western"], "any", None, None, 3.5, 50, []),
        ("movies called horror express", [], "any", None, None, None, None, ["called", "express"]),
        ("warm harbor", [], "any", None, None, None, None, ["warm", "harbor"]),
        ("rated 4 or higher", [], "any", None, None, None, None, ["higher"]),
    ],
)
def test_metadata(spark, text, genres, mode, lo, hi, rating, count, residual):
    r = md.parse(spark.createDataFrame([(text,)], "text string")).collect()[0]
    assert (sorted(r.genres), r.genre_mode, r.year_min, r.year_max, r.rating_min, r.count_min) == (sorted(genres), mode, lo, hi, rating, count)
    assert r.residual == residual


def test_sort_and_unsupported(spark):
    df = spark.createDataFrame([("latest horror",), ("new movie",), ("new york",), ("drama 7+ imdb",)], "t string")
    assert [r[0] for r in df.select(md.sort_source(F.col("t"))).collect()] == ["latest", "new", None, None]
    assert [r[0] for r in df.select(md.unsupported(F.col("t"))).collect()][3] == "IMDb rating >= 7"


def test_filters(spark):
    r = records(spark)
    q = spark.createDataFrame([("a", ["Comedy"], "any", None, None, None, None), ("b", ["Drama", "Horror"], "all", 1994, 1998, None, None), ("c", [], "any", None, 1992, None, None), ("d", [], "any", None, None, 4.0, 12), ("e", [], "any", None, None, None, None)], "query_id string, genres array<string>, genre_mode string, year_min int, year_max int, rating_min double, count_min bigint")
    got = {}
    for x in ix.filtered(q, r, blocks=3).collect():
        got.setdefault(x.query_id, set()).add(int(x.id))
    n = range(len(TITLES))
    assert got == {"a": {i for i in n if i % 2}, "b": {4, 6, 8}, "c": {0, 1, 2}, "d": {i for i in n if 3.0 + i / 10 >= 4.0 and i >= 12}}


def test_search_end_to_end(spark):
    r = records(spark)
    q = spark.createDataFrame([("exact", "Toy Story"), ("typo", "intersteler"), ("genre", "comedy movies"), ("year", "latest horror movies"), ("none", "zzzzqq"), ("words", "fury road")], "query_id string, text string")
    got = {}
    for x in sr.search(q, r, limit=5).orderBy("query_id", "rank_no").collect():
        got.setdefault(x.query_id, []).append(x)
    assert got["exact"][0].id == "3" and got["exact"][0].combined_score == 1.0 and got["exact"][0].is_exact
    assert got["typo"][0].id == "6" and "none" not in got
    assert all(int(x.id) % 2 for x in got["genre"]) and [x.rank_no for x in got["genre"]] == [1, 2, 3, 4, 5]
    assert [x.year for x in got["year"]] == sorted((x.year for x in got["year"]), reverse=True)
    assert {x.id for x in got["words"][:2]} == {"0", "12"}
    run = sr.to_run(sr.search(q, r, limit=3)).collect()
    assert all(len(x.results) <= 3 for x in run)
    assert sr.search(q.limit(0), r).count() == 0


def test_bayes_and_discovery_scores(spark):
    rows = spark.createDataFrame([("1", 4.0, 4), ("2", 2.0, 4), ("3", 3.0, 5), ("4", None, 0)], "id string, average_rating double, rating_count bigint")
    got = {r.id: r for r in cp.rating_evidence(rows).collect()}
    assert [got[k].eligible for k in "1234"] == [False, False, True, False]
    assert got["3"].bayesian_rating == 3.0 and got["1"].bayesian_rating == 0.0
    assert got["3"].rating_evidence == 1.0 and got["4"].rating_evidence == 0.0


def test_person_boost(spark):
    ranked = spark.createDataFrame([("q", "1", 1, 0.9, 0.5), ("q", "2", 2, 0.895, 0.5), ("q", "3", 3, 0.5, 0.0), ("q", "4", 4, 0.4, 0.0)], "query_id string, id string, base_rank int, combined_score double, rating_evidence double").withColumns({"prefix_match": F.lit(False), "title_intent": F.lit(False), "person_intent": F.lit(False)})
    credits = spark.createDataFrame([("q", "2", "p", 0, 20), ("q", "3", "p", 0, 20), ("q", "3", "r", 1, 10)], "query_id string, id string, person_id string, person_rank int, popularity int")
    got = {r.id: r for r in rk.boost_people(ranked, credits).collect()}
    assert got["2"].rank_no == 1 and got["2"].boost == pytest.approx(0.065) and got["3"].occurrence == 2
    assert got["3"].boost == pytest.approx(round(0.06 / math.sqrt(2), 6)) and got["1"].boost == 0
