"""Co-occurrence, term frequencies, top N and percentiles against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reelrank.llm import cooccur, percentile, termfreq, topn
from reelrank.llm.forms import form, words


def test_forms():
    assert form("  The QUICK, brown/the ") == "brown quick the the"
    assert form("ｊａｋｆｅｎ") == "jakfen"
    assert form("...") is None and form("") is None and form(None) is None
    assert form("पुराना शहर!") == "पुराना शहर"
    assert words("Ab-c 12") == ["ab", "c", "12"] and words(None) is None


def brute_pairs(rows, min_count):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    support, pairs = Counter(), Counter()
    for items in baskets.values():
        support.update(items)
        items = sorted(items)
        pairs.update((x, y) for k, x in enumerate(items) for y in items[k + 1 :])
    return {p: (support[p[0]], support[p[1]], c, len(baskets)) for p, c in pairs.items() if c >= min_count}


@pytest.mark.parametrize("large", [1, 3, 64])
@pytest.mark.parametrize("min_count", [1, 3, 5])
def test_cooccurrence(spark, large, min_count):
    rnd = random.Random(large * 10 + min_count)
    rows = [(f"b{rnd.randrange(40)}", f"i{min(rnd.randrange(12), rnd.randrange(12))}") for _ in range(400)]
    rows += [("hot", f"i{k}") for k in range(12)] * 3 + [("hot2", f"i{k}") for k in range(9)] + [(None, "i1"), ("b1", None), ("solo", "i1")]
    df = spark.createDataFrame([(b, i, 1, "x") for b, i in rows], "bk string, it string, count int, support string")
    got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n) for r in cooccur.cooccurrence(df, "bk", "it", min_count, large).collect()}
    assert got == brute_pairs(rows, min_count)


@pytest.mark.parametrize("block", [2, 5])
def test_cooccurrence_in_blocks(spark, block):
    """Large baskets beyond the largest ones, in blocks: the same counts."""
    rnd = random.Random(block)
    rows = [(f"b{rnd.randrange(9)}", f"i{rnd.randrange(40)}") for _ in range(300)] + [(f"s{k}", f"i{k % 5}") for k in range(20)]
    df = spark.createDataFrame(rows, "b string, i string")
    got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n) for r in cooccur.cooccurrence(df, "b", "i", 2, 1, block).collect()}
    assert got == brute_pairs(rows, 2)
    some = {(r.item_a, r.item_b) for r in cooccur.cooccurrence(df, "b", "i", 2, 1, block, min_ratio=1.0).collect()}
    every = {(r.item_a, r.item_b) for r in cooccur.cooccurrence(df, "b", "i", 2, 1).collect() if r.llr >= 1.0}
    assert some == every and 0 < len(some) < len(got)


def test_cooccurrence_scores_and_empty(spark):
    rows = [(f"b{k}", x) for k in range(6) for x in ("p", "q")] + [(f"c{k}", "z") for k in range(18)]
    r = cooccur.cooccurrence(spark.createDataFrame(rows, "b string, i string"), "b", "i").collect()[0]
    assert r.lift == pytest.approx(4.0)
    n = 24
    expect = 2 * (6 * math.log(6 / (36 / n)) + 18 * math.log(18 / (18 * 18 / n)))
    assert r.llr == pytest.approx(expect)
    assert cooccur.cooccurrence(spark.createDataFrame([], "b string, i string"), "b", "i").count() == 0
    with pytest.raises(ValueError):
        cooccur.cooccurrence(spark.createDataFrame([], "b string, i string"), "b", "i", 0)


def test_stripes_flush(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "FLUSH_PAIRS", 20)
    import pandas as pd

    batches = [pd.DataFrame({"items": [[f"x{j}" for j in range(k % 9)] for k in range(30)], "right": [None] * 30}) for _ in range(2)]
    got = Counter()
    for out in cooccur._stripes(iter(batches)):
        for a, near, counts in zip(out["item_a"], out["near"], out["counts"]):
            for b, c in zip(near, counts):
                got[(a, b)] += c
    expect = Counter()
    for batch in batches:
        for items in batch["items"]:
            items = sorted(items)
            expect.update((x, y) for k, x in enumerate(items) for y in items[k + 1 :])
    assert got == expect


def test_term_frequencies(spark):
    rows = [("r1", "a"), ("r1", "a"), ("r2", "a"), ("r3", "b"), (None, "a"), ("r1", None)] + [(f"s{k}", "all") for k in range(30)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "rec string, t string, term int")
    got = {r.term: (r.n_occurrences, r.n_records, r.mark) for r in termfreq.term_frequencies(df, "rec", "t", None, 33).collect()}
    assert got == {"a": (3, 2, "rare"), "b": (1, 1, "rare"), "all": (30, 30, "common")}
    assert termfreq.term_frequencies(df.limit(0), "rec", "t", None, 0).count() == 0


def brute_top(rows, n):
    best = defaultdict(dict)
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and math.isfinite(s):
            s = s + 0.0
            best[g][i] = max(best[g].get(i, -math.inf), s)
    return {(g, k): (i, s) for g, d in best.items() for k, (i, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


@pytest.mark.parametrize("sent", [0, 3, topn.BROADCAST_ROWS])
@pytest.mark.parametrize("n", [1, 10])
def test_top_n(spark, n, sent):
    rnd = random.Random(n)
    rows = [("hot", f"d{rnd.randrange(3000)}", rnd.choice([0.5, 0.25, rnd.random(), -rnd.random(), 0.0, -0.0, 1e300, 1e-300])) for _ in range(5000)]
    rows += [("same", f"d{k}", 0.5) for k in range(2000)]
    rows += [(f"g{rnd.randrange(30)}", f"d{rnd.randrange(20)}", rnd.choice([None, math.nan, math.inf, -math.inf, rnd.gauss(0, 3)])) for _ in range(900)] + [(None, "d", 1.0), ("g1", None, 1.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "q string, d string, s double, bucket string, floor int")
    got = {(r.grp, r.rank_no): (r["item"], r.score) for r in topn.top_n(df, "q", "d", "s", n, sent).collect()}
    assert got == brute_top(rows, n)
    assert topn.top_n(df.limit(0), "q", "d", "s", n).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "q", "d", "s", 0)


def test_every_larger_group_has_a_floor(spark):
    rows = [("big", f"d{k}", float(k)) for k in range(100)] + [("small", f"d{k}", float(k)) for k in range(11)] + [("few", f"d{k}", float(k)) for k in range(10)]
    scored = topn.best_scores(spark.createDataFrame(rows, "q string, d string, s double"), "q", "d", "s").withColumn("bucket", topn.score_bucket(F.col("score")))
    floors = {r.grp: r.floor for r in topn.score_floors(scored, 10).collect()}
    assert set(floors) == {"big", "small"}
    kept = scored.where("grp = 'big'").where(F.col("bucket") >= floors["big"]).count()
    assert 10 <= kept <= 12


def test_score_bucket_never_falls(spark):
    rnd = random.Random(5)
    xs = sorted([rnd.gauss(0, 10) for _ in range(500)] + [2.0**k for k in range(-70, 70)] + [-(2.0**k) for k in range(-70, 70)] + [0.0] + [math.nextafter(2.0**k, 0) for k in range(-20, 20)] + [1.7e308, -1.7e308])
    got = [r.b for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", topn.score_bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert got == sorted(got)


def test_percentiles_within_accuracy_and_mergeable(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(5), rnd.choice([1, -1]) * math.exp(rnd.gauss(2, 3))) for _ in range(6000)] + [("a", 1, 0.0)] * 50 + [("a", 1, None), ("a", 2, math.nan), ("b", 1, math.inf), (None, 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, day int, v double")
    sk = percentile.sketch(df, ["k", "day"], "v")
    for keys, got in ((["k", "day"], percentile.percentiles(sk, ["k", "day"])), (["k"], percentile.percentiles(percentile.merge(sk, ["k"]), ["k"])), ([], percentile.percentiles(percentile.merge(sk, []), []))):
        values = defaultdict(list)
        for k, day, v in rows:
            if v is not None and math.isfinite(v):
                values[tuple({"k": k, "day": day}[x] for x in keys)].append(v)
        found = {tuple(r[x] for x in keys): r for r in got.collect()}
        assert set(found) == set(values)
        for key, vs in values.items():
            vs.sort()
            assert found[key].n_values == len(vs)
            for p, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")):
                exact = vs[math.ceil(p * len(vs)) - 1]
                assert abs(found[key][name] - exact) <= 0.01000001 * abs(exact) + 1e-9
    direct = percentile.sketch(df, ["k"], "v")
    assert sorted(map(tuple, direct.collect()), key=str) == sorted(map(tuple, percentile.merge(sk, ["k"]).select("k", "bucket", "n").collect()), key=str)
    assert percentile.percentiles(percentile.sketch(df.limit(0), ["k"], "v"), ["k"]).count() == 0


def test_percentiles_of_tiny_and_huge_values(spark):
    values = [0.0, 5e-320, 3e-300, 7e-120, 2e-15, 4.4e-10, 1.0, 9e200, 1.7e308]
    rows = [(str(i), s * v) for i, v in enumerate(values) for s in (1, -1)]
    df = spark.createDataFrame([(f"{k}{v >= 0}", v) for k, v in rows], "k string, v double")
    got = percentile.percentiles(percentile.sketch(df, ["k"], "v"), ["k"]).collect()
    for r in got:
        exact = values[int(r.k[0])] * (1 if r.k.endswith("True") else -1)
        assert abs(r.p50 - exact) <= 0.01000001 * abs(exact) + 5e-324, (r.k, r.p50, exact)
    order = df.select("v", percentile.bucket_of(F.col("v")).alias("b")).collect()
    assert [r.v for r in sorted(order, key=lambda r: (r.b, r.v))] == sorted(r.v for r in order)
