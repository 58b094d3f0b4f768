"""Packed fields and orphan references against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from reelrank.operators import orphans
from reelrank.operators.packed import Dialect, explode_packed, tokenize

NAMES = ["Drama", "Cloak & Dagger", "Sword/Sorcery", "Song, Stage", 'Double "B" Feature', "Women's Picture", "Sci-Fi"]
DIALECT = Dialect(names=frozenset(NAMES), placeholders=frozenset(["(no genres listed)"]))


@pytest.mark.parametrize(
    "text,expect",
    [
        (None, []),
        ("", []),
        (" \t ", []),
        ("(No Genres Listed)", []),
        ('" (no genres listed) "', []),
        ("A|B", ["A", "B"]),
        ("|A||B| ", ["A", "B"]),
        ("A|A", ["A", "A"]),
        ("Cloak & Dagger & Drama", ["Cloak & Dagger", "Drama"]),
        ("X & Cloak & Dagger", ["X", "Cloak & Dagger"]),
        ("Song, Stage,Drama", ["Song, Stage", "Drama"]),
        ("Sword/Sorcery/Drama", ["Sword/Sorcery", "Drama"]),
        ('"Song, Stage" "Drama"', ["Song, Stage", "Drama"]),
        ('"x, y","z"', ["x, y", "z"]),
        ('"a ""b"" c"|d', ['a "b" c', "d"]),
        ('["a \\"b\\"", "c"]', ['a "b"', "c"]),
        ("['Women's Picture', 'Drama']", ["Women's Picture", "Drama"]),
        ('Double "B" Feature|Drama', ['Double "B" Feature', "Drama"]),
        ("{Drama,\"Song, Stage\"}", ["Drama", "Song, Stage"]),
        ("[[a, b], c]", ["a", "b", "c"]),
        ("live (one, two)|b", ["live (one, two)", "b"]),
        ("a\\, b, c", ["a, b", "c"]),
        ('"open, b', ['"open', "b"]),
        ("[open, b", ["[open", "b"]),
        ("Sci-Fi - Drama", ["Sci-Fi", "Drama"]),
        ("a • b · c｜d、e\tf\ng", list("abcdefg")),
        ("R&B", ["R&B"]),
        ("''|\"\"|x", ["x"]),
    ],
)
def test_tokenize(text, expect):
    assert tokenize(text, DIALECT) == expect


def test_tokenize_round_trip_and_long_fields():
    rnd = random.Random(6)
    for _ in range(500):
        values = ["".join(rnd.choice('ab,|;"/&\\ x') for _ in range(rnd.randrange(1, 8))).strip() for _ in range(rnd.randrange(1, 6))]
        values = [v for v in values if v.strip(' \\"')]
        packed = "|".join('"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in values)
        assert tokenize(packed) == values
    assert len(tokenize('"a' * 100_000)) == 1
    assert len(tokenize("[" * 50_000 + "a")) == 1
    assert len(tokenize("a|" * 200_000)) == 200_000


def test_explode_packed(spark):
    rows = [("1", "Song, Stage|x"), ("1", "Song, Stage|x"), ("2", None), (None, "y & Cloak & Dagger"), ("3", "(no genres listed)"), ("4", "z")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "`my.id` string, genres string, n int")
    vocabulary = spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "genre string")
    expect = sorted([("1", 1, "Song, Stage"), ("1", 2, "x")] * 2 + [(None, 1, "y"), (None, 2, "Cloak & Dagger"), ("4", 1, "z")], key=str)
    for inline in (1000, 0):  # names with the machine, and by a join
        got = explode_packed(df, "genres", ["my.id"], vocabulary, ["(no genres listed)"], inline_names=inline)
        assert got.columns == ["my.id", "pos", "value"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == expect
    assert explode_packed(df.limit(0), "genres", ["my.id"], vocabulary).count() == 0


def brute_orphans(refs, parents, log):
    changes = defaultdict(dict)
    for e, k, op, s in log:
        if e and k and k.strip() and op in ("add", "remove") and s is not None:
            c = changes[(e, k.strip())]
            c[s] = max(op, c.get(s, ""))
    out = set()
    for tbl, fld, e, k, s in refs:
        if k is None or not k.strip():
            continue
        k = k.strip()
        month = None if s is None else datetime.fromtimestamp(s, timezone.utc).strftime("%Y-%m")
        c = changes.get((e, k))
        if c is None:
            if (e, k) not in parents:
                out.add((tbl, fld, k, month, "never"))
        elif s is not None:
            before = [t for t in c if t <= s]
            if not before:
                out.add((tbl, fld, k, month, "early"))
            elif c[max(before)] == "remove":
                out.add((tbl, fld, k, month, "removed"))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_orphans(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(orphans, "BUCKET_BITS", 2)
    keys = [str(k) for k in range(1, 40)] + ["007", "0", "00", "q00000012", "q00000013", "q12", "none", "x-3", "9" * 25, "9" * 24 + "8", "1.5", "é7"]
    parents = {("m", k) for k in keys if rnd.random() < 0.5} | {("q", k) for k in keys if rnd.random() < 0.3}
    base = 1_500_000_000
    log = [(rnd.choice("mq"), rnd.choice(keys[:15] + keys[-6:]), rnd.choice(["add", "remove"]), base + rnd.choice([rnd.randrange(10**7), rnd.randrange(5), 86400 * rnd.randrange(4)])) for _ in range(90)]
    log += [(None, "1", "add", base), ("m", None, "add", base), ("m", " ", "add", base), ("m", "3", "other", base), ("m", "4", "add", None)]
    pad = lambda k: rnd.choice([k, k, k + " ", "\t" + k, k + " "])
    refs = [(pad(rnd.choice(keys)), rnd.choice([base + rnd.randrange(-(10**6), 2 * 10**7), rnd.choice(log)[3] or base, (rnd.choice(log)[3] or base) - 1, base + rnd.randrange(400_000)])) for _ in range(1500)]
    refs += [(rnd.choice(["1", "2"]), base + rnd.randrange(3 * 86400)) for _ in range(800)] + [(None, base), ("  ", base), ("gone", None), ("1", None), ("5", -5), ("5", -86400 * 400)]
    df = spark.createDataFrame([(*r, "x", 1) for r in refs], "`my.key` string, at bigint, key string, n int")
    log_df = spark.createDataFrame(log, "entity string, key string, op string, seconds bigint")
    parent_df = spark.createDataFrame([(e, k, 1) for e, k in parents] * 2, "entity string, key string, n int")
    references = [orphans.Reference("t", "a", df, "my.key", "m", F.col("at")), orphans.Reference("t", "b", df, "my.key", "q", F.col("at"))]
    got = [tuple(r) for r in orphans.find_orphans(references, parent_df, log_df).collect()]
    expect = brute_orphans([("t", f, e, k, s) for f, e in (("a", "m"), ("b", "q")) for k, s in refs], parents, log)
    assert len(got) == len(set(got)) and set(got) == expect
    if seed == 0:
        assert orphans.find_orphans([orphans.Reference("t", "a", df.limit(0), "my.key", "m", F.col("at"))], parent_df.limit(0), log_df.limit(0)).count() == 0
        alone = orphans.find_orphans(references, parent_df.limit(0), log_df.limit(0))
        assert {r.reason for r in alone.collect()} == {"never"}


def test_runs_compress(spark):
    keys = spark.range(1, 2000).select(F.lit("m").alias("entity"), F.lit("0:").alias("shape"), F.col("id").alias("n"), F.when(F.col("id") == 700, "logged").otherwise("static").alias("kind"))
    got = orphans.runs(keys).collect()
    assert len(got) == 6 and sum(r.hi - r.lo + 1 for r in got) == 1999
