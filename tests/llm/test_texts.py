"""Collapsing copies, packing, mixing and spam."""

import itertools
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reelrank.llm import collapse, mixing, packing, spam, tokens
from reelrank.llm.forms import form
from reelrank.runtime import cut


def brute_copies(rows):
    out = defaultdict(Counter)
    for m, t in rows:
        if m is not None and t is not None and form(t) is not None:
            out[(m, form(t))][t] += 1
    return out


@pytest.mark.parametrize("bucket_rows", [1, 7, 100_000])
def test_collapse(spark, bucket_rows):
    rnd = random.Random(bucket_rows)
    base = ["rainy city", "Rainy  City!", "CITY rainy", "noir", "Noir.", "ｎｏｉｒ", "", " ", "???", "पुराना शहर", "शहर, पुराना", "a\x00b", "x" * 5000]
    rows = [(rnd.choice(["1", "10", "11", "2", "\x00", "\x01", "a\x01\x00"]), rnd.choice(base)) for _ in range(400)] + [("hot", "same thing")] * 300 + [("hot", f"Same{'!' * k} thing") for k in range(40)] + [(None, "noir"), ("1", None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "m string, t string, pos int, copies string").repartition(5)
    got = collapse.collapse_copies(df, ["m"], "t", bucket_rows, 64).collect()
    expect = brute_copies(rows)
    assert {(r.key_0, r.form, r.spelling): r.copies for r in got} == {(*k, s): n for k, c in expect.items() for s, n in c.items()}
    for r in got:
        c = expect[(r.key_0, r.form)]
        assert (r.n_spellings, r.n_copies) == (len(c), sum(c.values())) and sorted(c)[r.pos] == r.spelling


def test_spelling_pairs(spark, monkeypatch):
    monkeypatch.setattr(collapse, "PAIR_BLOCK", 3)
    rows = [("m", f"Same{'!' * k} thing") for k in range(11)] + [("n", "one"), ("n", "One"), ("o", "alone")]
    copies = cut(collapse.collapse_copies(spark.createDataFrame(rows, "m string, t string"), ["m"], "t"))
    got = {(r.key_0, r.spelling_a, r.spelling_b) for r in collapse.spelling_pairs(copies, ["key_0"]).collect()}
    expect = {(k[0], a, b) for k, c in brute_copies(rows).items() for a, b in itertools.combinations(sorted(c), 2)}
    assert got == expect and len(expect) == 56
    assert collapse.collapse_copies(spark.createDataFrame([], "m string, t string"), ["m"], "t").count() == 0


def test_radix_bounds_split_only_what_is_too_large(spark):
    canon = [b"77\x00" + bytes([97 + k % 5, 97 + k // 5 % 5]) for k in range(100)] + [b"9"] * 50
    df = spark.createDataFrame([(bytearray(c),) for c in canon], "canon binary")
    bounds = collapse.radix_bounds(df, bucket_rows=10, max_buckets=100)
    assert bounds == sorted(bounds)
    sizes = Counter(sum(b <= c for b in bounds) for c in canon)
    assert all(n <= 10 for k, n in sizes.items() if n != 50) and sum(sizes.values()) == 150


def test_radix_bounds_skip_common_bytes(spark, monkeypatch):
    """Levels are as many as bytes differ, not as are long."""
    canon = [b"x" * 79 + bytes([97 + k % 26]) + b"y" * 50 + bytes([97 + k // 26]) for k in range(520)]
    df = cut(spark.createDataFrame([(bytearray(c),) for c in canon], "canon binary"))
    levels, child = [], collapse._child
    monkeypatch.setattr(collapse, "_child", lambda open_: levels.append(len(open_)) or child(open_))
    bounds = collapse.radix_bounds(df, bucket_rows=5, max_buckets=1000)
    assert levels == [1, 26]
    assert max(Counter(sum(b <= c for b in bounds) for c in canon).values()) <= 5
    # of many depths: by bisection, the same bounds
    deep = [bytes([97 + k]) * (k + 3) + bytes([97 + j]) for k in range(14) for j in range(20)]
    many = cut(spark.createDataFrame([(bytearray(c),) for c in deep], "canon binary"))
    bounds = collapse.radix_bounds(many, bucket_rows=4, max_buckets=1000)
    assert max(Counter(sum(b <= c for b in bounds) for c in deep).values()) <= 4
    levels.clear()
    assert collapse.radix_bounds(df.limit(0)) == [] and collapse.radix_bounds(df.where(F.col("canon") == F.lit(canon[0])), 0) == [] and not levels


def test_trie_is_a_counter():
    rnd = random.Random(1)
    trie, expect = collapse.Trie(), defaultdict(Counter)
    for _ in range(5000):
        key = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(9)))
        trie.add(key, str(len(key) % 3), 2)
        expect[key][str(len(key) % 3)] += 2
    found = list(trie.terminals())
    assert [k for k, _ in found] == sorted(expect) and dict(found) == expect


def check_bins(rows, capacities, totals):
    """rows: (item, piece, offset, size, bin_id, capacity, unused)."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for held in bins.values():
        used = sum(r["size"] for r in held)
        assert len({r.capacity for r in held}) == 1 and held[0].capacity == min(c for c in capacities if c >= used) and {r.unused for r in held} == {held[0].capacity - used}
    per = defaultdict(list)
    for r in rows:
        per[r["item"]].append(r)
    assert set(per) == set(totals)
    for item, parts in per.items():
        parts.sort(key=lambda r: r.piece)
        assert sum(r["size"] for r in parts) == totals[item] and len(parts) == -(-totals[item] // max(capacities))
        assert [r.offset for r in parts] == list(itertools.accumulate([0] + [r["size"] for r in parts[:-1]]))
    return bins


@pytest.mark.parametrize("capacities", [[16], [64], [8, 16, 64], [1]])
def test_pack(spark, capacities):
    rnd = random.Random(sum(capacities))
    totals = {k: rnd.choice([1, 3, 5, 16, 17, 40, 64, 200, rnd.randrange(1, 90)]) for k in range(1500)}
    rows = [(k, v, 0) for k, v in totals.items()] + [(9001, None, 0), (9002, 0, 0), (9003, -4, 0)]
    df = spark.createDataFrame(rows, "id bigint, n int, piece int")
    got = packing.pack(df, "id", "n", capacities, part_rows=100).collect()
    bins = check_bins(got, capacities, totals)
    used, room = sum(totals.values()), sum(b[0].capacity for b in bins.values())
    assert used / room > (0.9 if capacities != [1] else 0.99)
    again = packing.pack(df.repartition(7), "id", "n", capacities, part_rows=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_pack_edges(spark):
    empty = spark.createDataFrame([], "id bigint, n int")
    assert packing.pack(empty, "id", "n", [8]).count() == 0
    for bad in ([], [0], [1 << 30]):
        with pytest.raises(ValueError):
            packing.pack(empty, "id", "n", bad)
    hot = spark.range(5000).select("id", F.lit(3).alias("n"))
    bins = check_bins(packing.pack(hot, "id", "n", [8, 9], part_rows=50).collect(), [8, 9], {k: 3 for k in range(5000)})
    assert all(b[0].capacity == 9 for b in bins.values() if len(b) == 3) and len(bins) == -(-5000 // 3)


def test_best_fit_is_joint():
    bins = packing.best_fit({9: 10, 7: 10, 4: 10}, [8, 16, 20])
    assert sum(b.count * b.left for b in bins) == 0


def test_tokens(spark):
    path = tokens.TOKENIZER
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    got = [r[0] for r in df.select(tokens.tokens_udf()("t")).collect()]
    assert got[0] == len(tokens.encoding(path).encode_ordinary("Hello world")) and got[1] == 0 and got[2] is None and got[3] > 1


def brute_sainte_lague(weights, seats, limits):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        live = [k for k in weights if weights[k] > 0 and got[k] < limits.get(k, seats)]
        if not live:
            break
        got[min(live, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))] += 1
    return got


def test_sainte_lague():
    rnd = random.Random(3)
    for _ in range(200):
        weights = {f"s{k}": rnd.choice([0.0, rnd.random(), rnd.randrange(1, 50)]) for k in range(rnd.randrange(1, 8))}
        seats = rnd.randrange(0, 300)
        limits = {k: rnd.randrange(0, 120) for k in weights if rnd.random() < 0.4}
        assert mixing.sainte_lague(weights, seats, limits) == brute_sainte_lague(weights, seats, limits)


def test_sainte_lague_with_many_small_weights():
    weights = {0: 90.0} | {k: 0.6 for k in range(1, 101)}
    assert mixing.sainte_lague(weights, 150) == brute_sainte_lague(weights, 150, {})
    assert mixing.sainte_lague(weights, 150)[0] == 75
    rnd = random.Random(6)
    for _ in range(60):
        weights = {k: rnd.choice([1.0, 0.1, rnd.random(), 1000 * rnd.random()]) for k in range(rnd.randrange(1, 150))}
        seats = rnd.randrange(0, 600)
        limits = {k: rnd.randrange(0, 9) for k in weights if rnd.random() < 0.3}
        assert mixing.sainte_lague(weights, seats, limits) == brute_sainte_lague(weights, seats, limits)
    big = mixing.sainte_lague({"a": 1e13, "b": 3.0, "c": 1e13}, 10**9)
    assert sum(big.values()) == 10**9 and abs(big["a"] - big["c"]) <= 1


def test_split_tokens():
    rnd = random.Random(7)
    for _ in range(100):
        held = {k: rnd.randrange(1, 500) for k in range(rnd.randrange(1, 40))}
        repeats, block = rnd.randrange(1, 4), rnd.randrange(1, 90)
        wanted = rnd.randrange(0, sum(held.values()) * repeats + 1)
        got = mixing.split_tokens(wanted, held, repeats, block)
        assert sum(got.values()) == wanted and all(0 <= got[k] <= held[k] * repeats for k in held)


def test_shards_in_a_tree(spark):
    """Any number of shards: each node of the tree shares out all its tokens."""
    sums = spark.createDataFrame([("a", k, 100 + k % 7) for k in range(50)] + [("b", 0, 10)], "source string, shard bigint, t bigint")
    wanted = spark.createDataFrame([("a", 3333, 2), ("b", 7, 1)], "source string, wanted bigint, max_repeats int")
    for fan, levels in ((64, 1), (8, 2), (3, 4)):
        rows = mixing.shard_quotas(sums, wanted, levels, 5, fan).collect()
        assert len(rows) == 51 and all(0 <= r.wanted <= r.t * r.max_repeats for r in rows)
        assert sum(r.wanted for r in rows if r.source == "a") == 3333 and sum(r.wanted for r in rows if r.source == "b") == 7
        own = [r.wanted for r in rows if r.source == "a"]
        assert max(own) - min(own) <= 30


def test_mix(spark):
    rnd = random.Random(4)
    docs = [(k, rnd.choice(["big"] * 8 + ["small", "mid", None, "none"]), rnd.randrange(1, 60)) for k in range(6000)] + [(9001, "big", 0), (9002, "big", None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "id bigint, s string, n int, shard string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("mid", 0.15, 2), ("missing", 0.05, 3)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.draw_mix(df, "id", "s", "n", targets, shard_tokens=2000)
    rows, by = drawn.collect(), {r.source: r for r in shares.collect()}
    assert len({r["item"] for r in rows}) == len(rows)
    most = {"big": 1, "small": 4, "mid": 2}
    assert all(1 <= r.repeats <= most[r.source] for r in rows)
    total = sum(r.tokens * r.repeats for r in rows)
    for s in most:
        own = sum(r.tokens * r.repeats for r in rows if r.source == s)
        assert by[s].drawn_tokens == own and by[s].reached_share == pytest.approx(own / total)
        assert by[s].reached_share == pytest.approx(by[s].wanted_share, abs=0.01)
    assert by["missing"].drawn_tokens == 0 and by["none"].target_share is None
    assert sorted(map(tuple, mixing.draw_mix(df.repartition(3), "id", "s", "n", targets, shard_tokens=2000)[0].collect())) == sorted(map(tuple, rows))
    tree = mixing.draw_mix(df, "id", "s", "n", targets, shard_tokens=500, fan=4)
    assert all(abs(r.reached_share - r.wanted_share) < 0.01 for r in tree[1].collect() if r.wanted_share and r.available_tokens)
    short, over = mixing.draw_mix(df, "id", "s", "n", targets, total_tokens=10**9)
    assert {r.source: r.drawn_tokens for r in over.collect() if r.source in most} == {s: sum((d[2] or 0) for d in docs if d[1] == s) * m for s, m in most.items()}
    none, report = mixing.draw_mix(df.limit(0), "id", "s", "n", targets)
    assert none.count() == 0 and report.count() == 4


HONEST = "The part of the clockmaker was first written for another actor, and nobody in the room could say why it was changed before the second week. "


@pytest.mark.parametrize(
    "text,expect",
    [
        ("cheap movie download watch movie cheap hd movie " * 12, True),
        ("#film #free #watch #online #hd #film #deal " * 5, True),
        ("Best Noir | Watch Free | Buy Tickets | New Offer | Top Series | Full Download", True),
        ("\n".join(f"buy dvd {k} - http://shop.example/{k}" for k in range(9)), True),
        ("\n".join(f"lantern ({k})" for k in range(20, 40)), True),
        (HONEST * 6, False),
        (HONEST.lower().replace(",", "").replace(".", "") * 5, False),
        (HONEST + "#film #free", False),
        ("Director: Ana Ruiz\nEditor: Bo Lind\nMusic: Cy Dahl\nCamera: Di Moss\nCast: Ed Ames\nCast: Flo Ray", False),
        ("\n".join(f"Fri 1{k}:30  The Orchard {k}  Hall {k}" for k in range(9)), False),
        ("\n".join(["Oh carry me over the river tonight", "and leave me there by the sea"] * 6), False),
        ("", False),
        ("\n \n", False),
        (HONEST + "cheap movie download watch movie cheap hd movie " * 12, True),
        (HONEST * 6 + "cheap movie download watch movie cheap hd movie " * 3, False),
    ],
)
def test_spam(text, expect):
    assert (spam.spam_share(text)[0] > 0.5) is expect


def test_spam_operator(spark):
    df = spark.createDataFrame([(1, HONEST, "a"), (2, "buy cheap dvd " * 50, "b"), (3, None, "c"), (3, None, "c"), (4, "free " * 200_000, "d")], "id bigint, text string, item string")
    got = sorted((r["item"], r.is_spam) for r in spam.stuffed_pages(df, "id", "text").collect())
    assert got == [(1, False), (2, True), (3, False), (3, False), (4, True)]
    assert spam.stuffed_pages(df.limit(0), "id", "text").count() == 0


def test_suffix_automaton_coverage_is_brute_force():
    rnd = random.Random(8)
    for _ in range(200):
        seq = [rnd.choice("abc") for _ in range(rnd.randrange(0, 25))]
        r = rnd.randrange(2, 4)
        n = len(seq)
        expect = [False] * n
        for size in range(1, n + 1):
            at = defaultdict(list)
            for i in range(n - size + 1):
                at[tuple(seq[i : i + size])].append(i)
            for starts in at.values():
                if len(starts) >= r:
                    for i in starts:
                        expect[i : i + size] = [True] * size
        assert spam.covered(seq, r) == expect


def test_long_captions_and_stuffed_timed_lines():
    caption = "the story of a baker who leaves the harbour and of the friend that she had to find " * 4
    page = "\n".join(f"[{caption}{i}](https://a.example/{i})" for i in range(3))
    assert len(caption) > 200 and spam.spam_share(page)[0] == 1.0
    stuffed = "\n".join(f"watch free movies online at {h}:15 free movies online watch" for h in range(10, 20))
    assert spam.spam_share(stuffed)[0] > 0.5
    titles = "Brittle Tavern|Keen Hotel|Silver Barge|Open Dockyard|Candid Mill|Humble Orchard".split("|")
    assert spam.spam_share("\n".join(f"Mon {h}:15  The {t}" for h, t in enumerate(titles, 10)))[0] == 0.0
    began = time.time()
    spam.spam_share("[" * 100_000)
    assert time.time() - began < 20


def test_tag_clouds_count_without_coverage():
    share, cover, _ = spam.spam_share("movie (109) sequel (258) hallway (296) railway (216) lantern (211) quilt (274)")
    assert share == 1.0 and cover == 0.0


GERMAN = "Der alte Uhrmacher kehrt nach vielen Jahren in die Stadt am Fluss zurück, doch niemand erkennt ihn mehr. Seine Tochter führt inzwischen das kleine Kino, und beide reden zunächst nur über das Wetter. Erst als der Strom ausfällt, erzählt er ihr, warum er damals ging. "
FRENCH = "La pianiste quitte le port avant l'aube sans prévenir personne, car elle craint que son frère ne la retienne. Dans le train, un inconnu lui confie une lettre qu'elle ne doit ouvrir qu'à Lyon. Le film prend son temps, mais chaque silence compte et la fin surprend. "
CZECH = "Starý hodinář se po letech vrací do města u řeky, ale nikdo ho nepoznává. Jeho dcera mezitím vede malé kino a oba zpočátku mluví jen o počasí. Teprve když vypadne proud, vypráví jí, proč tehdy odešel a koho tam nechal. "


@pytest.mark.parametrize("text", [GERMAN, FRENCH, CZECH, GERMAN * 3, FRENCH + CZECH + "\n" + FRENCH, GERMAN.lower().replace(",", "").replace(".", "")])
def test_honest_text_of_any_language(text):
    assert spam.spam_share(text)[0] < 0.2


@pytest.mark.parametrize("words", ["kino karten billig kaufen film gratis", "film gratuit regarder streaming acheter billet", "levné lístky film zdarma sledovat online"])
def test_stuffing_of_any_language(words):
    rnd = random.Random(4)
    assert spam.spam_share(" ".join(rnd.choice(words.split()) for _ in range(120)))[0] > 0.9
    timed = "\n".join(" ".join(rnd.choice(words.split()) for _ in range(6)) + " 12:05" for _ in range(40))
    assert spam.spam_share(timed)[0] > 0.8


def test_the_automata_decide(monkeypatch):
    """Nothing is spam where nothing repeats."""
    pages = ["cheap movie download watch movie cheap hd movie " * 12, "#film #free #watch #online #hd #film #deal " * 5, "Best Noir | Watch Free | Buy Tickets | New Offer | Top Series | Full Download", "\n".join(f"lantern ({k})" for k in range(20, 40))]
    assert all(spam.spam_share(p)[0] > 0.5 for p in pages)
    monkeypatch.setattr(spam.SuffixAutomaton, "repeated_suffixes", lambda self, repeats: [0] * len(self.ends))
    assert all(spam.spam_share(p)[0] == 0 for p in pages)


def test_long_pages_take_linear_time():
    for page in ("a-" * 200_000, "a--" * 150_000, "<a " * 100_000, " " * 300_000 + "x", ("x" + " " * 50) * 5000, "a b " * 100_000, "a." * 150_000, "1" * 300_000):
        began = time.time()
        spam.spam_share(page)
        assert time.time() - began < 20
