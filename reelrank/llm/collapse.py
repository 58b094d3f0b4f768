"""Duplicates hidden by formatting differences (problem 7), by recursive radix
partitioning.

Records get canonical bytes: their key columns as they are and the text's form (case,
white space, punctuation and word order gone). Equal (record, spelling) rows are first
combined inside each map task, so a record that makes up a third of all rows is a handful
of rows afterwards. Then buckets of canonical bytes are split by the next byte in which their
records differ, for as long as one holds more than its share; neighbouring small ones are joined;
and each bucket counts its records in tries of its own, whose terminals hold the copies of each
spelling. A task gets its bucket in the order of its bytes and begins a new trie whenever one is
full, so a bucket of any size fits."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelrank.llm.forms import form
from reelrank.runtime import cut, ship

#: Combined rows that a trie is meant to hold, and so a bucket as long as there are no more
#: than MAX_BUCKETS: their bounds are held by the driver and every task. Beyond that a bucket goes
#: through several tries, one after the other.
BUCKET_ROWS = 60_000
MAX_BUCKETS = 65_536
#: Distinct rows that a map task combines before it passes them on.
COMBINE_ROWS = 200_000
#: Records in a leaf of the trie before it is split by their next byte.
LEAF = 64
#: Spellings joined with the later ones of their record, in blocks of so many.
PAIR_BLOCK = 256


def canonical_bytes(keys: list[str], text_form: str) -> bytes:
    """Keys and form, in an order and with separators that keep different records apart."""
    return "\x00".join([*(k.replace("\x01", "\x01\x02").replace("\x00", "\x01\x01") for k in keys), text_form]).encode("utf-8")


class Trie:
    """Counts byte strings. A node is a dict from byte to node; a leaf is a dict from the
    rest of the bytes to its terminal, split once it holds more than LEAF records. A
    terminal counts the copies of each spelling."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.at_root = False  # whether the root is a node (else a leaf)

    def add(self, key: bytes, spelling: str, copies: int) -> None:
        node, depth, parent, step = self.root, 0, None, None
        is_node = self.at_root
        while is_node:
            if depth == len(key):
                terminal = node.setdefault(None, {})
                terminal[spelling] = terminal.get(spelling, 0) + copies
                return
            parent, step = node, key[depth]
            child = node.get(step)
            if child is None:
                child = node[step] = [False, {}]
            depth += 1
            is_node, node = child
        rest = key[depth:]
        terminal = node.get(rest)
        if terminal is None:
            terminal = node[rest] = {}
        terminal[spelling] = terminal.get(spelling, 0) + copies
        if len(node) > LEAF:
            split = self._split(node)
            if parent is None:
                self.root, self.at_root = split, True
            else:
                parent[step] = [True, split]

    @staticmethod
    def _split(leaf: dict) -> dict:
        node: dict = {}
        for rest, terminal in leaf.items():
            if not rest:
                node[None] = terminal
            else:
                node.setdefault(rest[0], [False, {}])[1][rest[1:]] = terminal
        return node

    def terminals(self) -> Iterator[tuple[bytes, dict[str, int]]]:
        """Every record's bytes, ascending, with its spellings."""
        stack: list[tuple[bytes, bool, dict]] = [(b"", self.at_root, self.root)]
        while stack:
            prefix, is_node, at = stack.pop()
            if not is_node:
                for rest in sorted(at):
                    yield prefix + rest, at[rest]
                continue
            if None in at:
                yield prefix, at[None]
            for step in sorted((k for k in at if k is not None), reverse=True):
                child_is_node, child = at[step]
                stack.append((prefix + bytes([step]), child_is_node, child))


def _combine(n_keys: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, int] = {}
        forms: dict[str, str | None] = {}

        def out() -> pd.DataFrame:
            rows = []
            for (*keys, spelling), copies in held.items():
                rows.append((canonical_bytes(keys, forms[spelling]), spelling, copies))
            return pd.DataFrame(rows, columns=["canon", "spelling", "copies"])

        for batch in batches:
            for row in zip(*(batch.iloc[:, i] for i in range(n_keys + 1))):
                text = row[-1]
                if text not in forms:
                    forms[text] = form(text)
                if forms[text] is not None:
                    held[row] = held.get(row, 0) + 1
            if len(held) >= COMBINE_ROWS:
                yield out()
                held, forms = {}, {}
        if held:
            yield out()

    return run


def _common(a: bytes, b: bytes) -> bytes:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def _child(open_: list[bytes]) -> Column:
    """canon -> the bytes of its open bucket and one more; null outside all open buckets. Buckets of few
    different depths are told by Spark's own lookups, others by bisection."""
    depths = defaultdict(list)
    for p in open_:
        depths[len(p)].append(bytearray(p))
    if len(depths) <= 8:
        return F.coalesce(*[F.when(F.substring("canon", 1, d).isin(ps) if d else F.lit(True), F.substring("canon", 1, d + 1)) for d, ps in sorted(depths.items())])

    @F.pandas_udf(T.BinaryType())
    def child(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            v = bytes(v)
            k = bisect_right(open_, v) - 1
            out.append(v[: len(open_[k]) + 1] if k >= 0 and v.startswith(open_[k]) else None)
        return pd.Series(out, dtype=object)

    return child("canon")


def radix_bounds(canon: DataFrame, bucket_rows: int = BUCKET_ROWS, max_buckets: int = MAX_BUCKETS) -> list[bytes]:
    """Lower bounds of the buckets after the first, ascending: byte prefixes.

    A level is one aggregate: each open bucket's rows by their next byte, with the least and
    greatest of each, whose common bytes the next level skips. Only buckets with more than their
    share are split, fewer than 2 * max_buckets of them a level, into at most 257 each; the driver
    holds these counts and never a record. A bucket of rows that are all equal can't be split."""
    extent = [F.count("*").alias("n"), F.min("canon").alias("lo"), F.max("canon").alias("hi")]
    root = canon.agg(*extent).first()
    share = max(bucket_rows, -(-root.n // max_buckets))
    leaves: dict[bytes, int] = {}
    open_ = [_common(bytes(root.lo), bytes(root.hi))] if root.n > share and root.lo != root.hi else []
    while open_:
        counts = canon.select("canon", _child(open_).alias("prefix")).where("prefix is not null").groupBy("prefix").agg(*extent).collect()
        open_ = []
        for r in counts:
            if r.n > share and r.lo != r.hi:
                open_.append(_common(bytes(r.lo), bytes(r.hi)))
            else:
                leaves[bytes(r.prefix)] = r.n
        open_.sort()
    bounds, filled = [], 0
    for prefix, n in sorted(leaves.items()):
        if filled and filled + n > share:
            bounds.append(prefix)
            filled = 0
        filled += n
    return bounds


def _route(bounds: list[bytes]):
    @F.pandas_udf(T.IntegerType())
    def bucket(s: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((bisect_right(bounds, bytes(v)) for v in s), dtype=np.int32, count=len(s)))

    return bucket


def _count(n_keys: int, trie_rows: int):
    """Rows in the order of their bytes."""
    columns = [*(f"key_{i}" for i in range(n_keys)), "form", "spelling", "pos", "copies", "n_spellings", "n_copies"]

    def records(trie: Trie) -> Iterator[tuple]:
        for canon, terminal in trie.terminals():
            *keys, text_form = canon.decode("utf-8").split("\x00")
            keys = [k.replace("\x01\x01", "\x00").replace("\x01\x02", "\x01") for k in keys]
            total = sum(terminal.values())
            for pos, (spelling, copies) in enumerate(sorted(terminal.items())):
                yield (*keys, text_form, spelling, pos, copies, len(terminal), total)

    def tries(batches: Iterator[pd.DataFrame]) -> Iterator[Trie]:
        trie, held, last = Trie(), 0, None
        for batch in batches:
            for canon, spelling, copies in zip(batch["canon"], batch["spelling"], batch["copies"]):
                canon = bytes(canon)
                if held >= trie_rows and canon != last:
                    yield trie
                    trie, held = Trie(), 0
                trie.add(canon, spelling, int(copies))
                held, last = held + 1, canon
        yield trie

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for trie in tries(batches) for r in records(trie))
        while block := list(islice(rows, 20_000)):
            yield pd.DataFrame(block, columns=columns)

    return run


def collapse_copies(rows: DataFrame, keys: list[str], text: str, bucket_rows: int = BUCKET_ROWS, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """(key_0, ..., form, spelling, pos, copies, n_spellings, n_copies): one row for every
    spelling of every record, where a record is the string columns `keys` and the form of
    `text`. copies counts the rows with this very spelling, n_copies all rows of the record,
    pos numbers its spellings from 0 by code point: the rows with pos = 0 are the records.

    Rows with a null key or text, or a text without a word, are no records; empty tables give
    no rows; other columns don't matter."""
    ship(rows.sparkSession)
    valid = rows.select(*[F.col(k).cast("string").alias(f"key_{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text"))
    valid = valid.where(" and ".join(f"{c} is not null" for c in valid.columns))
    canon = cut(valid.mapInPandas(_combine(len(keys)), "canon binary, spelling string, copies bigint"))
    bounds = radix_bounds(canon, bucket_rows, max_buckets)
    placed = canon.repartitionById(len(bounds) + 1, _route(bounds)("canon")).sortWithinPartitions("canon")
    schema = ", ".join([*(f"key_{i} string" for i in range(len(keys))), "form string", "spelling string", "pos int", "copies bigint", "n_spellings int", "n_copies bigint"])
    return placed.mapInPandas(_count(len(keys), bucket_rows), schema)


def spelling_pairs(copies: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, form, spelling_a, spelling_b), spelling_a < spelling_b: the spellings of each
    record, pair by pair. A spelling meets the later ones in blocks, so that a record with
    very many spellings is spread over many join keys."""
    several = copies.where("n_spellings > 1").select(*keys, "form", "spelling", "pos", "n_spellings")
    a = several.where("pos < n_spellings - 1").select(*keys, "form", F.col("spelling").alias("spelling_a"), F.col("pos").alias("_a"), F.explode(F.expr(f"sequence((pos + 1) div {PAIR_BLOCK}, (n_spellings - 1) div {PAIR_BLOCK})")).alias("_block"))
    b = several.where("pos > 0").select(*keys, "form", F.col("spelling").alias("spelling_b"), F.col("pos").alias("_b"), F.expr(f"cast(pos div {PAIR_BLOCK} as bigint)").alias("_block"))
    return a.join(b, [*keys, "form", "_block"]).where("_a < _b").select(*keys, "form", "spelling_a", "spelling_b")
