"""Several values packed in one field (problem 1).

A quote-aware finite-state tokenizer reads each distinct field once. Its states
are *between* values, *inside an open value* and *inside quotes*; beside the state
it tracks escapes and the depth of brackets. Delimiters count only outside quotes,
outside brackets that open within a value, and outside names of a vocabulary."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelrank.runtime import quoted, ship

#: These always end a value ...
HARD_DELIMITERS = "|,;/\t\n\r\x0b\x0c｜、，；•·"
#: ... these only with white space on both sides.
SOFT_DELIMITERS = "&+-–—"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "`": "`"}
BRACKETS = {"[": "]", "{": "}", "(": ")"}
#: Names with a delimiter or a quote inside, beyond which they are looked up by a join.
INLINE_NAMES = 20_000
#: Beyond that, characters by which a name is looked up.
NAME_HEAD = 12


@dataclass(frozen=True)
class Dialect:
    """How values are packed. names: values that are one whatever they hold;
    placeholders: values that stand for none (any case)."""

    hard: str = HARD_DELIMITERS
    soft: str = SOFT_DELIMITERS
    names: frozenset[str] = field(default_factory=frozenset)
    placeholders: frozenset[str] = field(default_factory=frozenset)


def _match_brackets(s: str) -> dict[int, int]:
    """For each opening bracket the place of its partner; unpaired ones are left out."""
    stack: list[int] = []
    pairs: dict[int, int] = {}
    for i, ch in enumerate(s):
        if ch in BRACKETS:
            stack.append(i)
        elif ch in "]})":
            if stack and BRACKETS[s[stack[-1]]] == ch:
                pairs[stack.pop()] = i
    return pairs


class Tokenizer:
    """The machine. One object serves any number of fields; each takes time in
    proportion to its length."""

    def __init__(self, dialect: Dialect):
        self.d = dialect
        self.names: dict[str, list[str]] = {}
        for n in sorted((n.strip() for n in dialect.names), key=lambda n: (-len(n), n)):
            if n:
                self.names.setdefault(n[0], []).append(n)
        self.none = {self._bare(p).casefold() for p in dialect.placeholders}

    def _bare(self, v: str) -> str:
        v = v.strip()
        while len(v) > 1 and v[0] in BRACKETS and v[-1] == BRACKETS[v[0]] and _match_brackets(v).get(0) == len(v) - 1:
            v = v[1:-1].strip()
        return v

    def _ends(self, s: str, i: int, depth: int, after_quote: bool) -> bool:
        """Whether a value may end just before i."""
        n, j = len(s), i
        while j < n and s[j].isspace() and s[j] not in self.d.hard:
            j += 1
        if j >= n or s[j] in self.d.hard:
            return True
        if depth and s[j] in "]})":
            return True
        if s[j] in self.d.soft and (j > i or after_quote):
            return j + 1 >= n or s[j + 1].isspace()
        return after_quote and j > i and s[j] in QUOTES

    def __call__(self, s: str | None) -> list[str]:
        if s is None or not s.strip():
            return []
        if self._bare(s).casefold() in self.none:
            return []
        out: list[str] = []
        pairs = _match_brackets(s) if any(b in s for b in BRACKETS) else {}
        no_closer: set[str] = set()
        containers: list[int] = []  # where the open containers end
        i, n = 0, len(s)

        def emit(v: str) -> None:
            v = self._bare(v)
            if v and v.casefold() not in self.none:
                out.append(v)

        while i < n:
            ch = s[i]
            # between values
            if ch.isspace() or ch in self.d.hard:
                i += 1
                continue
            if containers and i == containers[-1]:
                containers.pop()
                i += 1
                continue
            if ch in self.d.soft and (i + 1 >= n or s[i + 1].isspace()) and (i == 0 or s[i - 1].isspace() or s[i - 1] in "\"'"):
                i += 1
                continue
            name = next((x for x in self.names.get(ch, ()) if s.startswith(x, i) and self._ends(s, i + len(x), len(containers), False)), None)
            if name is not None:
                out.append(name)
                i += len(name)
                continue
            if ch in "[{" and i in pairs and self._ends(s, pairs[i] + 1, len(containers), False):
                containers.append(pairs[i])
                i += 1
                continue
            if ch in QUOTES and ch not in no_closer:
                closed = self._quoted(s, i, len(containers))
                if closed:
                    emit(closed[0])
                    i = closed[1]
                    continue
                no_closer.add(ch)
            # inside an open value
            start, piece = i, []
            while i < n:
                ch = s[i]
                if ch == "\\" and i + 1 < n and (s[i + 1] in self.d.hard or s[i + 1] in "\\\"'[]{}()"):
                    piece.append(s[i + 1])
                    i += 2
                    continue
                if ch in self.d.hard or (containers and i == containers[-1]):
                    break
                if ch in self.d.soft and i > start and s[i - 1].isspace() and (i + 1 >= n or s[i + 1].isspace()):
                    break
                if ch in BRACKETS and i in pairs and (not containers or pairs[i] < containers[-1]):
                    piece.append(s[i : pairs[i] + 1])
                    i = pairs[i] + 1
                    continue
                piece.append(ch)
                i += 1
            emit("".join(piece))
        return out

    def _quoted(self, s: str, i: int, depth: int) -> tuple[str, int] | None:
        """The value in quotes from i and the place after it; None if they don't close."""
        q, n, piece = QUOTES[s[i]], len(s), []
        j = i + 1
        while j < n:
            ch = s[j]
            if ch == "\\" and j + 1 < n and s[j + 1] in (q, "\\"):
                piece.append(s[j + 1])
                j += 2
            elif ch == q:
                if s.startswith(q, j + 1) and not (j == i + 1 and self._ends(s, j + 1, depth, True)):
                    piece.append(q)
                    j += 2
                elif self._ends(s, j + 1, depth, True):
                    return "".join(piece), j + 1
                else:
                    piece.append(ch)
                    j += 1
            else:
                piece.append(ch)
                j += 1
        return None


@lru_cache(maxsize=8)
def _machine(dialect: Dialect) -> Tokenizer:
    return Tokenizer(dialect)


def tokenize(text: str | None, dialect: Dialect = Dialect()) -> list[str]:
    """The values of one field, in order."""
    return _machine(dialect)(text)


def split_udf(dialect: Dialect):
    """string -> array<string>. Each distinct field of an Arrow batch is read once."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split_packed(s: pd.Series) -> pd.Series:
        run, seen = _machine(dialect), {}
        out = []
        for v in s:
            if v not in seen:
                seen[v] = run(v)
            out.append(seen[v])
        return pd.Series(out)

    return split_packed


def split_udf_with_names(dialect: Dialect):
    """(string, array<string> of names that the field holds) -> array<string>."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split_packed(s: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for v, own in zip(s, names):
            own = frozenset() if own is None else frozenset(own)
            run = _machine(dialect) if not own else Tokenizer(Dialect(dialect.hard, dialect.soft, dialect.names | own, dialect.placeholders))
            out.append(run(v))
        return pd.Series(out)

    return split_packed


@F.pandas_udf(T.StringType())
def _stripped(s: pd.Series) -> pd.Series:
    """Names as the machine holds them."""
    return s.map(lambda v: None if v is None else v.strip())


@F.pandas_udf(T.StringType())
def _head(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else v[:NAME_HEAD])


def _heads_udf(dialect: Dialect, lengths: list[int]):
    """string -> the texts of these lengths from every place where a value may start: at a
    delimiter, a quote, a bracket or another sign, or after one."""
    stops = frozenset(dialect.hard + dialect.soft)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def heads(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            found: set[str] = set()
            if v is not None:
                sign = [not ch.isalnum() or ch in stops for ch in v]
                for i in range(len(v)):
                    if i == 0 or sign[i] or sign[i - 1]:
                        found.update(v[i : i + k] for k in lengths if i + k <= len(v))
            out.append(sorted(found))
        return pd.Series(out)

    return heads


def explode_packed(
    df: DataFrame,
    column: str,
    keep: list[str],
    vocabulary: DataFrame | None = None,
    placeholders: Iterable[str] = (),
    value: str = "value",
    pos: str = "pos",
    inline_names: int = INLINE_NAMES,
    dialect: Dialect | None = None,
) -> DataFrame:
    """One row per value of `column`: the columns `keep`, then `pos` (from 1) and
    `value`.

    vocabulary: a table whose first string column lists names that are one value even
    where they hold delimiters. Only names with a delimiter or quote inside need to be
    known to the machine. Up to `inline_names` of them travel with the machine; of a
    larger vocabulary each field gets, by an equi-join, just those names it holds.

    Values come without surrounding white space, quotes and brackets; an escaped or
    doubled quote inside is one quote; repeats stay. Empty values take no place. Null,
    blank and placeholder fields (any case, quoted or bracketed) give no row. An unclosed
    quote or bracket is an ordinary character. Rows of df are not made distinct; other
    columns, whatever their names, don't matter."""
    taken = [c.lower() for c in keep]
    if len(set(taken)) < len(taken) or {pos.lower(), value.lower()} & set(taken):
        raise ValueError("keep must hold different names, none of them that of pos or value")
    ship(df.sparkSession)
    base = dialect or Dialect(placeholders=frozenset(placeholders))
    src = quoted(column)
    cols: list[Column] = [quoted(c) for c in keep]
    if vocabulary is None:
        values = split_udf(base)(src)
        return df.select(*cols, F.posexplode(values).alias("_p0", "_v0")).select(*[quoted(c) for c in keep], (F.col("_p0") + 1).alias(pos), F.col("_v0").alias(value))
    name = next(f.name for f in vocabulary.schema.fields if isinstance(f.dataType, T.StringType))
    odd = "".join("\\" + ch if ch in "|[]-\\^" else ch for ch in base.hard + base.soft) + "\"'`“”‘’«»\\[\\]{}()"
    special = vocabulary.select(F.trim(quoted(name)).alias("n")).where(F.col("n").rlike(f"[{odd}]")).distinct()
    first = [r.n for r in special.limit(inline_names + 1).collect()]  # bounded by inline_names
    if len(first) <= inline_names:
        values = split_udf(Dialect(base.hard, base.soft, base.names | frozenset(first), base.placeholders))(src)
        return df.select(*cols, F.posexplode(values).alias("_p0", "_v0")).select(*[quoted(c) for c in keep], (F.col("_p0") + 1).alias(pos), F.col("_v0").alias(value))
    # a name is met by its first characters, then looked for in the field; the machine decides
    names = special.select(_stripped("n").alias("n")).where("n <> ''").distinct().withColumn("_h", _head("n"))
    lengths = sorted(r[0] for r in names.select(F.length("_h")).distinct().collect())  # at most NAME_HEAD
    texts = df.select(src.alias("_text")).where(F.col("_text").isNotNull()).distinct()
    held = texts.select("_text", F.explode(_heads_udf(base, lengths)("_text")).alias("_h")).join(names, "_h").where(F.contains("_text", F.col("n"))).groupBy("_text").agg(F.collect_set("n").alias("_names"))
    split = texts.join(held, "_text", "left").select("_text", split_udf_with_names(base)("_text", "_names").alias("_values"))
    kept = df.select(*[c.alias(f"_k{i}") for i, c in enumerate(cols)], src.alias("_text"))
    rows = kept.join(split, "_text").select(*[f"_k{i}" for i in range(len(keep))], F.posexplode("_values").alias("_p0", "_v0"))
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], (F.col("_p0") + 1).alias(pos), F.col("_v0").alias(value))
