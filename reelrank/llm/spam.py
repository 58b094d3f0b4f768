"""Keyword-stuffed and link-list pages (problem 10), by suffix automata.

A page is read twice. As a sequence of words, its suffix automaton gives the characters covered
by repeated maximal substrings; they count where clauses are missing, that is where few different
words stand around (a clause hardly repeats a word, stuffing goes on with the same ones), and not
within a refrain (a long repeat that is a clause itself). As a sequence of shapes (short entry, number,
link, tag, mark between entries), in which a clause is a symbol of its own that never repeats, a second automaton
covers lists: entries that follow each other in one repeated shape without any clause. No word of any
language is known to the operator."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.runtime import quoted, ship


@dataclass(frozen=True)
class Settings:
    """repeats: occurrences from which a substring counts as repeated; window: words among which
    variety is measured; variety: share of different words up to which a place has no
    clause; refrain, plain: words of a repeat (of its period), and share of different words among them,
    from which it is a clause of its own; entry: words up to which an entry of a list is no clause; caption: the same beside
    a number or link; entries: the least entries of a list; share: part of a page's characters
    beyond which it is spam."""

    repeats: int = 3
    window: int = 32
    variety: float = 0.5
    refrain: int = 7
    plain: float = 0.75
    entry: int = 3
    caption: int = 6
    entries: int = 5
    share: float = 0.5


#: A link with its caption, a tag, a time of day, a number (also a code or price), a run of words, a
#: mark. A caption may have any length; beyond 200 characters it holds no opening bracket, so that a
#: page full of these is still read in linear time.
_WORD = r"[\p{L}\p{M}][\p{L}\p{M}\p{N}]*+(?:[-'’](?=\p{L})[\p{L}\p{M}\p{N}]++)*+"
_NO_HOST = r"(?!(?:[.-]\w|://))"
PIECE = regex.compile(
    rf"(?P<words>{_WORD}{_NO_HOST}(?:[ \t]+{_WORD}{_NO_HOST})*)"
    r"|(?P<link>\[(?:[^\]\n]{0,200}|[^\[\]\n]*)\]\([^)\s]*\)|<a\b[^<>\n]*>[^<\n]*</a>|(?:https?://|www\.)\S+|\b[\w-]{1,63}(?:\.[\w-]{1,63}){1,10}/\S*)"
    r"|(?P<tag>[#@][\p{L}\p{M}\p{N}_]+)"
    r"|(?P<clock>(?<![\p{Sc}\d.,:])\d{1,2}[:h]\d{2}(?![:\p{N}]))"
    r"|(?P<number>(?:\p{Sc}\s?)?\p{N}[\p{N}\p{L}]*(?:[.,:/-]\p{N}+)*|\p{L}+-\p{N}+)"
    rf"|(?P<word>{_WORD})"
    r"|(?P<mark>[^\s\p{L}\p{M}\p{N}]+)"
)
#: Marks or wide gaps that stand between a name and its part in a line.
LEADER = regex.compile(r"\S(?:\s?(?:\.{3,}|…|_{3,}|:)|\s[–—-]+\s|\t|\s{2})\s*+\S")
LEADS = ("...", "…", "___", ":", "\t", "  ", "–", "—", "- ", "\u00a0")  # one of these is in every leader
SAYS = ("entry", "number", "link", "tag")


class SuffixAutomaton:
    """Of runs of hashable tokens; online, in linear time. None ends a run: no substring
    reaches over it."""

    def __init__(self, tokens: list) -> None:
        nexts: list[dict] = [{}]
        link, length, count = [-1], [0], [0]
        ends = [0] * len(tokens)
        last = 0
        for i, t in enumerate(tokens):
            if t is None:
                last = 0
                continue
            known = nexts[last].get(t)
            if known is not None and length[known] == length[last] + 1:
                cur = known
            else:
                cur = len(length)
                length.append(length[last] + 1)
                count.append(0)
                link.append(0)
                nexts.append({})
                p = last
                while p != -1 and t not in nexts[p]:
                    nexts[p][t] = cur
                    p = link[p]
                if p != -1:
                    q = nexts[p][t]
                    if length[p] + 1 == length[q]:
                        link[cur] = q
                    else:
                        clone = len(length)
                        length.append(length[p] + 1)
                        count.append(0)
                        link.append(link[q])
                        nexts.append(nexts[q].copy())
                        while p != -1 and nexts[p].get(t) == q:
                            nexts[p][t] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
                        if known is not None:  # the run itself ends in the clone
                            cur = clone
            count[cur] += 1
            last = ends[i] = cur
        # occurrences: longer substrings pass theirs on to their suffixes
        self.order = sorted(range(1, len(length)), key=length.__getitem__)
        for v in reversed(self.order):
            if link[v] > 0:
                count[link[v]] += count[v]
        self.link, self.length, self.count, self.ends = link, length, count, ends

    def repeated_suffixes(self, repeats: int) -> list[int]:
        """For each place the length of the longest substring ending there that occurs at
        least `repeats` times."""
        best = [0] * len(self.length)
        for v in self.order:  # by rising length, so that suffixes come first
            best[v] = self.length[v] if self.count[v] >= repeats else best[self.link[v]]
        return [best[v] for v in self.ends]


def repeats_at(tokens: list, repeats: int) -> np.ndarray:
    """For each token the length of the longest repeated maximal substring it lies in, 0 for
    none. Tokens that are themselves too rare end the runs, so most of a page costs nothing."""
    seen = Counter(tokens)
    out = np.zeros(len(tokens), dtype=np.int64)
    kept = [t if t is not None and seen[t] >= repeats else None for t in tokens]
    if not any(t is not None for t in kept):
        return out
    lengths = SuffixAutomaton(kept).repeated_suffixes(repeats)
    # repeats begin and end one after the other: the longest at hand is at the front
    spans = [(i + 1 - n, i, n) for i, n in enumerate(lengths) if n and not (i + 1 < len(lengths) and lengths[i + 1] == n + 1)]
    active: deque[tuple[int, int]] = deque()
    k = 0
    for j in range(len(tokens)):
        while k < len(spans) and spans[k][0] <= j:
            while active and active[-1][1] <= spans[k][2]:
                active.pop()
            active.append(spans[k][1:])
            k += 1
        while active and active[0][0] < j:
            active.popleft()
        if active:
            out[j] = active[0][1]
    return out


def covered(tokens: list, repeats: int) -> list[bool]:
    """Which tokens lie in a repeated maximal substring."""
    return [n > 0 for n in repeats_at(tokens, repeats)]


def variety(before: np.ndarray, window: int) -> np.ndarray:
    """For each word the share of different ones among the `window` around it (fewer on short
    pages). before: the place where each word stood last, -1 for nowhere."""
    n = len(before)
    w = min(window, n)
    fresh = (np.lib.stride_tricks.sliding_window_view(before, w) < np.arange(n - w + 1)[:, None]).sum(axis=1) / w
    return fresh[np.clip(np.arange(n) - w // 2, 0, n - w)]


def period(words: list[str]) -> int:
    """The least distance at which the whole sequence repeats itself; its length where it doesn't."""
    border = [0] * len(words)
    k = 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - k


def stuffed(words: list[str], s: Settings) -> np.ndarray:
    """Which words a repeated maximal substring covers where no clause is."""
    last: dict[str, int] = {}
    before = []
    for i, w in enumerate(words):
        before.append(last.get(w, -1))
        last[w] = i
    bare = variety(np.array(before), s.window) <= s.variety if words else np.zeros(0, dtype=bool)
    if not bare.any():  # clauses everywhere: nothing that repeats would count
        return bare
    held = repeats_at(words, s.repeats)
    counted = bare & (held > 0)
    # refrains: long repeats whose own words are different ones
    i, n = 0, len(words)
    while i < n:
        j = i
        while j < n and held[j] == held[i]:
            j += 1
        if held[i] >= s.refrain and counted[i:j].any():
            own = words[i : i + int(held[i])]
            own = own[: period(own)]
            if len(own) >= s.refrain and len(set(own)) >= s.plain * len(own):
                counted[i:j] = False
        i = j
    return counted


def listed(shape: list, s: Settings) -> np.ndarray:
    """Which symbols stand in a list: entries of repeated shapes, one after the other, without
    a clause (None) between, at least s.entries of them unless links or tags are among them."""
    out = np.zeros(len(shape), dtype=bool)
    if "link" not in shape and "tag" not in shape and shape.count("entry") + shape.count("number") < s.entries:
        return out

    def stretches(inside) -> Iterator[tuple[int, int]]:
        a = 0
        for b in range(len(shape) + 1):
            if b == len(shape) or not inside(b):
                run = shape[a:b]
                if "link" in run or "tag" in run or sum(x in SAYS for x in run) >= s.entries:
                    yield a, b
                a = b + 1

    if not any(True for _ in stretches(lambda b: shape[b] is not None)):
        return out
    held = repeats_at(shape, s.repeats)
    for a, b in stretches(lambda b: held[b] > 0):
        out[a:b] = True
    return out


def leads(line: str) -> bool:
    return any(x in line for x in LEADS) and LEADER.search(line) is not None


def pieces(text: str, s: Settings) -> tuple[list, list[int], list]:
    """(shape, sizes, words): the page's symbols, their characters (white space and marks aside) and the
    words of each, as one string. Clauses are None, and so is all in lines with a time of day
    (programmes) and in lines of words with a leader (casts, credits). Lines with a time of day
    and at least a figure to two words, timetables, have no words."""
    shape: list = []
    sizes: list[int] = []
    words: list = []
    find, most = PIECE.finditer, max(s.entry, s.caption)
    for line in text.split("\n"):
        first, kinds = len(shape), []
        for m in find(line):
            kind, piece = m.lastgroup, m.group()
            if kind == "words" or kind == "word":
                kinds.append("words")
                words.append(piece)
                sizes.append(len(piece) - piece.count(" ") - piece.count("\t"))
                shape.append(len(piece.split(None, most)))  # so many or more
            else:
                kinds.append(kind)
                words.append("")
                sizes.append(0 if kind == "mark" else len(piece))
                shape.append(piece if kind == "mark" else kind)
        if "words" in kinds:
            figured = "number" in kinds or "link" in kinds
            if "clock" in kinds or (not figured and "tag" not in kinds and leads(line)):
                if "clock" in kinds and sum(len(w.split()) for w in words[first:]) <= 2 * (kinds.count("clock") + kinds.count("number")):
                    words[first:] = [""] * len(kinds)
                shape[first:] = [None] * len(kinds)
            else:
                figure = [kind in ("number", "link") for kind in kinds] + [False, False] if figured else []
                for i, kind in enumerate(kinds):
                    if kind == "words":
                        n = shape[first + i]
                        beside = figured and n > s.entry and ((i and figure[i - 1]) or figure[i + 1] or (figure[i + 2] and kinds[i + 1] == "mark"))
                        shape[first + i] = "entry" if n <= (s.caption if beside else s.entry) else None
        elif "clock" in kinds:
            shape[first:] = [None] * len(kinds)
        shape.append("\n")
        sizes.append(0)
        words.append("")
    return shape, sizes, words


def spam_share(text: str, s: Settings = Settings()) -> tuple[float, float, float]:
    """(share, repeated_share, listed_share): the part of the page's characters (white space
    and marks aside) that is repeated keywords, links or tags; the part that is words covered by
    repeated substrings without clauses; and the part in lists. 0 for a page without any."""
    shape, sizes, held = pieces(text, s)
    total = sum(sizes)
    if not total:
        return 0.0, 0.0, 0.0
    in_list = listed(shape, s)
    lists = int(np.array(sizes)[in_list].sum()) if in_list.any() else 0
    counted = stuffed(" ".join(held).lower().split(), s)
    repeated = both = 0
    if counted.any():
        size = np.array([len(w) for own in held for w in own.split()])
        inside = np.repeat(in_list, [len(own.split()) for own in held])
        repeated = int(size[counted].sum())
        both = int(size[counted & inside].sum())
    return (lists + repeated - both) / total, repeated / total, lists / total


def _score(s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(0.0, 0.0, 0.0) if t is None else spam_share(t, s) for t in batch["text"]]
            out = pd.DataFrame(found, columns=["spam_share", "repeated_share", "listed_share"])
            out.insert(0, "item", batch["item"])
            yield out

    return run


def stuffed_pages(docs: DataFrame, item: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """(item, spam_share, repeated_share, listed_share, is_spam) for every row of docs.

    A page is spam if more than settings.share of its characters (white space and marks aside) are
    repeated keywords, links with their captions, or tags. Programmes (lines with a time of
    day), casts and credits, refrains and lists within honest text don't count, unless their words
    are stuffed. Null and empty texts are no spam. Each page is judged by itself and whole, so nothing is
    shuffled."""
    ship(docs.sparkSession)
    rows = docs.select(quoted(item).alias("item"), quoted(text).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    scored = rows.mapInPandas(_score(settings), f"item {kind}, spam_share double, repeated_share double, listed_share double")
    return scored.withColumn("is_spam", F.col("spam_share") > settings.share)
