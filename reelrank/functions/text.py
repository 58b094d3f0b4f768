"""Text functions over columns (TX*). All are built from Spark's own expressions and stay
inside code generation, except those named *_udf: Spark has no Unicode normalisation and no
sequence alignment."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a query that say nothing about a title.
QUERY_STOP_WORDS = ["a", "an", "and", "for", "from", "in", "movie", "movies", "of", "on", "the", "to", "with"]
#: Words that stay small within a displayed title.
MINOR_WORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
POSTER_SIZES = ["w92", "w154", "w185", "w342", "w500", "w780", "original"]
_SPACE = r"(?U)[\s﻿]+"


def fixed(value: Column, digits: int) -> Column:
    """value to so many decimals, halves up: one formula that any engine computes alike."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def bound(value: Column, f) -> Column:
    """f(value) with value computed once: within a lambda an outer expression would be
    computed again for every element."""
    return F.transform(F.array(value), f)[0]


def exact_key(c: Column) -> Column:
    """TX1/TX4: lower case, underscores and long dashes as spaces, single spaces, none at
    the ends; '' for null. Punctuation stays."""
    dashes = F.regexp_replace(F.lower(c), "[_–—]", " ")
    return F.coalesce(F.btrim(F.regexp_replace(dashes, _SPACE, " ")), F.lit(""))


def display_title(c: Column) -> Column:
    """TX2: "Meadow, The" reads "The Meadow"; null stays null."""
    moved = r"(?is)^(.*),\s+(A|An|The)\z"
    return F.when(c.rlike(moved), F.concat_ws(" ", F.regexp_extract(c, moved, 2), F.regexp_extract(c, moved, 1))).otherwise(c)


def without_article(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^(a|an|the)\s+", "")


def title_keys(c: Column) -> Column:
    """TX3: the keys of the title as written, as displayed and without its article."""
    shown = display_title(c)
    keys = F.array(exact_key(c), exact_key(shown), exact_key(without_article(shown)))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def ordered_tokens(c: Column) -> Column:
    """TX5: runs of ASCII letters and digits of the key, in order, repeats kept."""
    return F.regexp_extract_all(exact_key(c), F.lit("([a-z0-9]+)"), 1)


def title_tokens(c: Column) -> Column:
    """TX6."""
    return F.array_distinct(ordered_tokens(c))


def query_tokens(c: Column) -> Column:
    """TX7: distinct tokens without the stop words."""
    return F.array_except(title_tokens(c), F.array(*map(F.lit, QUERY_STOP_WORDS)))


def ignored_tokens(c: Column) -> Column:
    """TX7: the stop words of a query."""
    return F.array_intersect(title_tokens(c), F.array(*map(F.lit, QUERY_STOP_WORDS)))


def edit_text(c: Column) -> Column:
    """TX8."""
    return F.btrim(F.regexp_replace(exact_key(c), "[^a-z0-9]+", " "))


def trigrams(c: Column) -> Column:
    """TX9: distinct three-character pieces of the edit text between ^ and $, in order."""
    pieces = lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return bound(F.concat(F.lit("^"), edit_text(c), F.lit("$")), lambda p: F.when(F.length(p) > 2, pieces(p)).otherwise(F.array().cast("array<string>")))


def is_adjacent_swap(a: Column, b: Column) -> Column:
    """TX11: equal but for two neighbouring characters that changed places."""
    swapped = lambda i: F.concat(F.left(a, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    places = F.filter(F.sequence(F.lit(0), F.length(a) - 1), lambda i: i > 0)
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & (a != b) & F.exists(places, swapped)


def correction_distance(a: Column, b: Column) -> Column:
    """TX12: 1 for an adjacent swap, else the Levenshtein distance (TX10). A swap has
    distance 2, so only such pairs are looked at twice."""
    return bound(F.levenshtein(a, b), lambda d: F.when((d == 2) & (F.length(a) == F.length(b)) & is_adjacent_swap(a, b), 1).otherwise(d))


def contains_term(text: Column, term: Column) -> Column:
    """TX14: whether term stands in text with no ASCII letter or digit on either side."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    quoted = F.concat(F.lit("\\Q"), term, F.lit("\\E"))
    return F.expr("true") & F.call_function("rlike", padded, F.concat(F.lit("[^a-z0-9]"), quoted, F.lit("[^a-z0-9]")))


def replace_term(text: Column, term: Column, by: Column) -> Column:
    """TX15: the first place where term stands as a whole, replaced."""
    at = F.call_function("regexp_instr", F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit("[^a-z0-9]\\Q"), term, F.lit("\\E[^a-z0-9]")))
    before = F.substring(text, F.lit(1), at - 1)
    after = F.substring(text, at + F.length(term), F.length(text))
    return F.when(at > 0, F.concat(before, by, after)).otherwise(text)


def title_case(phrase: Column) -> Column:
    """TX16: words with a capital, minor words small except at the start."""
    minor = F.array(*map(F.lit, MINOR_WORDS))
    parts = F.split(phrase, " ")
    return F.array_join(F.transform(parts, lambda w, i: F.when((i > 0) & F.array_contains(minor, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " ")


def initials(c: Column) -> Column:
    """TX17: the first letters of the tokens, the blocking key of names."""
    return F.array_join(F.transform(ordered_tokens(c), lambda t: F.left(t, F.lit(1))), "")


def phrase_shape(tokens: Column) -> Column:
    """TX18: number of tokens and their initials."""
    return F.concat_ws(":", F.size(tokens).cast("string"), F.array_join(F.transform(tokens, lambda t: F.left(t, F.lit(1))), ""))


def slug(c: Column) -> Column:
    """ETL12: ASCII letters and digits with dashes between; `unknown` where none are left."""
    dashed = F.regexp_replace(F.regexp_replace(exact_key(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("unknown"))


# --- Unicode (the normal forms need Python)


@F.pandas_udf(T.StringType())
def nfc_udf(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def person_key_udf(s: pd.Series) -> pd.Series:
    """TX13: NFKD without combining marks, lower case, other characters as single spaces."""
    plain = s.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True).str.lower()
    return plain.str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


def fold(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.category(ch).startswith("M"))


@F.pandas_udf(T.StringType())
def judged_title_udf(s: pd.Series) -> pd.Series:
    """TX26: no marks, no parentheses, no article; letters and digits of any script."""
    plain = s.map(lambda v: None if v is None else fold(v).lower()).str.replace(r"\([^)]*\)", " ", regex=True)
    plain = plain.str.replace(r"[^\w]+|_", " ", regex=True).str.strip()
    return plain.str.replace(r"^(?:a|an|the)\s+", "", regex=True).str.replace(r"\s+", " ", regex=True)


def unicode_text(c: Column) -> Column:
    """TX19: NFC, lower case, Devanagari digits as ASCII ones, dashes and white space as
    single spaces."""
    digits = F.translate(F.lower(nfc_udf(c)), "०१२३४५६७८९", "0123456789")
    return F.coalesce(F.btrim(F.regexp_replace(F.regexp_replace(digits, "[‐-―_-]", " "), _SPACE, " ")), F.lit(""))


def unicode_tokens(normal: Column) -> Column:
    """TX20, of a text that unicode_text returned."""
    return F.regexp_extract_all(normal, F.lit(r"([\p{L}\p{N}][\p{L}\p{M}\p{N}]*)"), 1)


def unicode_key(normal: Column) -> Column:
    """TX21."""
    return F.array_join(unicode_tokens(normal), " ")


def graphemes(c: Column) -> Column:
    """TX22: what is read as one character. Devanagari consonants that a virama joins are one, as in the
    newer rules of Unicode, which \\X here doesn't know."""
    joined = "(?:[\u0915-\u0939\u0958-\u095f\u0978-\u097f]\u093c?\u094d\u200d?(?=[\u0915-\u0939\u0958-\u095f\u0978-\u097f]))*"
    return F.regexp_extract_all(c, F.lit(f"({joined}\\X)"), 1)


def grapheme_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@F.pandas_udf(T.IntegerType())
def grapheme_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """TX23: Levenshtein over two arrays of graphemes."""
    return pd.Series([None if x is None or y is None else grapheme_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")


def grapheme_trigrams(chars: Column) -> Column:
    """TX24: joined threes of ^, the graphemes and $."""
    pieces = lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(p) - 2), lambda i: F.array_join(F.slice(p, i, F.lit(3)), "")))
    return bound(F.concat(F.array(F.lit("^")), chars, F.array(F.lit("$"))), lambda p: F.when(F.size(p) > 2, pieces(p)).otherwise(F.array().cast("array<string>")))


def script_of(c: Column) -> Column:
    """TX25."""
    deva, latin = c.rlike(r"\p{IsDevanagari}"), c.rlike(r"\p{IsLatin}")
    return F.when(deva & latin, "mixed").when(deva, "devanagari").when(latin, "latin").otherwise("other")


def same_person(a: Column, b: Column) -> Column:
    """TX27: every token of the shorter name stands in the longer one (arrays of tokens)."""
    inside = lambda x, y: F.forall(x, lambda t: F.array_contains(y, t))
    return (F.size(a) > 0) & (F.size(b) > 0) & F.when(F.size(a) <= F.size(b), inside(a, b)).otherwise(inside(b, a))


def poster_url(path: Column, size: str, base: str) -> Column:
    """TX28: only for paths of the usual form and a known size, else null."""
    if size not in POSTER_SIZES:
        raise ValueError(f"size must be one of {POSTER_SIZES}")
    return F.when(path.rlike(r"^/[A-Za-z0-9_-]+\.(jpg|jpeg|png|webp)\z"), F.concat(F.lit(f"{base}/{size}"), path))


def role_label(roles: Column) -> Column:
    """TX29."""
    return F.array_join(F.transform(roles, lambda r: F.initcap(r)), " · ")


def revision(json: Column, length: int = 16) -> Column:
    """TX30: the leading hexadecimal digits of SHA-256."""
    return F.left(F.sha2(json, 256), F.lit(length))


def shuffle_key(seed: str, item: Column) -> Column:
    """TX31: sort by this for a fixed order that looks random."""
    return F.sha2(F.concat(F.lit(seed + "\x00"), item.cast("string")), 256)


def tsv_cell(c: Column) -> Column:
    """TX32: text for one cell of a TSV, its tabs and line breaks as single spaces."""
    return F.regexp_replace(c, r"[\t\r\n]+", " ")


# --- ordered alignment (RK4)


def align(query: list[str], title: list[str]) -> tuple[int, int, int]:
    """(matched, first, last): the best way to find words of the query in the title in their order: most
    words first, then the narrowest stretch of the title, then the earliest word of the query, then
    the earliest place in the title. (0, -1, -1) where no word is found.

    Dynamic programming over prefixes: `upto[j]` is the chain to go on from after j words of the
    title, with the rows of the query above: the longest, of equal ones that which begins latest in
    the title, of equal ones the one met first. A chain is (words, first place in the title, first word of the query)."""
    nothing = (0, -1, -1)
    upto = [nothing] * (len(title) + 1)
    best, found = None, (0, -1, -1)
    for i, word in enumerate(query):
        row, here = [nothing], nothing
        for j, other in enumerate(title):
            if word == other:
                n, start, asked = upto[j]
                chain = (n + 1, start if n else j, asked if n else i)
                value = (chain[0], chain[1] - j, -chain[2], -chain[1])
                if best is None or value > best:
                    best, found = value, (chain[0], chain[1], j)
                here = max(here, chain, key=lambda c: c[:2])
            row.append(max(upto[j + 1], here, key=lambda c: c[:2]))
        upto = row
    return found


ALIGNMENT = T.StructType([T.StructField("matched", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])


@F.pandas_udf(ALIGNMENT)
def align_udf(query: pd.Series, title: pd.Series) -> pd.DataFrame:
    found = [(0, -1, -1) if q is None or t is None else align(list(q), list(t)) for q, t in zip(query, title)]
    return pd.DataFrame(found, columns=["matched", "first", "last"])
