"""The form of a tag and the words of a title, as UDFs that read each distinct
string of an Arrow batch once."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def form(tag: str | None) -> str | None:
    """NFKC, lower case, its words in code-point order; None where there is no word."""
    if tag is None:
        return None
    words = WORD.findall(unicodedata.normalize("NFKC", tag).lower())
    return " ".join(sorted(words)) or None


def words(title: str | None) -> list[str] | None:
    return None if title is None else WORD.findall(title.lower())


def _each_once(f, s: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for v in s:
        if v not in seen:
            seen[v] = f(v)
        out.append(seen[v])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def form_udf(s: pd.Series) -> pd.Series:
    return _each_once(form, s)


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_udf(s: pd.Series) -> pd.Series:
    return _each_once(words, s)
