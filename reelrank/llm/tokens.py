"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parameters: a file of byte-level ranks that every executor can read (REELRANK_TOKENIZER names
#: another one), and the pattern that goes with it.
TOKENIZER = os.environ.get("REELRANK_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how the public byte-level vocabularies cut texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER, pattern: str = PATTERN) -> int:
    return len(encoding(path, pattern).encode_ordinary(text))


def tokens_udf(path: str = TOKENIZER, pattern: str = PATTERN):
    """string -> int, the number of tokens; null stays null."""

    @F.pandas_udf(T.IntegerType())
    def n_tokens(s: pd.Series) -> pd.Series:
        e = encoding(path, pattern)
        return pd.Series([None if v is None else len(e.encode_ordinary(v)) for v in s], dtype="Int32")

    return n_tokens
