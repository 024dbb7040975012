"""Token counts of texts, by a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOADED: dict = {}  # tokenizers of this Python worker, by path


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def token_length(text: Column, tokenizer_path: str) -> Column:
    """Number of tokens of a text without special tokens; null for null.

    Texts reach Python in Arrow batches; a worker loads the tokenizer once.  The file must be
    readable under the same path on every executor."""
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(tokenizer_path)
        for some in batches:
            there = some.notna()
            found = iter(tokenizer.encode_batch(some[there].tolist(), add_special_tokens=False))
            yield pd.Series([len(next(found)) if t else None for t in there], dtype="Int64")

    return count(text)
