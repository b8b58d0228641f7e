"""Counting the tokens of a text column.

A counter is any function from a column to a column of integers, so that another vocabulary, or a
cheap stand-in, can take this one's place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Counter = Callable[[Column], Column]
VOCABULARY = "byte_bpe_50k.json"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    out.no_truncation()
    out.no_padding()
    return out


def token_counter(vocabulary: str = VOCABULARY) -> Counter:
    """Counts by a tokenizers file, given by its path or by the name of a public one; special
    strings in a text are ordinary text, a null text has no tokens."""

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        encode = _tokenizer(path).encode_batch
        for batch in batches:
            yield pd.Series([len(x.ids) for x in encode([x or "" for x in batch], add_special_tokens=False)], dtype="int64")

    counted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(counted, "bigint")


def characters(text: Column) -> Column:
    """A stand-in that runs in SQL functions alone: code points."""
    return F.coalesce(F.length(text), F.lit(0))
