"""Greedy packing of words into chunks."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid


def packed(text: str, size: int) -> list[str]:
    """Chunks of one text: lengths of words are summed once, and each chunk's end is found by bisection."""
    words = text.split()
    # ends[i]: characters of the first i words, each with the space behind it
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1, initial=0))
    out, a = [], 0
    while a < len(words):
        b = max(a + 1, bisect_right(ends, ends[a] + size + 1) - 1)
        out.append(" ".join(words[a:b]))
        a = b
    return out


def chunks(text: Column, size: int) -> Column:
    """Array of chunks: words joined by one space, at most ``size`` characters; a longer word is a chunk by itself."""
    if size < 1:
        raise Invalid("a chunk has at least one character")

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else packed(t, size) for t in texts], dtype=object)

    return pack(text)


def chunked(documents: DataFrame, size: int, source: str = "source", text: str = "text") -> DataFrame:
    """(id, source, chunk, document): one row a chunk, ids ``source#000000`` and on."""
    rows = documents.select(F.col(source).alias("source"), F.posexplode(chunks(F.col(text), size)).alias("chunk", "document"))
    return rows.select(F.format_string("%s#%06d", "source", "chunk").alias("id"), "source", "chunk", "document")
