"""The few functions without a built-in equivalent, as Arrow-batched UDFs."""

from __future__ import annotations

from bisect import bisect_right
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=65536)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts; not symmetric, null for a null side."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


class SentenceChunks:
    """Table function: chunks of whole sentences of one text.

    A chunk takes sentences while they fit behind its overlap with the text
    before it; where it ends is found by bisection in the ends of all sentences.
    """

    def eval(self, text: str, pieces: list, size: int, overlap: int):
        if text is None:
            return
        if len(text) <= size:
            yield 0, 0, len(text), text, None
            return
        joined, ends = "".join(pieces), list(accumulate(map(len, pieces)))
        number, taken, before, carried = 0, 0, 0, ""
        while taken < len(ends):
            # at least one sentence, however long
            taken = max(taken + 1, bisect_right(ends, before + size - len(carried)))
            end = ends[taken - 1]
            following = text[max(0, end - overlap):end] if taken < len(ends) else None
            yield number, before - len(carried), end, carried + joined[before:end], following
            number, before, carried = number + 1, end, following


CHUNK_RETURN = "chunk_id int, start_index int, end_index int, chunk_text string, overlap_text string"


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL as ``seq_ratio`` and ``sentence_chunks``."""
    spark.udf.register("seq_ratio", seq_ratio)
    spark.udtf.register("sentence_chunks", F.udtf(SentenceChunks, returnType=CHUNK_RETURN))
