"""Scores that compare an answer with a reference by order of words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is one integer, a bit per word of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F measure of the longest common subsequence of two word lists; 0 if nothing is common, null lists are empty."""

    def one(x, y):
        x, y = [[] if z is None else list(z) for z in (x, y)]
        k = common_length(x, y) if x and y else 0
        return 2.0 * k / (len(x) + len(y)) if k else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)
