"""Sequence-matching ratios; no built-in equals them, so they run on Arrow batches.

They compare two texts row by row in time that grows with the square of their length: a reference
for sentence-sized texts, not for whole documents.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(DoubleType())
def adjacent_ratio(parts: pd.Series) -> pd.Series:
    """Mean ratio of neighbouring sentences; null with fewer than two."""

    def mean(items):
        pairs = [SequenceMatcher(None, a, b).ratio() for a, b in zip(items, items[1:])]
        return sum(pairs) / len(pairs) if pairs else None

    return pd.Series([mean(list(p)) for p in parts], dtype="float64")
