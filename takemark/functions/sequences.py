"""Longest increasing runs of arrays."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def longest_run(values: list) -> list[int]:
    """Positions of the longest strictly increasing run; of equal ones the one that ends first, and so back from its end.

    Patience piles: a value goes on the first pile whose last value isn't smaller, and its run is as long as the pile's number.
    Down a pile values don't rise, so both the pile and the first fitting value of the pile before are found by bisection.
    """
    tops: list = []
    piles: list[tuple[list, list[int]]] = []  # negated values, so that they don't fall, and their positions
    before = [-1] * len(values)
    ends: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            piles.append(([], []))
            ends.append(i)
        else:
            tops[k] = v
        if k:
            negated, places = piles[k - 1]
            before[i] = places[bisect_left(negated, True, key=lambda x: -x < v)]
        piles[k][0].append(-v)
        piles[k][1].append(i)
    at, out = (ends[-1] if ends else -1), []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


@F.pandas_udf(ArrayType(IntegerType()))
def _runs(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else longest_run(list(v)))


def in_order(values: Column) -> Column:
    """Positions of the longest strictly increasing run of an array of numbers, the one that ends first of equal ones; in O(n log n). Null for null."""
    return _runs(values)
