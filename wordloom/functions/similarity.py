"""Similarity of consonant strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length: 0 for two empty strings, 1 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def distance_within(a: str, b: str, limit: Column) -> Column:
    """Edit distance, or -1 where it is beyond the limit: found along the table's diagonal only."""
    return F.call_function("levenshtein", F.col(a), F.col(b), limit)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance, not rounded: edges are made by this value."""
    return 1 - distance(a, b)


def rounded(value: Column) -> Column:
    """To three places, halves to even: edges are later selected by this value."""
    return F.bround(value, 3)


def first_two_match(a: Column, b: Column) -> Column:
    return (F.length(a) >= 2) & (F.length(b) >= 2) & (a == b)


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("array()").cast("array<int>")), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(k))
    return F.substring(a, F.lit(1), same)
