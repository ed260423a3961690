"""Folding of accents. Only distinct forms beyond ASCII go to Python; everything else is a built-in expression."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKD", x))


def strip_star(word: Column) -> Column:
    """Without one leading asterisk."""
    return F.regexp_replace(word, r"^\*", "")


def strip_stars(word: Column) -> Column:
    """Without all leading asterisks."""
    return F.regexp_replace(word, r"^\*+", "")


def one_case(word: Column) -> Column:
    """In one case, in full: ``ß``, ``ẞ`` and ``ss`` are "SS" (the capital ``ẞ`` is its own in upper case); ``İ`` keeps its dot."""
    return F.replace(F.upper(word), F.lit("ẞ"), F.lit("SS"))


def fold(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``: NFKD of a column without non-spacing marks. Folded once per distinct form beyond ASCII."""
    forms = df.select(F.col(column).alias("__form")).filter(F.col("__form").rlike(r"[^\x00-\x7f]")).distinct()
    folded = forms.select("__form", F.regexp_replace(_decomposed("__form"), r"\p{Mn}", "").alias("__folded"))
    return df.join(folded, F.col(column) == F.col("__form"), "left").withColumn(out, F.coalesce("__folded", F.col(column))).drop("__form", "__folded")


def normalise(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``: the headword form of a display form (one asterisk and all accents gone)."""
    return fold(df.withColumn("__bare", strip_star(F.col(column))), "__bare", out).drop("__bare")
