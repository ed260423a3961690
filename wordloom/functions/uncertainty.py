"""Is an etymology uncertain? Templates speak before the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.entries import templates
from wordloom.schema import UNCERTAIN_TEMPLATES

# Phrases, in the order they are tried.
DISPUTED = ("two interpretations", "disputed", "competing etymolog", "multiple etymolog", "alternative etymolog")
UNCERTAIN = (
    "uncertain origin",
    "unknown origin",
    "of obscure origin",
    "origin uncertain",
    "origin unknown",
    "etymology uncertain",
    "etymology unknown",
    "possibly from",
    "perhaps from",
    "maybe from",
    "probably from",
    "likely from",
)


def _result(uncertain: bool, kind: Column, source: Column, confidence: str) -> Column:
    return F.struct(
        F.lit(uncertain).alias("is_uncertain"), kind.cast("string").alias("type"), source.cast("string").alias("source"), F.lit(confidence).alias("confidence")
    )


def from_templates() -> Column:
    name = F.try_element_at(F.filter(templates(), lambda t: t["name"].isin(*UNCERTAIN_TEMPLATES)), F.lit(1))["name"]
    kind = F.coalesce(*(F.when(name == k, v) for k, v in UNCERTAIN_TEMPLATES.items()))
    return F.when(name.isNotNull(), _result(True, kind, F.concat(F.lit("template:"), name), "high"))


def from_text() -> Column:
    text = F.lower("etymology_text")
    found = lambda phrases: F.coalesce(*(F.when(text.contains(p), p) for p in phrases))
    disputed, uncertain = found(DISPUTED), found(UNCERTAIN)
    phrase = F.coalesce(disputed, uncertain)
    kind = F.when(disputed.isNotNull(), "disputed").otherwise("uncertain")
    return F.when(phrase.isNotNull(), _result(True, kind, F.concat(F.lit("text:"), phrase), "medium"))


def classify() -> Column:
    return F.coalesce(from_templates(), from_text(), _result(False, F.lit(None), F.lit(None), "high"))
