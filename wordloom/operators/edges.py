"""Component edges: do the components exist, and which lead to given words?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.normalise import normalise


def with_existence(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``edges`` with ``from_exists``: is the component, exact or normalised, a word of its language?

    One join for both forms, on the distinct (word, lang) of either side.
    """
    wanted = normalise(edges.select("from_word", "from_lang").distinct(), "from_word", "__norm")
    forms = wanted.select("from_word", "from_lang", F.explode(F.array_distinct(F.array("from_word", "__norm"))).alias("__form"))
    words = entries.select(F.col("word").alias("__form"), F.col("lang").alias("from_lang")).filter(F.col("__form").isNotNull() & F.col("from_lang").isNotNull()).distinct()
    there = forms.join(words, ["__form", "from_lang"], "left_semi").select("from_word", "from_lang").distinct().withColumn("__there", F.lit(True))
    return edges.join(there, ["from_word", "from_lang"], "left").withColumn("from_exists", F.coalesce("__there", F.lit(False))).drop("__there")


def leading_to(nodes: DataFrame, edges: DataFrame, word: str = "word", lang: str = "lang") -> DataFrame:
    """Existing components of given words: ``nodes`` joined with from_word, from_lang, edge_type."""
    there = edges.filter("from_exists").select(F.col("to_word").alias(word), F.col("to_lang").alias(lang), "from_word", "from_lang", "edge_type")
    return nodes.join(there.distinct(), [word, lang])
