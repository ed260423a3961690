"""Quality of the data: do ancestors exist, in which form, and how do stored results compare with fresh ones?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.normalise import fold, strip_stars

FORMS = ("exact", "asterisk", "macron", "both")


def chain_audit(ancestry: DataFrame, entries: DataFrame) -> DataFrame:
    """``ancestry`` with ``form``: the first of exact, without asterisks, without accents, without both, in which the
    ancestor is a word of that language code; else missing. One join over all candidate forms of the distinct ancestors."""
    named = ancestry.select("anc_word", "anc_code").distinct()
    bare = fold(fold(named.withColumn("__ast", strip_stars(F.col("anc_word"))), "anc_word", "__mac"), "__ast", "__both")
    forms = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("w")) for k, c in enumerate(("anc_word", "__ast", "__mac", "__both"))))
    wanted = bare.select("anc_word", "anc_code", F.explode(forms).alias("f")).distinct()
    known = entries.select(F.col("word").alias("__w"), F.col("lang_code").alias("__c")).distinct()
    best = wanted.join(known, (F.col("f.w") == F.col("__w")) & (F.col("anc_code") == F.col("__c"))).groupBy("anc_word", "anc_code").agg(F.min("f.k").alias("k"))
    form = F.coalesce(*(F.when(F.col("k") == k, name) for k, name in enumerate(FORMS)), F.lit("missing"))
    return ancestry.join(best, ["anc_word", "anc_code"], "left").withColumn("form", form).drop("k")


def audit_totals(audited: DataFrame) -> DataFrame:
    """References by form, and the share that is found in one."""
    of = lambda name: F.count_if(F.col("form") == name).alias(name)
    found = F.count_if(F.col("form") != "missing")
    return audited.agg(F.count("*").alias("total"), *map(of, FORMS), of("missing"), F.bround(100 * found / F.greatest(F.count("*"), F.lit(1)), 3).alias("match_rate"))


def edge_statistics(edges: DataFrame) -> DataFrame:
    """Edges, those whose component exists, and their share."""
    matched = F.count_if(F.col("from_exists"))
    return edges.agg(F.countDistinct("to_word", "to_lang").alias("words"), F.count("*").alias("edges"), matched.alias("matched"), F.bround(100 * matched / F.greatest(F.count("*"), F.lit(1)), 3).alias("match_rate"))


def phonetic_statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("ipa").isNotNull() & ~F.col("error")).alias("enriched"),
        F.count_if(F.col("ipa").isNull()).alias("no_ipa"),
        F.count_if(F.col("error")).alias("errors"),
    )


def coverage(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expected (lang, word) that are no nodes."""
    return expected.join(nodes, ["lang", "word"], "left_anti")


def drift(old: DataFrame, new: DataFrame, key: list[str], ignored: list[str]) -> DataFrame:
    """Per key: missing (only in one), none or drift, comparing all columns but the ignored ones."""
    columns = sorted(c for c in new.columns if c not in key and c not in ignored)
    digest = lambda df, name: df.select(*key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias(name))
    both = digest(old, "old").join(digest(new, "new"), key, "full_outer")
    state = F.when(F.col("old").isNull() | F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "none").otherwise("drift")
    return both.select(*key, state.alias("state"))


def stale(old: DataFrame, new: DataFrame, key: str = "seed_id") -> DataFrame:
    """Keys whose stored fingerprint is not the fresh one."""
    return old.select(key, F.col("hash").alias("old_hash")).join(new.select(key, F.col("hash").alias("new_hash")), key).filter("old_hash <> new_hash").select(key)
