"""Finding entries: exact and normalised look-up, search with ranking, details of a word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import entries as of
from wordloom.functions.normalise import normalise
from wordloom.functions.uncertainty import classify
from wordloom.operators.templates import mentions
from wordloom.storage import clustered, materialise


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def one_entry(entries: DataFrame) -> DataFrame:
    """One entry per (word, lang): by pos, then etymology number, nulls first."""
    usable = entries.filter(F.col("word").isNotNull() & F.col("lang").isNotNull())
    return first_per(usable, ["word", "lang"], [F.asc_nulls_first("pos"), F.asc_nulls_first("etymology_number"), "entry_id"])


class Dictionary:
    """Entries as look-ups ask for them, round after round: two tables that are dealt out once, so that a round shuffles
    what it looks for, never the dictionary.

    ``words``: word, lang, entry_id (the first entry), numbered (number, pos, entry_id of all that have a number, in this
    order), in buckets of word and lang. ``facts``: what templates and text say of each entry, in buckets of entry_id."""

    def __init__(self, entries: DataFrame):
        usable = entries.filter(F.col("word").isNotNull() & F.col("lang").isNotNull())
        first = F.min(F.struct("pos", "etymology_number", "entry_id"))  # missing values come first
        numbered = F.collect_list(F.when(F.col("etymology_number").isNotNull(), F.struct(F.col("etymology_number").alias("number"), "pos", "entry_id")))  # of one word
        words = usable.groupBy("word", "lang").agg(first.alias("f"), F.sort_array(numbered).alias("numbered")).select("word", "lang", F.col("f.entry_id").alias("entry_id"), "numbered")
        self.words, _ = clustered(words, "words", "word", "lang")
        self.facts, _ = clustered(entries.select("entry_id", "word", "lang", "lang_code", "pos", "etymology_number", "etymology_text", "etymology_templates"), "facts", "entry_id")

    def known(self) -> DataFrame:
        return self.words.select(F.col("word").alias("__w"), F.col("lang").alias("__l"), F.col("entry_id").alias("__id"))


def _known(entries: DataFrame | Dictionary) -> DataFrame:
    if isinstance(entries, Dictionary):
        return entries.known()
    return one_entry(entries).select(F.col("word").alias("__w"), F.col("lang").alias("__l"), F.col("entry_id").alias("__id"))


def resolve(wanted: DataFrame, entries: DataFrame | Dictionary, word: str = "word", lang: str = "lang") -> DataFrame:
    """``wanted`` with ``found_id``, ``found_word`` and ``how`` (exact, normalised or null).

    The exact form first; the normalised form of the wanted word only where that fails. Stored words are not changed.
    """
    return _located(wanted, _known(entries), word, lang)


def _located(wanted: DataFrame, known: DataFrame, word: str, lang: str) -> DataFrame:
    """``wanted`` with what ``known(__w, __l, __id)`` has for its word, or else for its normalised form."""
    both = normalise(wanted, word, "__norm")
    tries = F.when(F.col("__norm") == F.col(word), F.array(F.struct(F.lit(0).alias("k"), F.col(word).alias("w")))).otherwise(
        F.array(F.struct(F.lit(0).alias("k"), F.col(word).alias("w")), F.struct(F.lit(1).alias("k"), F.col("__norm").alias("w")))
    )
    forms = both.select(F.col(word).alias("__from"), F.col(lang).alias("__lang"), F.explode(tries).alias("t")).distinct()
    forms = forms.select("__from", "__lang", "t", F.col("t.w").alias("__try"))
    hits = forms.join(known, (F.col("__try") == F.col("__w")) & (F.col("__lang") == F.col("__l")))
    best = hits.groupBy("__from", "__lang").agg(F.min(F.struct("t.k", "__w", "__id")).alias("b"))
    joined = both.drop("__norm").join(best, (F.col(word) == F.col("__from")) & (F.col(lang) == F.col("__lang")), "left")
    how = F.when(F.col("b.k") == 0, "exact").when(F.col("b.k") == 1, "normalised")
    return joined.withColumns({"found_id": F.col("b.__id"), "found_word": F.col("b.__w"), "how": how}).drop("__from", "__lang", "b")


def numbered_or_any(wanted: DataFrame, entries: Dictionary) -> DataFrame:
    """``with_etymology`` that isn't strict, over a dictionary that is dealt out."""
    stored = entries.words.select("word", "lang", "numbered")
    of = F.try_element_at(F.filter("numbered", lambda x: x["number"] == F.col("etym")), F.lit(1))["entry_id"]
    exact = wanted.join(stored, ["word", "lang"], "left").withColumn("__numbered", of).drop("numbered")
    return resolve(exact, entries).withColumn("found_id", F.coalesce("__numbered", "found_id")).drop("__numbered", "found_word", "how")


def with_etymology(wanted: DataFrame, entries: DataFrame, strict: bool) -> DataFrame:
    """``wanted(word, lang, etym)`` with ``found_id``: the entry of that number, and without a number any.

    ``strict``: the number holds for the word as it is and for its normalised form, and nothing else is found. Otherwise
    for the word as it is, and any entry is found instead."""
    numbered = first_per(entries.filter("etymology_number IS NOT NULL"), ["word", "lang", "etymology_number"], [F.asc_nulls_first("pos"), "entry_id"])
    if strict:  # the number is a part of the language's name, for those that have one
        key = lambda lang, number: F.concat(lang, F.lit("\n"), number.cast("string"))
        known = numbered.select(F.col("word").alias("__w"), key(F.col("lang"), F.col("etymology_number")).alias("__l"), F.col("entry_id").alias("__id"))
        known = known.unionByName(one_entry(entries).select(F.col("word").alias("__w"), F.col("lang").alias("__l"), F.col("entry_id").alias("__id")))
        asked = wanted.withColumn("__key", F.coalesce(key(F.col("lang"), F.col("etym")), "lang"))
        return _located(asked, known, "word", "__key").drop("__key", "found_word", "how")
    exact = wanted.join(numbered.select("word", "lang", F.col("etymology_number").alias("etym"), F.col("entry_id").alias("__numbered")), ["word", "lang", "etym"], "left")
    return resolve(exact, entries).withColumn("found_id", F.coalesce("__numbered", "found_id")).drop("__numbered", "found_word", "how")


def polysemy(entries: DataFrame, most: int = 20) -> DataFrame:
    """Etymology groups of words that have two or more: word, lang, etymology_number, pos (sorted, joined), first_gloss."""
    numbered = entries.filter("etymology_number IS NOT NULL")
    groups = numbered.groupBy("word", "lang", "etymology_number").agg(
        F.array_join(F.sort_array(F.collect_set("pos")), ", ").alias("pos"),
        F.min_by(of.first_gloss(F.col("senses")), F.struct("pos", "entry_id")).alias("first_gloss"),
    )
    w = Window.partitionBy("word", "lang")
    ranked = groups.withColumn("__k", F.row_number().over(w.orderBy("etymology_number"))).filter(F.col("__k") <= most)
    return ranked.withColumn("__n", F.count("*").over(w)).filter("__n >= 2").drop("__k", "__n")


def begun_by(rows: DataFrame, word: str, queries: DataFrame, key: str, collation: str | None = None) -> DataFrame:
    """``rows`` joined with the ``queries`` whose ``key`` their ``word`` equals or begins with.

    The queries are written first, so that their size is known when the join is planned: within Spark's own limit they are
    broadcast, and words meet them where they lie, without a shuffle of their beginnings; beyond it both are shuffled."""
    alike = lambda c: F.collate(c, collation) if collation else c
    asked = materialise(queries, "asked")
    starts = F.transform(F.sequence(F.lit(0), F.length(word)), lambda k: F.substring(F.col(word), F.lit(1), k))
    begun = rows.withColumn("__start", F.explode(starts))
    return begun.join(asked, alike(F.col("__start")) == alike(F.col(key))).drop("__start")


def prefix_hits(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``found(word, ...)`` for each query (q) that a word equals or begins with, case-sensitive and literal, with ``exact``."""
    return begun_by(found, "word", queries.select("q").distinct(), "q").withColumn("exact", F.col("word") == F.col("q"))


def search(queries: DataFrame, entries: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of each query(q): exact words first, then words it begins, one per (word, lang), ``limit`` of them; exact hits
    with several etymologies are then given one by one. Columns q, rank, word, lang, pos, etymology_number, first_gloss."""
    hits = prefix_hits(queries, one_entry(entries).select("word", "lang", "pos"))
    order = Window.partitionBy("q").orderBy(F.desc("exact"), "word", "lang", "pos")
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    groups = polysemy(entries).select("word", "lang", F.col("pos").alias("group_pos"), F.col("etymology_number").alias("number"), F.col("first_gloss").alias("gloss"))
    exact = top.filter("exact").join(groups, ["word", "lang"], "left").select("q", "rank", "word", "lang", F.coalesce("group_pos", "pos").alias("pos"), F.col("number").alias("etymology_number"), F.col("gloss").alias("first_gloss"))
    return exact.unionByName(top.filter("NOT exact").select("q", "rank", "word", "lang", "pos"), allowMissingColumns=True)


def best_match(hits: DataFrame) -> DataFrame:
    """Of the hits of each query, the first that equals it but for case, else the first."""
    return hits.groupBy("q").agg(F.min_by(F.struct("word", "lang"), F.struct((F.lower("word") != F.lower("q")), "rank", F.coalesce("etymology_number", F.lit(0)))).alias("b")).select("q", "b.word", "b.lang")


def details(entries: DataFrame, names: DataFrame, phonetics: DataFrame) -> DataFrame:
    """What is shown of an entry: glosses, first IPA, etymology text and templates, classification, mentions in their
    order, recordings, and its phonetic IPA and classes."""
    said = mentions(entries, names).select("entry_id", F.struct("ord", F.col("mention").alias("word"), F.col("mention_lang").alias("lang"), F.col("mention_code").alias("lang_code"), "source_template", "role").alias("m"))
    listed = said.groupBy("entry_id").agg(F.sort_array(F.collect_list("m")).alias("mentions"))  # of one entry
    shown = entries.select(
        "entry_id",
        "word",
        "lang",
        "pos",
        of.all_glosses(F.col("senses")).alias("glosses"),
        of.first_ipa(F.col("sounds")).alias("ipa"),
        "etymology_text",
        of.templates().alias("etymology_templates"),
        classify().alias("uncertainty"),
        of.audio(F.col("sounds")).alias("audio"),
    )
    phonetic = phonetics.select("entry_id", F.col("ipa").alias("phonetic_ipa"), "dolgo_classes", "dolgo_consonants")
    return shown.join(listed, "entry_id", "left").join(phonetic, "entry_id", "left")


def word_details(wanted: DataFrame, entries: DataFrame, names: DataFrame, phonetics: DataFrame) -> DataFrame:
    """``details`` of each of ``wanted(word, lang[, etym])`` that is found, strictly by its number if it has one, with
    ``asked_word`` and ``asked_lang``."""
    asked = wanted if "etym" in wanted.columns else wanted.withColumn("etym", F.lit(None).cast("int"))
    found = with_etymology(asked, entries, strict=True).filter("found_id IS NOT NULL")
    found = found.select(F.col("word").alias("asked_word"), F.col("lang").alias("asked_lang"), F.col("found_id").alias("entry_id")).distinct()
    met = entries.join(found.select("entry_id").distinct(), "entry_id", "left_semi")
    return found.join(details(met, names, phonetics), "entry_id")
