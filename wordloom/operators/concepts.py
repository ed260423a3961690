"""Concept maps: the words of a concept in all languages, their similarity, clusters and known links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import similarity as s
from wordloom.functions.entries import all_glosses, arg, node_id, summary, templates
from wordloom.functions.normalise import one_case
from wordloom.operators.lookup import begun_by, first_per, one_entry
from wordloom.schema import COGNATE
from wordloom.storage import materialise, shuffled

#: Hub words below which glosses are searched too.
ENOUGH = 10
THRESHOLD = 0.3
#: Words of a concept that one task compares with all others of it.
TOGETHER = 1000
#: Words of a concept up to which each is looked for in the texts of all others, without the first letters of either.
MENTIONING = 200


def hubs(entries: DataFrame) -> DataFrame:
    """One English entry with translations per word: concept, pos, translations."""
    with_translations = entries.filter((F.col("lang") == "English") & (F.size(F.coalesce("translations", F.array())) > 0))
    return one_entry(with_translations).select(F.col("word").alias("concept"), "pos", "translations")


def suggest(prefixes: DataFrame, entries: DataFrame, limit: int = 10) -> DataFrame:
    """Per prefix (q): concepts that begin with it whatever the case, most translations first. Columns q, rank, concept, translation_count.

    Both are brought to one case in full (``ß``, ``ẞ`` and ``SS`` are the same, ``İ`` and ``I`` are not) and compared as Unicode
    does, accents included."""
    counted = entries.filter((F.col("lang") == "English") & (F.size(F.coalesce("translations", F.array())) > 0)).select(F.col("word").alias("concept"), "pos", F.size("translations").alias("translation_count"), "entry_id")
    asked = prefixes.select("q").distinct().withColumn("__key", one_case(F.col("q")))
    hits = begun_by(counted.withColumn("__folded", one_case(F.col("concept"))), "__folded", asked, "__key", "UNICODE_CI")
    order = Window.partitionBy("q").orderBy(F.desc("translation_count"), "concept", "pos", "entry_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("q", "rank", "concept", "pos", "translation_count")


def spoken(entries: DataFrame, phonetics: DataFrame, pos: str | None = None) -> DataFrame:
    """Entries with an IPA, one per (word, lang), with their classes; of one part of speech if ``pos`` is given. The words
    of a concept are found among these, so this is also how a concept is asked for as a noun or a verb."""
    entries = entries if pos is None else entries.filter(F.col("pos") == pos)
    voiced = phonetics.filter("ipa IS NOT NULL").select("entry_id", "ipa", "dolgo_classes", "dolgo_consonants", "dolgo_first2")
    return one_entry(entries.drop("ipa").join(voiced, "entry_id"))


def members(hub: DataFrame, voiced: DataFrame) -> DataFrame:
    """(concept, entry_id, word, lang): spoken words among a hub's translations, and the concept itself in English."""
    listed = hub.select("concept", F.explode("translations").alias("t")).select("concept", F.col("t.word").alias("word"), F.col("t.lang").alias("lang"))
    pairs = listed.filter("word <> '' AND lang <> ''").unionByName(hub.select("concept", F.col("concept").alias("word"), F.lit("English").alias("lang"))).distinct()
    return pairs.join(voiced.select("word", "lang", "entry_id"), ["word", "lang"]).select("concept", "entry_id", "word", "lang")


def gloss_members(concepts: DataFrame, voiced: DataFrame) -> DataFrame:
    """(concept, entry_id, word, lang): spoken words with a gloss that equals the concept but for case."""
    glossed = voiced.select("entry_id", "word", "lang", F.explode(all_glosses(F.col("senses"))).alias("gloss")).select("entry_id", "word", "lang", F.lower("gloss").alias("key")).distinct()
    return concepts.select("concept", F.lower("concept").alias("key")).join(glossed, "key").select("concept", "entry_id", "word", "lang")


def resolve_concepts(concepts: DataFrame, entries: DataFrame, voiced: DataFrame) -> DataFrame:
    """Words of each concept with the method: translation_hub, combined (hub and glosses) or gloss_search.
    Glosses are searched only where the hub gives fewer than ENOUGH words."""
    hub = hubs(entries).join(concepts, "concept", "left_semi")
    by_hub = members(hub, voiced)
    counted = concepts.join(by_hub.groupBy("concept").agg(F.count("*").alias("n")), "concept", "left").join(hub.select("concept", F.lit(True).alias("has_hub")), "concept", "left").na.fill(0, ["n"])
    few = counted.filter(F.col("n") < ENOUGH).select("concept", "has_hub")
    more = gloss_members(few.select("concept"), voiced).join(by_hub, ["concept", "word", "lang"], "left_anti")
    method = F.when(F.col("n") >= ENOUGH, "translation_hub").when(F.col("has_hub"), "combined").otherwise("gloss_search")
    return by_hub.unionByName(more).join(counted.select("concept", method.alias("method")), "concept")


def word_rows(members_: DataFrame, voiced: DataFrame) -> DataFrame:
    """What a map shows of each word; missing strings are empty."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    shown = voiced.select(
        "entry_id",
        node_id(F.col("word"), F.col("lang")).alias("id"),
        *map(empty, ("word", "lang", "lang_code", "pos", "ipa", "dolgo_classes", "dolgo_consonants", "dolgo_first2")),
        (F.size(templates()) > 0).alias("has_etymology"),
        summary().alias("etymology_summary"),
    )
    return members_.select("concept", "entry_id").join(shown, "entry_id")


def _alike(a: str, b: str, threshold: float) -> Column:
    """Can two strings be similar? Only where their lengths allow the threshold is a distance measured, and given up where
    it goes beyond what the threshold allows: never too early, the similarity itself decides."""
    allowed = F.floor((1 - threshold) * F.greatest(F.length(a), F.length(b))).cast("int") + 1
    return _same_start(a, b) | ((F.abs(F.length(a) - F.length(b)) <= allowed) & (s.distance_within(a, b, allowed) >= 0))


def _same_start(a: str, b: str) -> Column:
    return s.first_two_match(F.substring(a, 1, 2), F.substring(b, 1, 2))


def pairs(words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Similar pairs within a concept: concept, source, target (ordered), similarity (3 places), turchin_match, shared_classes.

    The words of a concept meet in one join on the concept. A concept of more than TOGETHER words is dealt into shares
    instead, one side of a comparison having one share and the other all strings; there distinct strings are compared,
    and words come back by equality. What isn't alike is dropped by the joins' own conditions.
    """
    usable = words.filter("dolgo_consonants <> ''").select("concept", "id", F.col("dolgo_consonants").alias("c"))
    large = usable.groupBy("concept").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("shares")).filter("shares > 1")
    side = lambda df, k, x: df.select("concept", F.col("c").alias(k), F.col("id").alias(x))

    few = usable.join(large, "concept", "left_anti")
    a, b = side(few, "a", "x").alias("l"), side(few, "b", "y").alias("r")
    near = a.join(b, (F.col("l.concept") == F.col("r.concept")) & (F.col("x") < F.col("y")) & _alike("a", "b", threshold)).select("l.concept", "x", "y", "a", "b")

    many = usable.join(large, "concept")
    strings = many.select("concept", "c", "shares").distinct()
    a = strings.select("concept", F.pmod(F.xxhash64("c"), F.col("shares")).cast("int").alias("share"), F.col("c").alias("a"))
    b = strings.select("concept", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("c").alias("b"))
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # asked for, as shares are few bytes and much work
    a, b = (x.repartition(tasks, "concept", "share").alias(n) for x, n in ((a, "l"), (b, "r")))
    met = a.join(b, (F.col("l.concept") == F.col("r.concept")) & (F.col("l.share") == F.col("r.share")) & (F.col("a") <= F.col("b")) & _alike("a", "b", threshold)).select("l.concept", "a", "b")
    met = met.filter((s.similarity(F.col("a"), F.col("b")) >= threshold) | _same_start("a", "b"))
    met = met.join(side(many, "a", "x"), ["concept", "a"]).join(side(many, "b", "y"), ["concept", "b"]).filter((F.col("a") < F.col("b")) | (F.col("x") < F.col("y")))

    found = near.unionByName(met).withColumns({"sim": s.similarity(F.col("a"), F.col("b")), "turchin_match": _same_start("a", "b")}).filter((F.col("sim") >= threshold) | F.col("turchin_match"))
    return found.select("concept", F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), s.rounded(F.col("sim")).alias("similarity"), "turchin_match", s.common_prefix(F.col("a"), F.col("b")).alias("shared_classes"))


def select_pairs(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges at or above a threshold (of the rounded similarity) or with a first-two match."""
    return edges.filter((F.col("similarity") >= threshold) | F.col("turchin_match"))


def clusters(words: DataFrame) -> DataFrame:
    """Words of a concept by their first two classes, groups of two or more: concept, id, label, words."""
    groups = words.filter(F.length("dolgo_first2") >= 2).groupBy("concept", "dolgo_first2").agg(F.sort_array(F.collect_list("id")).alias("words"))
    label = F.concat(F.substring("dolgo_first2", 1, 1), F.lit("-"), F.substring("dolgo_first2", 2, 1), F.lit(" group"))
    return groups.filter(F.size("words") >= 2).select("concept", F.concat(F.lit("cluster_"), "dolgo_first2").alias("id"), label.alias("label"), "words")


def cognate_links(members_: DataFrame, entries: DataFrame) -> DataFrame:
    """Members whose spelling a member's cognate template names, in whatever language: concept, source, target."""
    cogs = entries.select("entry_id", F.explode(F.filter(templates(), lambda t: t["name"] == COGNATE)).alias("t")).select("entry_id", arg(F.col("t"), "2").alias("spelling"))
    named = members_.select("concept", "entry_id", node_id(F.col("word"), F.col("lang")).alias("source")).join(shuffled(cogs), "entry_id")
    targets = members_.select("concept", F.col("word").alias("spelling"), node_id(F.col("word"), F.col("lang")).alias("target"))
    return named.join(shuffled(targets), ["concept", "spelling"]).filter("source <> target").select("concept", "source", "target").distinct()


def mention_links(members_: DataFrame, entries: DataFrame, least: int = 3) -> DataFrame:
    """Members whose spelling (three letters or more) a member's text contains: concept, source, target.

    The words of a concept meet in one join on the concept, whose condition looks for the spelling in the text. In a concept
    of more than MENTIONING words spellings meet texts by their first letters instead, which must occur in the text; only
    what so meets is looked up in it. Only members' texts are read, once."""
    own = entries.select("entry_id", "etymology_text").filter(F.length("etymology_text") >= least)
    said = members_.select("concept", "entry_id", node_id(F.col("word"), F.col("lang")).alias("source")).join(shuffled(own), "entry_id")
    spelled = members_.filter(F.length("word") >= least).select("concept", F.col("word").alias("spelling"), node_id(F.col("word"), F.col("lang")).alias("target"))
    large = materialise(members_.groupBy("concept").count().filter(F.col("count") > MENTIONING).select("concept"), "large")
    holds = F.col("etymology_text").contains(F.col("spelling")) & (F.col("source") != F.col("target"))
    meet = lambda texts, words: texts.alias("l").join(shuffled(words.alias("r")), (F.col("l.concept") == F.col("r.concept")) & holds).select("l.concept", "source", "target").distinct()
    if large.isEmpty():
        return meet(said, spelled)

    some = lambda df, how: df.join(shuffled(large), "concept", how)
    few = meet(some(said, "left_anti"), some(spelled, "left_anti"))
    said = some(said, "left_semi")
    texts = materialise(said.select("entry_id", "etymology_text").distinct(), "texts")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("etymology_text") - least + 1), lambda i: F.substring(F.col("etymology_text"), i, F.lit(least))))
    sources = said.select("concept", "entry_id", "source", F.explode(grams).alias("gram"))
    spelled = some(spelled, "left_semi").withColumn("gram", F.substring("spelling", 1, least))
    met = sources.join(shuffled(spelled), ["concept", "gram"]).select("concept", "entry_id", "source", "spelling", "target")
    return few.unionByName(met.join(shuffled(texts), "entry_id").filter(holds).select("concept", "source", "target").distinct())


def etymology_links(cognate: DataFrame, mention: DataFrame) -> DataFrame:
    """Undirected links once per concept, the relation found first: by source word, cognate before mention."""
    both = cognate.withColumns({"k": F.lit(0), "relationship": F.lit("cognate")}).unionByName(mention.withColumns({"k": F.lit(1), "relationship": F.lit("mentioned")}))
    keyed = both.withColumns({"x": F.least("source", "target"), "y": F.greatest("source", "target")})
    return first_per(keyed, ["concept", "x", "y"], ["source", "k", "target"]).select("concept", "source", "target", "relationship")


def merge_words(words: DataFrame) -> DataFrame:
    """One row per word over all concepts, with the sorted list of its concepts."""
    return words.groupBy("id").agg(F.sort_array(F.collect_set("concept")).alias("concepts"), F.min("word").alias("word"), F.min("lang").alias("lang"))


def merge_links(links: DataFrame) -> DataFrame:
    """Links over all concepts once per pair of ends; the relation of the smallest concept."""
    keyed = links.withColumns({"x": F.least("source", "target"), "y": F.greatest("source", "target")})
    return first_per(keyed, ["x", "y"], ["concept", "source", "target"]).select("source", "target", "relationship")


def canonical(edges: DataFrame, *columns: Column | str) -> DataFrame:
    """Rows in their canonical order, for output."""
    return edges.orderBy(*(columns or edges.columns))
