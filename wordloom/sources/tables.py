"""Reading JSON lines and writing the tables of a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.entries import best_ipa
from wordloom.functions.phonetics import sound_classes
from wordloom.schema import ENTRY
from wordloom.storage import publish, published, read_published


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of JSON lines, with ``entry_id``. Blank and malformed lines are skipped; a field of another type than
    the schema's reads as null and its line is kept."""
    raw = F.trim(F.col(column))
    objects = lines.select(raw.alias("raw")).filter((F.col("raw") != "") & F.try_parse_json("raw").isNotNull() & F.col("raw").startswith("{"))
    return objects.select(F.hex(F.xxhash64("raw")).alias("entry_id"), F.from_json("raw", ENTRY).alias("e")).select("entry_id", "e.*")


def read_json_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Entries of a file of JSON lines. Gzip files are one partition each: give ``partitions`` to deal their lines out."""
    lines = spark.read.text(path)
    return parse_lines(lines.repartition(partitions) if partitions else lines)


def write_entries(entries: DataFrame, path: str, partitions: int) -> None:
    """A new snapshot of the table of entries, clustered by language and word."""
    publish(entries.repartition(partitions, "lang", "word").sortWithinPartitions("lang", "word"), path)


def languages(entries: DataFrame) -> DataFrame:
    """Distinct (lang_code, lang)."""
    return entries.select("lang_code", "lang").distinct()


def language_names(entries: DataFrame) -> DataFrame:
    """One name per code and no empty ones: the smallest where a code has several."""
    known = languages(entries).filter((F.col("lang_code") != "") & (F.col("lang") != ""))
    return known.groupBy("lang_code").agg(F.min("lang").alias("lang"))


def write_component_edges(edges: DataFrame, path: str, reprocess: bool = False) -> None:
    """Write the edges unless there are some already; ``reprocess`` replaces them. Clustered by the word they lead to."""
    if reprocess or not published(edges.sparkSession, path):
        publish(edges.repartition("to_word", "to_lang").sortWithinPartitions("to_word", "to_lang"), path)


def phonetic_rows(entries: DataFrame) -> DataFrame:
    """(entry_id, ipa, error, tokens, classes...) of entries that have sounds: ipa null where there is none, error true
    where no class was found."""
    with_sounds = entries.filter(F.size(F.coalesce("sounds", F.array())) > 0).select("entry_id", best_ipa(F.col("sounds")).alias("ipa"))
    with_sounds = with_sounds.withColumn("ipa", F.when(F.col("ipa") != "", F.col("ipa")))
    classes = sound_classes(with_sounds.filter("ipa IS NOT NULL"))
    failed = F.col("ipa").isNotNull() & (F.coalesce(F.col("dolgo_classes"), F.lit("")) == "")
    return with_sounds.join(classes, "ipa", "left").select("entry_id", "ipa", failed.alias("error"), "tokens", "dolgo_classes", "dolgo_consonants", "dolgo_first2")


def missing_phonetics(entries: DataFrame, done: DataFrame | None) -> DataFrame:
    """Phonetic rows of the entries that ``done`` has not; of all with None."""
    return phonetic_rows(entries if done is None else entries.join(done.select("entry_id"), "entry_id", "left_anti"))


def append_phonetics(entries: DataFrame, path: str, reprocess: bool = False) -> None:
    """Enrich what is new and add it to the table at ``path``; ``reprocess`` does all again."""
    spark = entries.sparkSession
    if reprocess or not published(spark, path):
        publish(phonetic_rows(entries), path)
    else:
        publish(missing_phonetics(entries, read_published(spark, path)), path, add=True)


def graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per seed: its nodes and edges as arrays. A seed's graph is bounded by the depths it was built with."""
    n = nodes.groupBy("seed_id").agg(F.sort_array(F.collect_list(F.struct("level", "id", "label", "language", "uncertainty"))).alias("nodes"))
    e = edges.groupBy("seed_id").agg(F.sort_array(F.collect_list(F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "label"))).alias("edges"))
    return n.join(e, "seed_id", "left").select("seed_id", "nodes", F.coalesce("edges", F.expr("array()").cast("array<struct<`from`:string,`to`:string,label:string>>")).alias("edges"))


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graphs(nodes, edges).write.mode("overwrite").json(path)
