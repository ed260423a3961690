"""The three jobs end to end, from files to files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from wordloom.operators import concepts, edges, graph, templates
from wordloom.sources import tables
from wordloom.storage import materialise, publish, read_published


def load_dictionary(spark: SparkSession, source: str, target: str, partitions: int, reprocess: bool = False) -> None:
    """JSON lines to the tables entries, languages, component_edges and phonetics under ``target``."""
    tables.write_entries(tables.read_json_lines(spark, source, partitions), f"{target}/entries", partitions)
    entries = read_published(spark, f"{target}/entries")
    publish(tables.languages(entries), f"{target}/languages")
    names = tables.language_names(entries)
    found = edges.with_existence(templates.component_edges(entries, names), entries)
    tables.write_component_edges(found, f"{target}/component_edges", reprocess)
    tables.append_phonetics(entries, f"{target}/phonetics", reprocess)


def trees(spark: SparkSession, target: str, seeds: DataFrame, types: Iterable[str] = ("inh",), max_ancestors: int = 10, max_descendants: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the trees of ``seeds(seed_id, word, lang[, etym])`` over a loaded dictionary."""
    entries = read_published(spark, f"{target}/entries")
    return graph.Trees(entries, read_published(spark, f"{target}/component_edges"), tables.language_names(entries), types, max_ancestors, max_descendants).build(seeds)


def concept_maps(spark: SparkSession, target: str, asked: DataFrame, threshold: float = concepts.THRESHOLD) -> dict[str, DataFrame]:
    """words, phonetic_edges, etymology_edges and clusters of ``asked(concept)`` over a loaded dictionary."""
    entries = read_published(spark, f"{target}/entries")
    voiced = concepts.spoken(entries, read_published(spark, f"{target}/phonetics"))
    found = materialise(concepts.resolve_concepts(asked, entries, voiced))
    words = materialise(concepts.word_rows(found, voiced))
    links = concepts.etymology_links(concepts.cognate_links(found, entries), concepts.mention_links(found, entries))
    return {"words": words, "phonetic_edges": concepts.pairs(words, threshold), "etymology_edges": links, "clusters": concepts.clusters(words)}
