"""Whole trees of a dictionary, nodes and edges, against a plain traversal."""

import os
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.tree_model import Model
from wordloom.functions.uncertainty import classify
from wordloom.operators import edges, graph, templates
from wordloom.sources import lexicon, tables
from wordloom.storage import materialise

#: TREES_SF=sf0.01 runs it on larger tables.
TABLES = f"{DATA}/{os.environ.get('TREES_SF', 'sf0.001')}"


def fold(word):
    return "".join(c for c in unicodedata.normalize("NFKD", word.removeprefix("*")) if unicodedata.category(c) != "Mn")


@pytest.fixture(scope="module")
def dictionary(spark):
    entries = lexicon.entries(spark, TABLES)
    names = tables.language_names(entries)
    components = materialise(edges.with_existence(templates.component_edges(entries, names), entries))
    seeds = lexicon.seeds(spark, TABLES).withColumn("etym", F.lit(None).cast("int"))
    numbered = entries.filter("etymology_number = 2").orderBy("entry_id").limit(60).select(F.concat(F.lit("2nd:"), "entry_id").alias("seed_id"), "word", "lang", F.lit(2).alias("etym"))
    odd = spark.createDataFrame([("odd:1", "nosuchword", "English", None), ("odd:2", "nosuchword", "English", 1)], "seed_id string, word string, lang string, etym int")
    return entries, names, components, materialise(seeds.select("seed_id", "word", "lang", "etym").unionByName(numbered).unionByName(odd))


@pytest.mark.parametrize("types", [("inh", "bor", "der"), ("inh", "cog")])
def test_trees(spark, dictionary, types):
    entries, names, components, seeds = dictionary
    nodes, links = graph.Trees(entries, components, names, types).build(seeds)
    got_nodes, got_edges = defaultdict(dict), defaultdict(dict)
    for r in nodes.collect():
        got_nodes[r.seed_id][r.id] = (r.label, r.language, r.level, r.uncertainty and r.uncertainty.type)
    for r in links.collect():
        got_edges[r.seed_id][r.from_id, r.to_id] = r.label

    rows = [r.asDict(recursive=True) for r in entries.select("entry_id", "word", "lang", "lang_code", "pos", "etymology_number", "etymology_templates").collect()]
    parts = defaultdict(set)
    for r in components.filter("from_exists").collect():
        parts[r.to_word, r.to_lang].add((r.from_word, r.from_lang, r.edge_type))
    classes = {r.entry_id: r.u.type for r in entries.select("entry_id", classify().alias("u")).filter("u.is_uncertain").collect()}
    model = Model(rows, {r.lang_code: r.lang for r in names.collect()}, parts, classes, fold, types)
    asked = seeds.collect()
    assert len(asked) > 60 and set(got_nodes) == {r.seed_id for r in asked}
    for r in asked:
        want_nodes, want_edges = model.build(r.word, r.lang, r.etym)
        assert got_nodes[r.seed_id] == want_nodes, r
        assert got_edges[r.seed_id] == want_edges, r
