"""Links between the words of a concept: plans that send no table through the driver, and large concepts."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wordloom import queries
from wordloom.operators import concepts
from wordloom.storage import materialise

MAPPED = ["d09_mention_links", "h03_links", "h04_merged_links", "f07_ordered"]


@pytest.mark.parametrize("name", MAPPED)
def test_nothing_is_broadcast(spark, name):
    """Stored tables are several times their files in memory, so no join of links may rely on the files' size."""
    plan = queries.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("most", [0, 20, 1000])
def test_mentions_in_small_and_large_concepts(spark, monkeypatch, most):
    """All concepts large, one of the three large, none large: the same links, those of all pairs."""
    rng = random.Random(9)
    syllables = ["ka", "kä", "to", "'", "%", "mi", "ß", "𐍈"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(30)]
    said = {w: rng.choice([None, "", "to", f"From {rng.choice(words)} and {rng.choice(words)}.", "".join(rng.choices(syllables, k=12))]) for w in words}
    entries = [(f"{lang}:{w}", w, lang, said[w]) for w in sorted(said) for lang in ("A", "B")]
    members = [(c, i, w, lang) for c, n in (("few", 12), ("some", 20), ("many", 40)) for i, w, lang, _ in rng.sample(entries, n)]
    texts = {i: t for i, _, _, t in entries}
    want = {
        (c, f"{w}:{lang}", f"{v}:{other}")
        for c, i, w, lang in members
        for d, _, v, other in members
        if c == d and (w, lang) != (v, other) and len(v) >= 3 and v in (texts[i] or "")
    }
    assert {c for c, _, _ in want} == {"few", "some", "many"}
    monkeypatch.setattr(concepts, "MENTIONING", most)
    stored = [materialise(spark.createDataFrame(rows, schema)) for rows, schema in ((members, "concept string, entry_id string, word string, lang string"), (entries, "entry_id string, word string, lang string, etymology_text string"))]
    got = concepts.mention_links(*stored)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.groupBy(*got.columns).count().filter(F.col("count") > 1).isEmpty()
