"""The queries of concepts, sounds and prefixes against DuckDB on sf0.01, where words beyond ASCII are among the concepts."""

import duckdb
import pytest

from tests.conftest import DATA
from tests.test_oracle import plain
from wordloom import queries

LARGER = f"{DATA}/sf0.01"
NAMES = ["b13_glosses", "b16_sound_classes", "c03_prefix", "c05_suggest", "c06_gloss_match", "c09_details", "d07_pairs", "d09_mention_links", "e03_clusters", "f05_top_concepts", "h02_resolution", "h03_links"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{LARGER}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, LARGER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    told = duck.execute(queries.SQL[name])
    where = {d[0]: i for i, d in enumerate(told.description)}
    assert sorted(where) == columns
    assert got == sorted((tuple(plain(r[where[c]]) for c in columns) for r in told.fetchall()), key=repr) and got


def test_sounds_and_letters_that_the_rules_are_about(spark, duck):
    """The tables hold what these queries are tested for: tied and untied affricates, tones, prenasal stops, sharp s."""
    found = {r.ipa: r.dolgo_classes for r in queries.QUERIES["b16_sound_classes"](spark, LARGER).collect()}
    for part, kind in (("t͡ʃ", "K"), ("˥˩", "1"), ("ⁿd", "T")):
        assert any(part in ipa and kind in classes for ipa, classes in found.items())
    assert any("tʃ" in ipa and "t͡ʃ" not in ipa for ipa in found)
    assert any("ß" in r.concept for r in queries.QUERIES["c05_suggest"](spark, LARGER).select("concept").collect())
