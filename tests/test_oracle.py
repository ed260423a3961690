"""Every query that SQL can express against DuckDB, on the smallest tables."""

import duckdb
import pytest

from tests.conftest import DATA
from wordloom import queries
from wordloom.sources import lexicon
from wordloom.storage import materialise

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def stored_lexicon(spark):
    """The lexicon and its word counts are derived once and stored: deriving them is most of a query's time on tables this small."""
    patch = pytest.MonkeyPatch()
    for name in ("words", "entries"):
        made = materialise(getattr(lexicon, name)(spark, SMALL))
        patch.setattr(lexicon, name, lambda spark, sf_dir, made=made: made)
    yield
    patch.undo()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    told = duck.execute(queries.SQL[name])
    where = {d[0]: i for i, d in enumerate(told.description)}
    assert sorted(where) == columns
    want = sorted((tuple(plain(r[where[c]]) for c in columns) for r in told.fetchall()), key=repr)
    assert got == want and want
