"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from cuegrain.plans import audio_queries, captions_queries, timeline_queries, words_queries

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = {}, {}
for module in (words_queries, captions_queries, timeline_queries, audio_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 5) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 5)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)) if isinstance(v, str) else "n", v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = ordered([tuple(plain(r[i]) for i in at) for r in found.fetchall()])
    assert ordered([tuple(map(plain, r)) for r in df.select(*columns).collect()]) == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).limit(1).count() == 1


def test_entry_module_lists_them():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
