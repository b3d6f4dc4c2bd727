"""Every registered query against its SQL on the smallest test tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from siteloom import catalog  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
entry.queries()
# the library's own; the training-data operators have tests of their own
QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 6) + 0.0)
    return value if value is None or isinstance(value, (bool, int)) else str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    order = lambda r: [(v is None, str(v)) for v in r]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=order)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
