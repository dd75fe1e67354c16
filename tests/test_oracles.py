"""Every query that has SQL, compared with DuckDB over the smallest tables."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")

from cohortloom.plans import quality, relational  # noqa: E402

QUERIES, ORACLES = quality.QUERIES | relational.QUERIES, quality.ORACLES | relational.ORACLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def _plain(x):
    if x is None or x != x:
        return "NULL"
    return f"{x:.9g}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(_plain(r[i]) for i in order) for r in want.fetchall())


def test_names_have_queries():
    assert set(ORACLES) <= set(QUERIES)
