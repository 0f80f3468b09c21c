"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from ampflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is None, str(x) if not isinstance(x, float) else f"{x:.4f}") for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    out = con.execute(registry.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, rel=1e-9, abs=2e-6) if all(isinstance(x, (int, float)) for x in a) else all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6) for x, y in zip(a, b))


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0
