"""Every registered query of the core gives the rows of its SQL."""

import datetime

import duckdb
import pytest

from gridlark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return str(v)[:19]
    if isinstance(v, datetime.date):
        return f"{v} 00:00:00"
    return v


def key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (False, "float", round(v, 2)) for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_equal_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    cursor = db.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert (abs(x - y) < 2e-4 if isinstance(x, float) and isinstance(y, float) else x == y), (a, b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_have_rows(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 83
    assert set(e.oracle_sql()) <= set(e.queries())
