"""Every catalogue query against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from rolescape.plans import intake, ledgers, walks  # noqa: F401
from rolescape.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime | datetime.date) else v


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df, want = QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert ordered(map(tuple, df.collect()), df.columns) == ordered(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
