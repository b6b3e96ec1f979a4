"""Every registered query on the smallest tables, beside its SQL check."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from profilekit.plans.role_views import TABLES

CHECKS = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(norm(i) for i in x)
    return x


def rows(records, columns):
    return sorted((tuple(norm(r[c]) for c in columns) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_sql(name, spark, sf, duck):
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = rows((dict(zip(names, r)) for r in result.fetchall()), columns)
    assert rows(df.collect(), columns) == expected


@pytest.mark.parametrize("name", sorted(set(queries()) - set(CHECKS)))
def test_runs(name, spark, sf):
    assert queries()[name](spark, sf).count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
