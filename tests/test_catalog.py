"""Every registered query runs, and agrees with its SQL where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


def rows(names, values):
    def plain(x):
        if isinstance(x, float):
            return round(x, 5) if math.isfinite(x) else str(x)
        return x

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in order] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in set(QUERIES) - set(SQL) if not k.startswith("op") and k != "pipeline"))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
