"""Every registered query against its oracle SQL in DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import packetloom.catalog as catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, dict):
        return str(sorted(value.items()))
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted([plain(r[k]) for k in order] for r in rows)


def same(spark_df, found):
    mine = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = table([d[0] for d in found.description], found.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1]), (len(mine[1]), len(theirs[1]))
    for a, b in zip(mine[1], theirs[1]):
        assert a == b


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, oracle, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert name in catalog.oracle_sql()
    same(df, oracle.execute(catalog.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
