"""The corpus queries that have oracle SQL against DuckDB on the whole small tables."""

import math

import duckdb
import pytest

from packetloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    theirs = {d[0]: k for k, d in enumerate(found.description)}
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(theirs)
    order = sorted(df.columns)
    text = lambda x: f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)
    mine = sorted([text(r[c]) for c in order] for r in df.collect())
    assert mine == sorted([text(r[theirs[c]]) for c in order] for r in found.fetchall())
