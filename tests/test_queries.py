"""Every registered query against its SQL in DuckDB, at the smallest size."""

from __future__ import annotations

import os

import duckdb
import pytest

from strandline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(rows):
    return sorted((tuple(None if v is None else round(v, 4) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert plain(map(tuple, df.collect())) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ranker_gradients_hold_no_date(spark):
    """A date's list streams through its task; as a group it would be held whole, with 256 rows of pairs for each of its rows."""
    plan = catalog.QUERIES["ranker_gradients"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 2
