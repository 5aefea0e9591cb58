"""Every registered query against its reference SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# The training-data queries have their own tests beside their operators.
QUERIES = {name: fn for name, fn in entry.queries().items() if fn.__module__.startswith("grainwise.catalog")}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def small_bound(spark):
    """Groups above 100 rows take the distributed path, smaller ones the plain one."""
    spark.conf.set("spark.grainwise.maxGroupRows", "100")
    yield
    spark.conf.set("spark.grainwise.maxGroupRows", "1000000")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        problem, _ = compare(df, tables, ORACLES[name])
        assert problem is None
    else:
        assert df.count() > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == entry.entry(spark).columns and df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_sources_carry_no_limits_that_shrink_the_tables():
    import inspect

    for fn in QUERIES.values():
        assert ".limit(" not in inspect.getsource(fn)
