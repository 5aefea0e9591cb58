"""The registered queries: those with SQL against it, all of them for their contract's columns."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

from grainwise.llm.queries import ORACLES, QUERIES  # noqa: E402

FIRST = {
    "op4": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7": ["doc_id", "n_shingles", "component_id"],
    "op8": ["doc_id", "held_out", "lang_pred", "score"],
    "op9": ["query_id", "rank", "vec_id", "score"],
    "op10": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op12": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    problem, rows = compare(QUERIES[name](spark, sf), con, ORACLES[name])
    assert problem is None and rows > 0


def test_one_query_for_each_operator_and_the_pipeline():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("number", ["op8", "op10", "op12"])
def test_columns_of_the_contract(spark, sf, number):
    name = next(n for n in QUERIES if n.startswith(f"{number}_"))
    assert set(FIRST[number]) <= set(QUERIES[name](spark, sf).columns)
