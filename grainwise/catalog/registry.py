"""Registry of runnable queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same question for a plain SQL engine."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _nudge(places: int) -> float:
    """A hundredth of the last kept digit.

    Averages of two-decimal amounts often end in an exact 5. Added before rounding on both
    sides, this keeps such ties from depending on the order of summation.
    """
    return float(f"1e-{places + 2}")


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round the floating-point columns so that summation order does not show."""
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]

    def shown(name: str):
        digits = special.get(name, places)
        return F.round(F.col(name).cast("double") + F.lit(_nudge(digits)), digits) + F.lit(0.0)

    return df.withColumns({name: shown(name) for name in fractional})


def r(expression: str, alias: str, places: int = 6) -> str:
    """The same rounding for the SQL side."""
    return f"round(CAST({expression} AS DOUBLE) + CAST({_nudge(places)!r} AS DOUBLE), {places}) + 0.0 AS {alias}"
