"""Exact ranks from mergeable quantile sketches.

A sketch per group, merged from the tasks' own ones, says between which two values a wanted
rank lies. A second scan then counts the rows between neighbouring bounds, and keeps values
only inside the brackets: a few in a thousand rows per rank, merged by value in the task
that reads them. What is exchanged are sketches, counts and those values, never the column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.plans.scratch import join_on_keys, materialize

ROWS_KEY = "spark.grainwise.sketchRows"
#: Rows from which on a group is worth a sketch, and the most groups that get one.
ROWS_DEFAULT, MOST_GROUPS = 1_000_000, 10_000
#: Items a sketch keeps per level; its ranks are off by about 0.07 % at most, and a bracket reaches a few times as far.
SKETCH_ITEMS, REACH = 4096, 0.003
#: In smaller groups all rows lie in the brackets.
FEW = 4000


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(groups, rows of the largest); one partially aggregated pass over the keys only."""
    if not keys:
        n = df.count()
        return min(n, 1), n
    found = df.groupBy(*keys).count().agg(F.count(F.lit(1)).alias("groups"), F.max("count").alias("most")).first()
    return found.groups, found.most or 0


def worth_sketching(df: DataFrame, groups: int, largest: int) -> bool:
    return largest > int(df.sparkSession.conf.get(ROWS_KEY, str(ROWS_DEFAULT))) and groups <= MOST_GROUPS


def brackets(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, low, high of each probability): values below and above its ranks.

    Groups that are too small for a bracket narrower than all of their rows are bracketed by
    their least and greatest value.
    """
    v = F.col(value).cast("double")
    made = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max"), F.kll_sketch_agg_double(v, SKETCH_ITEMS).alias("__sketch"))

    def edge(p: float, outer: bool, end: str):
        if outer:
            return F.col(end)
        return F.when(F.col("__n") <= FEW, F.col(end)).otherwise(F.kll_sketch_get_quantile_double("__sketch", F.lit(p)))

    lows = [edge(p - REACH, p <= REACH, "__min").alias(f"__low{i}") for i, p in enumerate(probs)]
    highs = [edge(p + REACH, p >= 1 - REACH, "__max").alias(f"__high{i}") for i, p in enumerate(probs)]
    return made.select(*keys, *lows, *highs)


def cell_counts(df: DataFrame, keys: Sequence[str], value: str, ranks: int, bounds: DataFrame) -> DataFrame:
    """(keys, __cell, __out, value, __c): rows by the number of bounds at or below them; their value only inside a bracket.

    In order of (__cell, __out, value) the rows of a group are in order of their values.
    """
    v = F.col(value).cast("double")
    names = [(f"__low{i}", f"__high{i}") for i in range(ranks)]
    if keys:
        # at most MOST_GROUPS rows of two numbers a rank
        joined = join_on_keys(df, F.broadcast(bounds), keys)
        pairs = [(F.col(a), F.col(b)) for a, b in names]
    else:
        row = bounds.first()
        joined, pairs = df, [(F.lit(row[a]), F.lit(row[b])) for a, b in names]
    inside, cell = F.lit(False), F.lit(0)
    for a, b in pairs:
        inside = inside | ((v >= a) & (v <= b))
        cell = cell + (a <= v).cast("int") + (b <= v).cast("int")
    placed = joined.select(*keys, cell.alias("__cell"), (~inside).cast("int").alias("__out"), F.when(inside, F.col(value)).alias(value))
    return placed.groupBy(*keys, "__cell", "__out", value).agg(F.count(F.lit(1)).alias("__c"))


def sketched_counts(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """``cell_counts`` of the brackets of ``probs``, written once; ``df`` has no missing values."""
    bounds = materialize(brackets(df, keys, value, probs))
    return materialize(cell_counts(df, keys, value, len(probs), bounds))


def distinct_counts(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Different values per group; equal ones are merged before they move."""
    return df.groupBy(*keys, value).agg(F.lit(1).alias("__one")).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def missed(picked: DataFrame, names: Sequence[str]) -> bool:
    """True if a rank fell outside its bracket, for which the sketch leaves a small chance."""
    any_null = F.lit(False)
    for name in names:
        any_null = any_null | F.col(name).isNull()
    return bool(picked.where(any_null).head(1))
