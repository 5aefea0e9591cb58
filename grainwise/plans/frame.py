"""Lazy wrapper around one long-format table: ordered keys, one metric, one time column."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.plans.ordering import pick_by_hash
from grainwise.plans.scratch import join_on_keys

log = logging.getLogger(__name__)

SORT_COLUMNS = {
    "total": "total_cost",
    "mean": "mean_cost",
    "median": "median_cost",
    "volatility": "std_cost",
}


class GrainError(ValueError):
    """Columns, grain or bounds do not fit the frame."""


def time_literal(data_type: T.DataType, value: Any) -> Column:
    """Literal of the time column's own type, checked before any job runs.

    A typed literal keeps the comparison free of casts, so it reaches the scan.
    """
    if isinstance(data_type, T.StringType):
        return F.lit(str(value))
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if not isinstance(value, (date, datetime)):
            try:
                value = datetime.fromisoformat(str(value))
            except ValueError as error:
                raise GrainError(f"'{value}' is not an ISO date or timestamp") from error
        if isinstance(data_type, T.DateType):
            midnight = value.date() if isinstance(value, datetime) else value
            if isinstance(value, datetime) and value != datetime.combine(midnight, datetime.min.time()):
                return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
            return F.lit(midnight)
        return F.lit(value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()).cast(
            data_type
        )
    return F.lit(value).cast(data_type)


@dataclass(frozen=True)
class GrainFrame:
    """Hierarchical time series over a DataFrame. Every method returns a new lazy frame."""

    df: DataFrame
    hierarchy: tuple[str, ...]
    metric_col: str = "cost"
    time_col: str = "date"

    def __post_init__(self) -> None:
        object.__setattr__(self, "hierarchy", tuple(self.hierarchy))
        known = set(self.df.columns)
        roles = [("time_col", self.time_col), ("metric_col", self.metric_col)]
        roles += [("hierarchy column", key) for key in self.hierarchy]
        for role, name in roles:
            if name not in known:
                raise GrainError(f"{role} '{name}' not found in columns {sorted(known)}")

    @classmethod
    def from_dataframe(
        cls, df: DataFrame, hierarchy: Sequence[str], metric_col: str = "cost", time_col: str = "date"
    ) -> GrainFrame:
        return cls(df, tuple(hierarchy), metric_col, time_col)

    # -- shape ---------------------------------------------------------------------

    def resolve_grain(self, grain: Sequence[str]) -> list[str]:
        """Check that the grain is a subset of the hierarchy; return it in that order."""
        unknown = sorted(set(grain) - set(self.hierarchy))
        if unknown:
            raise GrainError(f"Invalid grain columns {unknown}: not in hierarchy {list(self.hierarchy)}")
        return [key for key in self.hierarchy if key in set(grain)]

    def with_df(self, df: DataFrame) -> GrainFrame:
        return replace(self, df=df)

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def entities(self, grain: Sequence[str] | None = None) -> DataFrame:
        """Distinct key tuples at the grain; a NULL key is a key of its own."""
        keys = self.resolve_grain(grain if grain is not None else self.hierarchy)
        return self.df.select(*keys).distinct()

    # -- filters -------------------------------------------------------------------

    def filter(self, **entity_keys: Any) -> GrainFrame:
        """Rows whose hierarchy columns equal the given values."""
        unknown = sorted(set(entity_keys) - set(self.hierarchy))
        if unknown:
            raise GrainError(f"Invalid filter columns {unknown}: not in hierarchy {list(self.hierarchy)}")
        tests = [F.col(key) == F.lit(value) for key, value in entity_keys.items()]
        return self.with_df(self.df.where(reduce(Column.__and__, tests))) if tests else self

    def filter_time(
        self, start: Any = None, end: Any = None, after: Any = None, before: Any = None
    ) -> GrainFrame:
        """Half-open time range: ``start``/``after`` inclusive, ``end``/``before`` exclusive."""
        kind, column = self.df.schema[self.time_col].dataType, F.col(self.time_col)
        tests = [column >= time_literal(kind, v) for v in (start, after) if v is not None]
        tests += [column < time_literal(kind, v) for v in (end, before) if v is not None]
        return self.with_df(self.df.where(reduce(Column.__and__, tests))) if tests else self

    def split_at(self, when: Any) -> tuple[GrainFrame, GrainFrame]:
        """Rows before the instant, and rows from it on."""
        return self.filter_time(before=when), self.filter_time(start=when)

    def restrict_to(self, entities: DataFrame) -> GrainFrame:
        """Keep the rows of the given entities (semi-join on the shared hierarchy columns)."""
        keys = [key for key in self.hierarchy if key in entities.columns]
        return self.with_df(join_on_keys(self.df, entities.select(*keys), keys, "left_semi"))

    def sample(self, grain: Sequence[str], n: int = 1, seed: int = 42) -> GrainFrame:
        """Whole series of ``n`` entities picked uniformly, repeatable for a seed.

        Asking for more entities than exist returns all of them. The pick goes by hashed
        keys, so no full sort of the entities takes place.
        """
        keys = self.resolve_grain(grain)
        picked = pick_by_hash(self.entities(keys), keys, n, seed)
        return self.with_df(join_on_keys(self.df, picked, keys, "left_semi"))

    # -- roll-ups ------------------------------------------------------------------

    def aggregate(self, grain: Sequence[str], assume_unique: bool = False) -> GrainFrame:
        """Sum the metric by grain and time; the grain becomes the new hierarchy.

        ``assume_unique`` skips the summing when the frame already is at this grain.
        """
        keys = self.resolve_grain(grain)
        if assume_unique and keys == list(self.hierarchy):
            return self
        summed = self.df.groupBy(*keys, self.time_col).agg(F.sum(self.metric_col).alias(self.metric_col))
        return replace(self, df=summed, hierarchy=tuple(keys))

    def aggregate_many(self, grains: Sequence[Sequence[str]]) -> DataFrame:
        """Several roll-ups in one pass over the data, told apart by ``grain``.

        Keys that are not part of a row's grain are NULL.
        """
        resolved = [self.resolve_grain(grain) for grain in grains]
        used = [key for key in self.hierarchy if any(key in grain for grain in resolved)]
        sets = [[*grain, self.time_col] for grain in resolved]
        grouped = self.df.groupingSets(sets, *used, self.time_col).agg(
            F.sum(self.metric_col).alias(self.metric_col), F.grouping_id().alias("__gid")
        )
        return grouped.withColumn("grain", grain_label(used, resolved, trailing=1)).drop("__gid")

    def summary_stats(self, grain: Sequence[str] | None = None) -> DataFrame:
        """count, mean, sample std, min and max of the metric over time, per entity."""
        at = self if grain is None else self.aggregate(grain)
        metric = F.col(self.metric_col)
        return at.df.groupBy(*at.hierarchy).agg(
            F.count(metric).alias("count"),
            F.mean(metric).alias("mean"),
            F.stddev(metric).alias("std"),
            F.min(metric).alias("min"),
            F.max(metric).alias("max"),
        )

    def _grain_costs(self, grain: Sequence[str], exact: bool) -> DataFrame:
        at = self.aggregate(grain)
        metric = F.col(self.metric_col)
        # One row per entity and date at this point, so a group is as long as the calendar.
        median = F.percentile(metric, 0.5) if exact else F.percentile_approx(metric, 0.5)
        return at.df.groupBy(*at.hierarchy).agg(
            F.sum(metric).alias("total_cost"),
            F.mean(metric).alias("mean_cost"),
            median.alias("median_cost"),
            F.stddev(metric).alias("std_cost"),
            F.min(metric).alias("min_cost"),
            F.max(metric).alias("max_cost"),
            F.count(metric).alias("days"),
        )

    def cost_summary_by_grain(
        self, grain: Sequence[str], sort_by: str = "total", exact: bool = False
    ) -> DataFrame:
        """Total, mean, median, std, min, max and days per entity, sorted descending.

        ``sort_by`` is total, mean, median or volatility; anything else sorts by total.
        """
        keys = self.resolve_grain(grain)
        by = SORT_COLUMNS.get(sort_by, "total_cost")
        return self._grain_costs(keys, exact).orderBy(F.desc(by), *keys)

    def top_entities(self, grain: Sequence[str], n: int = 10, sort_by: str = "total") -> DataFrame:
        """The first ``n`` rows of the cost summary, ties broken by key."""
        return self.cost_summary_by_grain(grain, sort_by).limit(n)

    # -- tables behind the usual cost figures ---------------------------------------

    def daily_box_stats(
        self, grain: Sequence[str], top_n: int = 10, sort_by: str = "total", min_cost: float = 0.0
    ) -> DataFrame:
        """Box-plot table of the daily metric for the top entities.

        Whiskers end at the outermost value within 1.5 IQR of the box.
        """
        keys = self.resolve_grain(grain)
        at = self.aggregate(keys)
        daily = at.restrict_to(self.top_entities(keys, top_n, sort_by)).df
        if min_cost > 0:
            daily = daily.where(F.col(self.metric_col) >= min_cost)
        metric = F.col(self.metric_col)
        per = Window.partitionBy(*keys)
        # Bounded groups: top_n entities with one row per date.
        boxed = daily.withColumns(
            {
                "q1": F.percentile(metric, 0.25).over(per),
                "median": F.percentile(metric, 0.5).over(per),
                "q3": F.percentile(metric, 0.75).over(per),
            }
        )
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        inside = metric.between(F.col("q1") - reach, F.col("q3") + reach)
        return boxed.groupBy(*keys).agg(
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, metric)).alias("whisker_low"),
            F.max(F.when(inside, metric)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
            F.count(metric).alias("days"),
        )

    def cost_trends(self, grain: Sequence[str], top_n: int = 5, sort_by: str = "total") -> DataFrame:
        """Daily metric of the top entities plus the overall total per date.

        ``is_total`` marks the total rows, whose keys are NULL.
        """
        keys = self.resolve_grain(grain)
        top = self.top_entities(keys, top_n, sort_by)
        lines = self.aggregate(keys).restrict_to(top).df.withColumn("is_total", F.lit(False))
        total = (
            self.df.groupBy(self.time_col)
            .agg(F.sum(self.metric_col).alias(self.metric_col))
            .withColumns({key: F.lit(None).cast(self.df.schema[key].dataType) for key in keys})
            .withColumn("is_total", F.lit(True))
        )
        return lines.unionByName(total)

    def treemap(self, levels: Sequence[str], top_n: int = 50) -> DataFrame:
        """Metric by hierarchy level for the ``top_n`` leaves, with share of the parent."""
        keys = self.resolve_grain(levels)
        leaves = (
            self.df.groupBy(*keys)
            .agg(F.sum(self.metric_col).alias("__leaf"))
            .orderBy(F.desc("__leaf"), *keys)
            .limit(top_n)
        )
        nodes = leaves.rollup(*keys).agg(F.sum("__leaf").alias("total_cost"), F.grouping_id().alias("__gid"))
        width = len(keys)
        depth = F.lit(width) - F.bit_count("__gid")
        nodes = nodes.withColumn("depth", depth.cast("int"))
        # A node's siblings agree on depth and on every key above it; at most top_n rows per level.
        above = [F.when(F.col("depth") > i + 1, F.col(key)) for i, key in enumerate(keys[:-1])]
        parent = Window.partitionBy("depth", *above)
        return nodes.withColumn(
            "pct_of_parent", F.try_divide("total_cost", F.sum("total_cost").over(parent)) * 100
        ).drop("__gid")

    def density_by_grain(self, grains: Mapping[str, Sequence[str]]) -> DataFrame:
        """Active entities per time for several grains, with the change to the day before."""
        resolved = {name: self.resolve_grain(cols) for name, cols in grains.items()}
        used = [key for key in self.hierarchy if any(key in cols for cols in resolved.values())]
        sets = [[*cols, self.time_col] for cols in resolved.values()]
        keys = self.df.select(*used, self.time_col)
        active = keys.groupingSets(sets, *used, self.time_col).agg(F.grouping_id().alias("__gid"))
        active = active.withColumn(
            "grain", grain_label(used, list(resolved.values()), trailing=1, names=list(resolved))
        )
        counts = active.groupBy("grain", self.time_col).agg(F.count(F.lit(1)).alias("entities"))
        # One row per grain and date: as long as the calendar.
        before = F.lag("entities").over(Window.partitionBy("grain").orderBy(self.time_col))
        return counts.withColumn("change", F.try_divide(F.col("entities") - before, before))


def grain_label(
    used: Sequence[str],
    grains: Sequence[Sequence[str]],
    trailing: int = 0,
    names: Sequence[str] | None = None,
) -> Column:
    """Map ``grouping_id()`` back to a grain name.

    A set bit means the key was rolled away; ``trailing`` is the number of grouping
    columns after the keys that belong to every set.
    """
    label: Column | None = None
    for i, grain in enumerate(grains):
        bits = sum(1 << (len(used) - 1 - j + trailing) for j, key in enumerate(used) if key not in grain)
        name = names[i] if names else " > ".join(grain)
        test = F.col("__gid") == bits
        label = F.when(test, name) if label is None else label.when(test, name)
    return label
