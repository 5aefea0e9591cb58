"""Closures for ``DataFrame.transform``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.functions import utilisation as U
from grainwise.plans.ordering import ordered_windows

Transform = Callable[[DataFrame], DataFrame]


def _listed(columns: str | Sequence[str] | None) -> list[str]:
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def pct_change(
    value_col: str,
    order_col: str | Sequence[str],
    group_cols: str | Sequence[str] | None = None,
    output_col: str = "pct_change",
    calendar: bool = False,
) -> Transform:
    """Relative change to the row before, as a fraction.

    The first row, a NULL on either side and a zero previous value all give NULL.
    ``calendar=True`` states that a group holds at most one row per date, as after a
    roll-up, and allows a plain window. Otherwise long series are computed in blocks.
    """
    order, keys = _listed(order_col), _listed(group_cols)

    def change(spec) -> Mapping[str, Column]:
        previous = F.lag(value_col).over(spec)
        return {output_col: F.try_divide(F.col(value_col) - previous, previous)}

    def apply(df: DataFrame) -> DataFrame:
        if calendar:
            return df.withColumns(dict(change(Window.partitionBy(*keys).orderBy(*order))))
        return ordered_windows(df, keys, order, change, before=1)

    return apply


def summary_stats(
    value_col: str, group_col: str | Sequence[str], names: Mapping[str, str] | None = None
) -> Transform:
    """count, mean, stddev, min and max of a value by group; ``names`` renames the outputs."""
    names = dict(names or {})
    functions = {"count": F.count, "mean": F.mean, "stddev": F.stddev, "min": F.min, "max": F.max}

    def apply(df: DataFrame) -> DataFrame:
        return df.groupBy(*_listed(group_col)).agg(
            *(fn(value_col).alias(names.get(stat, stat)) for stat, fn in functions.items())
        )

    return apply


def with_unit_costs() -> Transform:
    return lambda df: df.withColumns(
        {
            "cost_per_cpu": U.cost_per_cpu(),
            "cost_per_gb": U.cost_per_gb(),
            "efficiency_score": U.mean_utilisation(),
        }
    )


def with_waste_flags(waste_factors: Mapping[str, float] | None = None) -> Transform:
    """Idle and over-provisioned flags, both waste measures, optionally the efficiency score."""

    def apply(df: DataFrame) -> DataFrame:
        columns = {
            "is_idle": U.is_idle(),
            "is_overprovisioned": U.is_overprovisioned(),
            "waste_percentage": U.waste_with_headroom(),
            "waste_linear": U.waste_linear(),
        }
        if waste_factors is not None:
            columns["efficiency_score"] = U.efficiency_score(U.lookup("workload_type", waste_factors, 0.0))
        return df.withColumns(columns)

    return apply


def rolling_overprovisioned(
    keys: Sequence[str] = ("resource_id",), order: Sequence[str] = ("timestamp",), window: int = 20
) -> Transform:
    """Over-provisioned by the centred rolling mean; edges count as zero.

    The frame starts ``window // 2`` rows back and always divides by ``window``.
    """
    back = window // 2
    ahead = window - back - 1

    def flags(spec) -> Mapping[str, Column]:
        frame = spec.rowsBetween(-back, ahead)
        cpu = F.sum("cpu_utilization").over(frame) / float(window)
        memory = F.sum("memory_utilization").over(frame) / float(window)
        return {"cpu_smooth": cpu, "memory_smooth": memory, "is_overprovisioned": U.is_overprovisioned(cpu, memory)}

    return lambda df: ordered_windows(df, list(keys), list(order), flags, before=back, after=ahead)


def day_over_day(
    date_col: str, metric_col: str | None = None, threshold: float = 0.3, calendar: bool = True
) -> Transform:
    """Daily count (or sum), its relative change and a flag; the first day is left out."""

    def apply(df: DataFrame) -> DataFrame:
        daily = daily_totals(date_col, metric_col)(df)
        changed = daily.transform(pct_change("value", date_col, output_col="change", calendar=calendar))
        return changed.where(F.col("change").isNotNull()).withColumn("flagged", F.abs("change") >= threshold)

    return apply


def daily_totals(date_col: str, metric_col: str | None = None) -> Transform:
    """Row count, or metric sum, per date."""
    value = F.count(F.lit(1)) if metric_col is None else F.sum(metric_col)
    return lambda df: df.groupBy(date_col).agg(value.alias("value"))


def largest_drops(change_col: str, n: int = 5) -> Transform:
    """The most negative changes; rows without a change are excluded."""
    return lambda df: df.where(F.col(change_col).isNotNull()).orderBy(change_col, *_others(df, change_col)).limit(n)


def _others(df: DataFrame, column: str) -> list[str]:
    return [c for c in df.columns if c != column]


def before_cutoff(daily: DataFrame, date_col: str, change_col: str, threshold: float = -0.30) -> Transform:
    """Rows before the earliest date whose change falls below the threshold.

    Everything is kept when no such date exists. The cut-off stays inside the plan as a
    scalar subquery.
    """
    first = daily.where(F.col(change_col) < threshold).agg(F.min(date_col).alias("cutoff"))

    def apply(df: DataFrame) -> DataFrame:
        cutoff = first.scalar()
        return df.where(cutoff.isNull() | (F.col(date_col) < cutoff))

    return apply


def minmax_scaled(train: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> Transform:
    """Min-max scaling fitted on ``train`` and applied to another frame."""
    fitted = train.agg(
        F.struct(
            *(F.min(c).alias(f"{c}_lo") for c in columns), *(F.max(c).alias(f"{c}_hi") for c in columns)
        ).alias("fit")
    )

    def apply(df: DataFrame) -> DataFrame:
        fit = fitted.scalar()
        scaled = {}
        for c in columns:
            low, high = fit.getField(f"{c}_lo"), fit.getField(f"{c}_hi")
            scaled[f"{c}{suffix}"] = F.try_divide(F.col(c) - low, high - low)
        return df.withColumns(scaled)

    return apply


def calendar_features(time_col: str) -> Transform:
    """Fourier features of the hour (4 terms) and of the weekday (2 terms, Monday is 0)."""

    def apply(df: DataFrame) -> DataFrame:
        hour, weekday = F.hour(time_col).cast("double"), F.weekday(time_col).cast("double")
        return df.withColumns(
            {**U.fourier_terms(hour, 24.0, 4, "hour"), **U.fourier_terms(weekday, 7.0, 2, "weekday")}
        )

    return apply


def without_anomalies(label_col: str = "is_anomaly") -> Transform:
    """Clean training rows: everything not labelled as an anomaly."""
    return lambda df: df.where(~F.col(label_col))
