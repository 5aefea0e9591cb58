"""Fleet economics: unit costs, waste, recommendations, utilisation profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import utilisation as U
from grainwise.functions.stats import pearson
from grainwise.operators.profile import correlations_of
from grainwise.plans.ordering import ordered_windows


# Last hour and name of the periods of a day.
DAY_PERIODS = (
    (5, "Night - Minimal activity"),
    (8, "Morning ramp-up"),
    (11, "Peak morning activity"),
    (13, "Lunch dip"),
    (16, "Afternoon peak"),
    (18, "End of day wind-down"),
    (23, "Evening - Reduced activity"),
)


def unit_economics(df: DataFrame) -> dict[str, DataFrame]:
    """Cost per customer, team and environment over time, and waste by resource type.

    A table is present only when its tag column is; a NULL tag is a group.
    """
    cost, resources = F.sum("hourly_cost"), F.count_distinct("resource_id")
    tables: dict[str, DataFrame] = {}
    if "tag_customer_id" in df.columns:
        tables["cost_per_customer"] = df.groupBy("tag_customer_id", "timestamp").agg(
            cost.alias("total_cost"),
            resources.alias("resource_count"),
            F.avg("cpu_utilization").alias("avg_cpu_utilization"),
            F.avg("memory_utilization").alias("avg_memory_utilization"),
        )
    if "tag_team" in df.columns:
        tables["cost_per_team"] = df.groupBy("tag_team", "timestamp").agg(
            cost.alias("total_cost"), resources.alias("resource_count")
        )
    if "tag_environment" in df.columns:
        tables["cost_per_environment"] = df.groupBy("tag_environment", "timestamp").agg(
            cost.alias("total_cost"), F.avg("efficiency_score").alias("avg_efficiency")
        )
    tables["waste_analysis"] = waste_analysis(df)
    return tables


def waste_analysis(df: DataFrame, type_col: str = "resource_type") -> DataFrame:
    """Cost and resources of rows with low cpu and low memory, by resource type."""
    return (
        df.where(U.is_overprovisioned())
        .groupBy(type_col)
        .agg(
            F.sum("hourly_cost").alias("wasted_cost"),
            F.count_distinct("resource_id").alias("wasted_resources"),
        )
    )


def wasted_share(df: DataFrame) -> DataFrame:
    """Wasted, total and share of cost; one row."""
    wasted = F.coalesce(F.sum(F.when(U.is_overprovisioned(), F.col("hourly_cost"))), F.lit(0.0))
    return df.agg(wasted.alias("wasted_cost"), F.sum("hourly_cost").alias("total_cost")).withColumn(
        "wasted_pct", F.try_divide("wasted_cost", "total_cost") * 100
    )


def fleet_waste(df: DataFrame, archetype_col: str | None = "archetype") -> DataFrame:
    """Average utilisation and waste overall and by archetype, in one roll-up.

    The overall row has ``is_total`` set and no archetype.
    """
    aggregates: list[Column] = [
        F.avg("cpu_utilization").alias("avg_cpu_utilization"),
        F.avg("memory_utilization").alias("avg_memory_utilization"),
    ]
    if "hourly_cost" in df.columns:
        aggregates.append(F.sum("hourly_cost").alias("total_cost"))
    if archetype_col and archetype_col in df.columns:
        summary = df.rollup(archetype_col).agg(*aggregates, (F.grouping(archetype_col) == 1).alias("is_total"))
    else:
        summary = df.agg(*aggregates).withColumn("is_total", F.lit(True))
    cpu_waste = (100 - F.col("avg_cpu_utilization")) * 0.7
    memory_waste = (100 - F.col("avg_memory_utilization")) * 0.5
    out = summary.withColumns(
        {
            "cpu_waste_percentage": cpu_waste,
            "memory_waste_percentage": memory_waste,
            "total_waste_percentage": (cpu_waste + memory_waste) / 2,
        }
    )
    if "total_cost" in out.columns:
        savings = F.col("total_cost") * F.col("total_waste_percentage") / 100
        return out.withColumn("optimization_potential", F.try_divide(savings, "total_cost") * 100)
    return out.withColumn("optimization_potential", F.col("total_waste_percentage"))


def cost_optimization(df: DataFrame) -> DataFrame:
    """Recommendations, potential savings and score per resource."""
    per = df.groupBy("resource_id").agg(
        F.avg("cpu_utilization").alias("avg_cpu"),
        F.avg("memory_utilization").alias("avg_memory"),
        F.avg("hourly_cost").alias("avg_cost"),
        F.avg("waste_percentage").alias("avg_waste"),
        F.avg("efficiency_score").alias("avg_efficiency"),
        F.try_divide(F.count_if("is_idle"), F.count(F.lit(1))).alias("idle_ratio"),
    )
    rules = {
        "shutdown_when_idle": (F.col("idle_ratio") > 0.3, F.col("idle_ratio")),
        "rightsize_instance": (U.is_overprovisioned("avg_cpu", "avg_memory"), F.lit(0.3)),
        "optimize_workload": (F.col("avg_efficiency") < 40, F.lit(0.2)),
    }
    named = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, (test, _) in rules.items())))
    saved = sum((F.when(test, F.col("avg_cost") * part).otherwise(0.0) for test, part in rules.values()), F.lit(0.0))
    return per.withColumns({"recommendations": named, "potential_savings": saved}).withColumn(
        "optimization_score",
        F.least(F.lit(100.0), F.try_divide("potential_savings", "avg_cost") * 100),
    )


def savings_strategy(df: DataFrame, workload_col: str = "workload_type") -> DataFrame:
    """Savings potential and strategy per workload from average cpu and waste."""
    per = df.groupBy(workload_col).agg(
        F.avg("cpu_utilization").alias("avg_cpu"),
        F.avg("memory_utilization").alias("avg_memory"),
        F.avg("waste_percentage").alias("current_waste"),
    )
    # The order, shares and names of the strategies.
    rules = (
        (F.col("avg_cpu") < 20, 0.7, "Aggressive auto-scaling or serverless"),
        (F.col("current_waste") > 50, 0.6, "Right-sizing and scheduling"),
        (F.col(workload_col).contains("database"), 0.4, "Reserved instances and caching"),
        (F.lit(True), 0.5, "Standard auto-scaling"),
    )
    picks = [F.when(test, F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"))) for test, part, name in rules]
    chosen = F.coalesce(*picks)
    return per.select(
        workload_col,
        "avg_cpu",
        "avg_memory",
        "current_waste",
        (F.col("current_waste") * chosen.getField("part")).alias("potential_savings"),
        chosen.getField("name").alias("optimization_strategy"),
    )


def workload_statistics(df: DataFrame, workload_col: str = "workload_type") -> DataFrame:
    return df.groupBy(workload_col).agg(
        F.avg("cpu_utilization").alias("avg_cpu"),
        F.avg("memory_utilization").alias("avg_memory"),
        F.avg("waste_percentage").alias("avg_waste"),
        F.avg("efficiency_score").alias("avg_efficiency"),
        F.count_if("is_idle").alias("idle_count"),
        F.count_if("is_overprovisioned").alias("overprovisioned_count"),
    )


def hour_of_day_profile(df: DataFrame, time_col: str, columns: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean metrics by hour of day with the period of the day."""
    hour = F.hour(time_col)
    period: Column | None = None
    for last_hour, name in DAY_PERIODS:
        period = F.when(hour <= last_hour, name) if period is None else period.when(hour <= last_hour, name)
    return df.groupBy(*group_cols, hour.alias("hour"), period.alias("period")).agg(
        *(F.avg(c).alias(f"mean_{c}") for c in columns), F.count(F.lit(1)).alias("rows")
    )


def weekday_profile(df: DataFrame, time_col: str, columns: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean metrics by weekday; Monday is 0."""
    weekday = F.weekday(time_col)
    return df.groupBy(*group_cols, weekday.alias("weekday"), (weekday >= 5).alias("is_weekend")).agg(
        *(F.avg(c).alias(f"mean_{c}") for c in columns), F.count(F.lit(1)).alias("rows")
    )


def workload_correlations(df: DataFrame, workload_col: str = "workload_type") -> DataFrame:
    """Correlations of cpu and memory with the traffic metrics that are present."""
    wanted = (
        ("cpu_utilization", "memory_utilization"),
        ("cpu_utilization", "network_in_mbps"),
        ("cpu_utilization", "disk_iops"),
        ("memory_utilization", "network_in_mbps"),
    )
    present = [(a, b) for a, b in wanted if a in df.columns and b in df.columns]
    return correlations_of(df, present, [workload_col])


def workload_signature(
    df: DataFrame,
    workload_col: str = "workload_type",
    keys: Sequence[str] = ("resource_id",),
    order: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """Mean, variance, cpu-memory correlation, lag-1 correlation and waste per workload.

    The lag stays inside a series (workload and keys), the correlation pools them.
    """
    series = [workload_col, *keys]
    lagged = ordered_windows(
        df, series, list(order), lambda spec: {"__before": F.lag("cpu_utilization").over(spec)}, before=1
    )
    return lagged.groupBy(workload_col).agg(
        F.avg("cpu_utilization").alias("mean_cpu"),
        F.var_samp("cpu_utilization").alias("var_cpu"),
        pearson("cpu_utilization", "memory_utilization").alias("cpu_memory_corr"),
        pearson("__before", "cpu_utilization").alias("lag1_corr"),
        (F.avg(U.waste_with_headroom()) / 100).alias("waste_fraction"),
    )
