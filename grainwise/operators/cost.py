"""Cost over time: daily summaries, quality, distribution, shares, alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.functions.stats import pearson
from grainwise.plans.ordering import exact_percentiles, ordered_windows, prefix_sums, with_position
from grainwise.plans.scratch import join_on_keys

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def temporal_column(df: DataFrame) -> str:
    """The first date or timestamp column."""
    for field in df.schema.fields:
        if isinstance(field.dataType, TEMPORAL):
            return field.name
    raise ValueError("no date or timestamp column found")


def daily_observation_counts(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """Rows per date; the date column is detected when not named."""
    column = date_col or temporal_column(df)
    return df.groupBy(F.col(column).alias("date")).agg(F.count(F.lit(1)).alias("count"))


def temporal_density(df: DataFrame, date_col: str, metric_col: str | None = None) -> DataFrame:
    """Row count, or metric total, per time."""
    value = F.count(F.lit(1)) if metric_col is None else F.sum(metric_col)
    return df.groupBy(date_col).agg(value.alias("value")).orderBy(date_col)


def daily_summary(df: DataFrame, date_col: str = "date", cost_col: str = "cost") -> DataFrame:
    return (
        df.groupBy(date_col)
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.sum(cost_col).alias("total_cost"),
            F.stddev(cost_col).alias("cost_std"),
        )
        .orderBy(date_col)
    )


def time_bucket_counts(df: DataFrame, time_col: str, every: str = "1 day") -> DataFrame:
    """Rows per tumbling time bucket."""
    return (
        df.groupBy(F.window(time_col, every).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("bucket"), "count")
    )


def temporal_quality_metrics(df: DataFrame, date_col: str, metric_col: str) -> DataFrame:
    """Coverage, volume stability and lag-1 autocorrelation of the daily series; one row.

    Only the first step reads the table. What follows works on one row per date.
    """
    daily = df.groupBy(date_col).agg(
        F.count(F.lit(1)).alias("records"), F.sum(metric_col).alias("metric_sum")
    )
    # The time column may hold days or raw instants, so the series is measured, not assumed short.
    before = lambda spec: {"before": F.lag("metric_sum").over(spec)}
    lagged = ordered_windows(daily, [], [date_col], before, before=1)
    one = lagged.agg(
        F.min(date_col).alias("min_date"),
        F.max(date_col).alias("max_date"),
        F.count(F.lit(1)).alias("coverage_days"),
        F.try_divide(F.stddev("records"), F.avg("records")).alias("cv"),
        pearson("before", "metric_sum").alias("lag1"),
    )
    expected = F.datediff("max_date", "min_date").cast("bigint") + 1
    stability = (
        F.when((F.col("cv") < 0.15) & (F.col("lag1") > 0.7), "stable")
        .when((F.col("cv") < 0.30) & (F.col("lag1") > 0.5), "variable")
        .otherwise("volatile")
    )
    return one.select(
        "min_date",
        "max_date",
        "coverage_days",
        expected.alias("expected_days"),
        F.round(F.try_divide(F.col("coverage_days"), expected) * 100, 2).alias("completeness_pct"),
        F.round("cv", 4).alias("record_volume_cv"),
        F.round(F.coalesce("lag1", F.lit(0.0)), 4).alias("metric_lag1_autocorr"),
        stability.alias("stability_class"),
    )


PERCENTILES = (0, 1, 10, 25, 50, 75, 90, 99, 100)


def cost_distribution_metrics(df: DataFrame, cost_col: str) -> DataFrame:
    """Percentiles, skewness, IQR outliers and a modelling recommendation; one row.

    Skewness divides the third central moment by the cube of the sample deviation; that is
    the built-in population skewness times ((n - 1) / n) ** 1.5.
    """
    names = {f"p{p}": p / 100 for p in PERCENTILES}
    quantiles = exact_percentiles(df, [], cost_col, names)
    q = quantiles.agg(F.first(F.struct("*")).alias("q")).scalar()
    reach = 1.5 * (q.getField("p75") - q.getField("p25"))
    low, high = q.getField("p25") - reach, q.getField("p75") + reach
    counted = df.agg(
        F.skewness(cost_col).alias("population_skew"),
        F.count(cost_col).cast("double").alias("known"),
        F.count_if((F.col(cost_col) < low) | (F.col(cost_col) > high)).alias("outlier_count_iqr"),
        F.count(F.lit(1)).alias("n"),
        F.first(q).alias("q"),
    )
    shrink = F.pow(F.try_divide(F.col("known") - 1, "known"), F.lit(1.5))
    skew = F.coalesce(F.nanvl(F.col("population_skew"), F.lit(0.0)) * shrink, F.lit(0.0))
    share = F.try_divide(F.col("outlier_count_iqr"), F.col("n")) * 100
    advice = F.when(skew > 1, "log_transform").when(share > 10, "robust").otherwise("linear")
    return counted.select(
        *(F.col(f"q.{name}").alias(name) for name in names),
        F.round(skew, 3).alias("skewness"),
        "outlier_count_iqr",
        F.round(share, 2).alias("outlier_pct"),
        advice.alias("modeling_rec"),
    )


def detect_entity_anomalies(
    df: DataFrame, entity_col: str, date_col: str = "date", min_days: int = 10, top_n: int = 3
) -> DataFrame:
    """Entities whose daily record count varies most, by coefficient of variation."""
    daily = df.groupBy(entity_col, date_col).agg(F.count(F.lit(1)).alias("daily_records"))
    return (
        daily.groupBy(F.col(entity_col).alias("entity"))
        .agg(
            F.avg("daily_records").alias("mean_daily_records"),
            F.stddev("daily_records").alias("std_daily_records"),
            F.count(F.lit(1)).alias("days_present"),
        )
        .withColumn("cv", F.try_divide("std_daily_records", "mean_daily_records"))
        .where(F.col("days_present") >= min_days)
        .orderBy(F.desc_nulls_last("cv"), "entity")
        .limit(top_n)
    )


CALENDAR_UNITS = {"month": 1, "quarter": 3, "year": 12}


def period_bucket(time_col: str, every: str = "1 day", rounding: str = "floor") -> Column:
    """Start of the period a time falls into, or the nearest period start for ``round``.

    Weeks begin on Monday. Months, quarters and years are those of the calendar; several of
    them are counted from January 1970.
    """
    if rounding not in ("floor", "round"):
        raise ValueError(f"unknown rounding '{rounding}': use floor or round")
    moment = F.col(time_col).cast("timestamp_ntz")
    amount, unit = every.split(maxsplit=1)
    unit = unit.strip().lower().removesuffix("s")
    if unit in CALENDAR_UNITS:
        step = int(amount) * CALENDAR_UNITS[unit]
        number = (F.year(moment) - 1970) * 12 + F.month(moment) - 1
        at = F.floor(number / step).cast("int") * step
        start, end = (F.add_months(F.lit("1970-01-01").cast("date"), m).cast("timestamp_ntz") for m in (at, at + step))
        return F.when(moment - start >= end - moment, end).otherwise(start) if rounding == "round" else start
    if rounding == "round":
        moment = moment + F.expr(f"INTERVAL {amount} {unit}") / 2
    # Windows are counted from 1970-01-01, a Thursday.
    return F.window(moment, every, startTime="4 days" if unit == "week" else "0 seconds").getField("start")


def normalize_by_period(
    df: DataFrame,
    entity_cols: Sequence[str],
    metric_col: str,
    time_col: str,
    every: str = "1 day",
    rounding: str = "floor",
) -> DataFrame:
    """Share of each entity in its period: x(e,t) over the sum of x(.,t).

    Period totals come from a partial aggregate and are joined back, so that a period
    with very many entities is not gathered into one window partition.
    """
    keys = list(entity_cols)
    timed = df.withColumn("time", period_bucket(time_col, every, rounding))
    per_entity = timed.groupBy("time", *keys).agg(F.sum(metric_col).alias("metric_raw"))
    totals = per_entity.groupBy("time").agg(F.sum("metric_raw").alias("period_total"))
    joined = join_on_keys(per_entity, totals, ["time"])
    return joined.withColumn("metric_normalized", F.try_divide("metric_raw", "period_total"))


def align_entities(
    df: DataFrame,
    entity_cols: Sequence[str],
    date_col: str,
    metric_col: str,
    output_col: str = "cost",
    entity_filter: Mapping[str, object] | None = None,
) -> DataFrame:
    """Entity series on the dataset's own dates, zero-filled between first and last day.

    The calendar is the set of dates that occur anywhere in the data, numbered in order.
    Each observation fills the calendar days up to the next one of its entity, so there is
    no range join and no join back to the observations.
    """
    keys = list(entity_cols)
    chosen = df
    for column, value in (entity_filter or {}).items():
        chosen = chosen.where(F.col(column) == F.lit(value))
    series = chosen.groupBy(*keys, date_col).agg(F.sum(metric_col).alias("__value"))
    calendar = with_position(df.select(date_col).distinct(), [], [date_col], pos="__day")
    # One row per entity and date: a window partition is as long as the calendar.
    following = F.lead("__day").over(Window.partitionBy(*keys).orderBy("__day"))
    placed = join_on_keys(series, calendar, [date_col]).withColumn("__next", following)
    days = F.sequence("__day", F.greatest(F.col("__next") - 1, F.col("__day")))
    filled = placed.select(*keys, F.col("__day").alias("__from"), "__value", F.explode(days).alias("__day"))
    value = F.when(F.col("__day") == F.col("__from"), F.coalesce("__value", F.lit(0))).otherwise(F.lit(0))
    return join_on_keys(filled, calendar, ["__day"]).select(*keys, date_col, value.alias(output_col))


def contribution_stack(aligned: DataFrame, entity_col: str, date_col: str, metric_col: str, entities: Sequence) -> DataFrame:
    """One row per date with a column per listed entity; absent values are zero."""
    wide = aligned.groupBy(date_col).pivot(entity_col, list(entities)).agg(F.sum(metric_col))
    return wide.fillna(0.0)


def cumulative_stack(aligned: DataFrame, entity_col: str, date_col: str, metric_col: str) -> DataFrame:
    """Long form of the stack: running total over the entities of a date, in key order."""
    return prefix_sums(aligned, [date_col], [entity_col], {"stacked": metric_col})


def data_quality_report(df: DataFrame, group_cols: Sequence[str], label_col: str) -> DataFrame:
    """Rows, NULLs per column and anomaly rate by group; one aggregation."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns if c not in group_cols]
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("rows"),
        *nulls,
        F.count_if(F.col(label_col)).alias("anomalies"),
        F.try_divide(F.count_if(F.col(label_col)) * 100.0, F.count(F.lit(1))).alias("anomaly_pct"),
    )


def value_distribution_by_date(
    df: DataFrame, date_col: str, metric_col: str, probs: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)
) -> DataFrame:
    """Spread of the metric at each date."""
    names = {f"p{round(p * 100):d}": p for p in probs}
    spread = exact_percentiles(df, [date_col], metric_col, names)
    moments = df.groupBy(date_col).agg(F.count(metric_col).alias("n"), F.avg(metric_col).alias("mean"))
    return join_on_keys(moments, spread, [date_col], "left")
