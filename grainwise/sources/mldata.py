"""Resource-metrics dataset contract: defaults, validation, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared dataset schema, its class labels and its defaults.
REQUIRED = ("resource_id", "timestamp", "cpu_utilization", "memory_utilization", "hourly_cost")
DEFAULTS = {"workload_type": "web_application", "cloud_provider": "AWS", "is_anomaly": False}
FLOAT_METRICS = (
    "cpu_utilization",
    "memory_utilization",
    "network_in_mbps",
    "network_out_mbps",
    "disk_iops",
    "hourly_cost",
    "efficiency_score",
    "waste_percentage",
)
CLASS_LABELS = {
    "workload_type": (
        "web_application",
        "microservice",
        "batch_processing",
        "ml_training",
        "ml_inference",
        "database_oltp",
        "database_olap",
        "streaming_pipeline",
        "serverless_function",
        "cache_layer",
        "message_queue",
        "development_environment",
    ),
    "cloud_provider": ("AWS", "Azure", "GCP"),
    "environment": ("prod", "staging", "dev", "test"),
}
STAT_METRICS = ("cpu_utilization", "memory_utilization", "hourly_cost", "efficiency_score", "waste_percentage")
PERCENT_METRICS = ("cpu_utilization", "memory_utilization")
CHECKED_METRICS = ("cpu_utilization", "memory_utilization", "hourly_cost")


def normalise(df: DataFrame) -> DataFrame:
    """Require the core columns and add the defaults that are missing."""
    for name in REQUIRED:
        if name not in df.columns:
            raise ValueError(f"Required column '{name}' not found in DataFrame")
    return df.withColumns({name: F.lit(v) for name, v in DEFAULTS.items() if name not in df.columns})


def to_ml_types(df: DataFrame) -> DataFrame:
    """Narrow the metric columns to float for the ML sink."""
    return df.withColumns({c: F.col(c).cast("float") for c in FLOAT_METRICS if c in df.columns})


def schema_errors(df: DataFrame) -> list[str]:
    """Missing columns and non-numeric metrics, found from the schema alone."""
    errors = [f"Required column '{c}' not found in DataFrame" for c in REQUIRED if c not in df.columns]
    for name in CHECKED_METRICS:
        if name in df.columns and not isinstance(df.schema[name].dataType, T.NumericType):
            errors.append(f"Column {name} has incorrect dtype: {df.schema[name].dataType.simpleString()}")
    return errors


def _rules(df: DataFrame) -> dict[str, Column]:
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    rules = {
        f"{c} out of valid range [0, 100]": (F.col(c) < 0) | (F.col(c) > 100)
        for c in PERCENT_METRICS
        if c in numeric
    }
    if "hourly_cost" in numeric:
        rules["hourly_cost cannot be negative"] = F.col("hourly_cost") < 0
    for name, labels in CLASS_LABELS.items():
        if name in df.columns:
            rules[f"{name} outside its class labels"] = F.col(name).isNotNull() & ~F.col(name).isin(*labels)
    return rules


def range_report(df: DataFrame, with_labels: bool = False) -> DataFrame:
    """One row per rule with its number of violations; a single aggregation."""
    rules = {r: t for r, t in _rules(df).items() if with_labels or "class labels" not in r}
    counts = df.agg(*(F.count_if(test).alias(f"r{i}") for i, test in enumerate(rules.values())))
    pairs = [
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, name in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*pairs)))


def with_violations(df: DataFrame, with_labels: bool = False) -> DataFrame:
    """All rows with the list of rules each one breaks, empty for valid rows."""
    rules = {r: t for r, t in _rules(df).items() if with_labels or "class labels" not in r}
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items()))))


def quarantine(df: DataFrame, with_labels: bool = False) -> DataFrame:
    """The violating rows with the list of rules each one breaks."""
    return with_violations(df, with_labels).where(F.size("violations") > 0)


def validate(df: DataFrame) -> tuple[bool, list[str]]:
    """Schema errors first; then one aggregation over the data for the ranges."""
    errors = schema_errors(df)
    found = range_report(df).where("violations > 0").orderBy("rule").collect() if _rules(df) else []
    errors += [f"{row.rule}: {row.violations} rows" for row in found]
    return not errors, errors


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Long table (section, name, stat, value) of sizes, metric moments, labels and time range.

    Quartiles need an ordering and are added by ``with_quartiles`` from the numeric column
    summary; everything here is one mergeable aggregation.
    """
    metrics = [c for c in STAT_METRICS if c in df.columns]
    aggregates = [F.count(F.lit(1)).cast("double").alias("dataset|rows|count")]
    aggregates.append(F.lit(float(len(df.columns))).alias("dataset|columns|count"))
    for c in metrics:
        aggregates += [
            F.avg(c).alias(f"metric|{c}|mean"),
            F.stddev(c).alias(f"metric|{c}|std"),
            F.min(c).cast("double").alias(f"metric|{c}|min"),
            F.max(c).cast("double").alias(f"metric|{c}|max"),
        ]
    if "is_anomaly" in df.columns:
        rate = F.try_divide(F.count_if(F.col("is_anomaly")), F.count(F.lit(1)))
        aggregates.append(rate.alias("dataset|is_anomaly|rate"))
    if "resource_id" in df.columns:
        aggregates.append(F.count_distinct("resource_id").cast("double").alias("dataset|resource_id|distinct"))
    if "timestamp" in df.columns:
        for stat, fn in (("start", F.min), ("end", F.max)):
            seconds = F.unix_seconds(fn(F.col("timestamp").cast("timestamp"))).cast("double")
            aggregates.append(seconds.alias(f"dataset|timestamp|{stat}"))
    wide = df.agg(*aggregates)
    rows = []
    for name in wide.columns:
        section, what, stat = name.split("|")
        rows.append(
            F.struct(
                F.lit(section).alias("section"),
                F.lit(what).alias("name"),
                F.lit(stat).alias("stat"),
                F.col(f"`{name}`").alias("value"),
            )
        )
    out = wide.select(F.inline(F.array(*rows)))
    if "workload_type" in df.columns:
        counts = df.groupBy("workload_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(
            counts.select(
                F.lit("workload").alias("section"),
                F.col("workload_type").alias("name"),
                F.lit("count").alias("stat"),
                "value",
            )
        )
    return out


def with_quartiles(stats: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Append quartile rows (column, q25, median, q75) to the statistics table."""
    rows = [
        F.struct(F.lit(stat).alias("stat"), F.col(stat).cast("double").alias("value"))
        for stat in ("q25", "median", "q75")
    ]
    long = quartiles.select(F.lit("metric").alias("section"), F.col("column").alias("name"), F.inline(F.array(*rows)))
    return reduce(DataFrame.unionByName, [stats, long.select("section", "name", "stat", "value")])
