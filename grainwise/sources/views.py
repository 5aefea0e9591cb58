"""Analysis views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.plans.frame import GrainFrame

BILLING_KEYS = ("r_name", "n_name", "c_mktsegment", "o_orderpriority")

BILLING_SQL = """billing AS (
  SELECT CAST(o_orderdate AS DATE) AS date, r_name, n_name, c_mktsegment, o_orderpriority,
         o_totalprice AS cost
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SIGNAL_SQL = """signal AS (
  SELECT user_id AS series_id, ts, event_id, value, event_type = 'error' AS label,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events)"""

METRICS_SQL = r"""metrics AS (
  SELECT CAST(user_id AS VARCHAR) AS resource_id, ts AS timestamp, event_id,
         event_type AS workload_type, least(value, 100.0) AS cpu_utilization,
         CAST(regexp_extract(props, '"k": (\d+)', 1) AS DOUBLE) AS memory_utilization,
         value / 100 AS hourly_cost, event_type = 'error' AS is_anomaly
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order cost with region, nation, segment and priority keys.

    Joins carry no hints: the planner broadcasts a dimension when its files are small
    and shuffles it when they are not.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderdate").cast("date").alias("date"),
            *BILLING_KEYS,
            F.col("o_totalprice").alias("cost"),
        )
    )


def billing_frame(spark: SparkSession, sf_dir: str) -> GrainFrame:
    return GrainFrame.from_dataframe(billing(spark, sf_dir), BILLING_KEYS)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled signal: one series per user, errors are the anomalies."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"),
        "ts",
        "event_id",
        "value",
        (F.col("event_type") == "error").alias("label"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource metrics: utilisation and cost per user and event."""
    return metrics_of(table(spark, sf_dir, "events"))


def metrics_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("resource_id"),
        F.col("ts").alias("timestamp"),
        "event_id",
        F.col("event_type").alias("workload_type"),
        F.least("value", F.lit(100.0)).alias("cpu_utilization"),
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("double").alias("memory_utilization"),
        (F.col("value") / 100).alias("hourly_cost"),
        (F.col("event_type") == "error").alias("is_anomaly"),
    )
