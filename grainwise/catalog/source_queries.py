"""Readers, loaders and sinks, driven by the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.catalog.registry import query, r, rounded
from grainwise.plans.scratch import scratch_path
from grainwise.sources.loaders import BillingLoader, LoaderSpec
from grainwise.sources.mldata import to_ml_types
from grainwise.sources.tables import export_datasets, read_labelled_signal, read_parquet, write_parquet
from grainwise.sources.views import BILLING_SQL, METRICS_SQL, billing, metrics, table

B = f"WITH {BILLING_SQL}"


@query("parquet_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet_scan(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "csv_signal_scan",
    """SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS timestamp, value,
    CAST(event_type = 'error' AS INTEGER) AS label FROM events""",
)
def csv_signal_scan(spark, sf_dir):
    """Write the signal as ordered header-less CSV files, then read it back with positions."""
    folder = scratch_path(spark, "signal")
    events = table(spark, sf_dir, "events")
    ordered = events.repartitionByRange("event_id").sortWithinPartitions("event_id")
    ordered.select("value", (F.col("event_type") == "error").cast("int").alias("label")).write.csv(folder)
    return read_labelled_signal(spark, folder)


@query(
    "billing_loader_default",
    f"""{B} SELECT r_name AS cloud_provider, n_name AS cloud_account_id, {r('sum(cost)', 'cost', 2)}, count(*) AS n
    FROM billing GROUP BY ALL""",
)
def billing_loader_default(spark, sf_dir):
    raw = billing(spark, sf_dir).select(
        F.col("date").alias("usage_date"),
        F.col("r_name").alias("cloud_provider"),
        F.col("n_name").alias("cloud_account_id"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("product_family"),
        F.col("o_orderpriority").alias("usage_type"),
        F.col("cost").alias("materialized_cost"),
        (F.col("cost") * 0.9).alias("materialized_discounted_cost"),
    )
    frame = BillingLoader.load(raw)
    kept = frame.df.groupBy("cloud_provider", "cloud_account_id")
    return rounded(kept.agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n")), 2)


@query(
    "billing_loader_custom",
    f"SELECT l_returnflag, l_shipdate, {r('sum(l_extendedprice)', 'amount', 2)} FROM lineitem GROUP BY ALL",
)
def billing_loader_custom(spark, sf_dir):
    spec = LoaderSpec(renames={"l_extendedprice": "amount"}, drops=("l_tax",), hierarchy=("l_returnflag", "l_linestatus"))
    frame = spec.load(table(spark, sf_dir, "lineitem"), metric_col="amount", time_col="l_shipdate")
    return rounded(frame.aggregate(["l_returnflag"]).df, 2)


@query(
    "parquet_sink_partitioned",
    f"""{B} SELECT year(date) AS year, r_name, count(*) AS n, {r('sum(cost)', 'cost', 2)} FROM billing
    WHERE year(date) = 1998 GROUP BY ALL""".replace("year(date) AS year", "CAST(year(date) AS INTEGER) AS year"),
)
def parquet_sink_partitioned(spark, sf_dir):
    """Partitioned write, then a read that touches one partition only."""
    folder = scratch_path(spark, "billing")
    write_parquet(billing(spark, sf_dir).withColumn("year", F.year("date")), folder, ["year"])
    one_year = spark.read.parquet(folder).where("year = 1998")
    return rounded(one_year.groupBy("year", "r_name").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")), 2)


@query(
    "multi_dataset_export",
    f"""WITH {METRICS_SQL} SELECT 'anomalies' AS dataset, count(*) AS rows, {r('sum(cpu_utilization)', 'cpu', 0)}
    FROM metrics WHERE is_anomaly UNION ALL SELECT 'raw', count(*), {r('sum(cpu_utilization)', 'cpu', 0)} FROM metrics""",
)
def multi_dataset_export(spark, sf_dir):
    df = to_ml_types(metrics(spark, sf_dir))
    folders = export_datasets({"raw": df, "anomalies": df.where("is_anomaly")}, scratch_path(spark, "export"))
    parts = [
        spark.read.parquet(path).agg(
            F.lit(name).alias("dataset"),
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.round(F.col("cpu_utilization").cast("double"), 2)).alias("cpu"),
        )
        for name, path in folders.items()
    ]
    return rounded(parts[0].unionByName(parts[1]), 0)


@query(
    "diagonal_union",
    f"""{B} SELECT 'orders' AS origin, count(*) AS n, count(n_name) AS with_nation, count(l_returnflag) AS with_flag
    FROM (SELECT n_name, NULL AS l_returnflag FROM billing)
    UNION ALL SELECT 'lineitem', count(*), 0, count(l_returnflag) FROM lineitem""",
)
def diagonal_union(spark, sf_dir):
    orders = billing(spark, sf_dir).select("n_name", "cost").withColumn("origin", F.lit("orders"))
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("cost"))
    both = orders.unionByName(lines.withColumn("origin", F.lit("lineitem")), allowMissingColumns=True)
    return both.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("n_name").alias("with_nation"),
        F.count("l_returnflag").alias("with_flag"),
    )


@query(
    "unpivot_metrics",
    f"""WITH {METRICS_SQL} SELECT event_id, 'cpu_utilization' AS metric, {r('cpu_utilization', 'value')} FROM metrics
    UNION ALL SELECT event_id, 'memory_utilization', {r('memory_utilization', 'value')} FROM metrics
    UNION ALL SELECT event_id, 'hourly_cost', {r('hourly_cost', 'value')} FROM metrics""",
)
def unpivot_metrics(spark, sf_dir):
    wanted = ["cpu_utilization", "memory_utilization", "hourly_cost"]
    return rounded(metrics(spark, sf_dir).unpivot("event_id", wanted, "metric", "value"))


@query(
    "top_k_per_group",
    f"""{B}, t AS (SELECT r_name, n_name, c_mktsegment, sum(cost) AS c FROM billing GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY c DESC, n_name, c_mktsegment) AS rk FROM t)
    SELECT r_name, n_name, c_mktsegment, {r('c', 'cost', 2)}, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= 3""",
)
def top_k_per_group(spark, sf_dir):
    from pyspark.sql import Window

    totals = billing(spark, sf_dir).groupBy("r_name", "n_name", "c_mktsegment").agg(F.sum("cost").alias("cost"))
    best = Window.partitionBy("r_name").orderBy(F.desc("cost"), "n_name", "c_mktsegment")
    return rounded(totals.withColumn("rank", F.row_number().over(best)).where("rank <= 3"), 2)
