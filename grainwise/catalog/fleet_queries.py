"""Fleet economics and dataset contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.catalog.cost_queries import FACTORS, FLAGS_SQL
from grainwise.catalog.registry import query, r, rounded
from grainwise.operators import fleet as L
from grainwise.operators import profile as P
from grainwise.operators import transforms as X
from grainwise.sources import mldata as D
from grainwise.sources.views import METRICS_SQL, metrics, table

M = f"WITH {METRICS_SQL}"
FLAGGED = f"{M}, {FLAGS_SQL}"


def flagged(spark, sf_dir):
    return metrics(spark, sf_dir).transform(X.with_waste_flags(FACTORS))


def tagged(spark, sf_dir):
    """Metrics with tag columns and daily time; every fifth value band has no team tag."""
    return flagged(spark, sf_dir).withColumns(
        {
            "timestamp": F.col("timestamp").cast("date"),
            "tag_customer_id": F.col("resource_id"),
            "tag_team": F.when(F.col("memory_utilization") >= 20, F.floor(F.col("memory_utilization") / 20).cast("string")),
            "tag_environment": F.when(F.col("workload_type") == "error", "prod").otherwise("dev"),
            "resource_type": F.col("workload_type"),
        }
    )


TAGGED = f"""{FLAGGED}, t AS (SELECT * REPLACE (CAST(timestamp AS DATE) AS timestamp), resource_id AS tag_customer_id,
  CASE WHEN memory_utilization >= 20 THEN CAST(CAST(floor(memory_utilization / 20) AS BIGINT) AS VARCHAR) END AS tag_team,
  CASE WHEN workload_type = 'error' THEN 'prod' ELSE 'dev' END AS tag_environment, workload_type AS resource_type FROM f)"""


@query(
    "cost_per_customer",
    f"""{TAGGED} SELECT tag_customer_id, timestamp, {r('sum(hourly_cost)', 'total_cost', 4)},
    count(DISTINCT resource_id) AS resource_count, {r('avg(cpu_utilization)', 'avg_cpu_utilization')},
    {r('avg(memory_utilization)', 'avg_memory_utilization')} FROM t GROUP BY tag_customer_id, timestamp""",
)
def cost_per_customer(spark, sf_dir):
    return rounded(L.unit_economics(tagged(spark, sf_dir))["cost_per_customer"], 6, total_cost=4)


@query(
    "cost_per_team",
    f"""{TAGGED} SELECT tag_team, timestamp, {r('sum(hourly_cost)', 'total_cost', 4)},
    count(DISTINCT resource_id) AS resource_count FROM t GROUP BY tag_team, timestamp""",
)
def cost_per_team(spark, sf_dir):
    return rounded(L.unit_economics(tagged(spark, sf_dir))["cost_per_team"], 4)


@query(
    "cost_per_environment",
    f"""{TAGGED} SELECT tag_environment, timestamp, {r('sum(hourly_cost)', 'total_cost', 4)},
    {r('avg(efficiency_score)', 'avg_efficiency')} FROM t GROUP BY tag_environment, timestamp""",
)
def cost_per_environment(spark, sf_dir):
    return rounded(L.unit_economics(tagged(spark, sf_dir))["cost_per_environment"], 6, total_cost=4)


@query(
    "waste_analysis",
    f"""{TAGGED} SELECT resource_type, {r('sum(hourly_cost)', 'wasted_cost', 4)},
    count(DISTINCT resource_id) AS wasted_resources FROM t WHERE cpu_utilization < 20 AND memory_utilization < 30
    GROUP BY resource_type""",
)
def waste_analysis(spark, sf_dir):
    return rounded(L.waste_analysis(tagged(spark, sf_dir)), 4)


@query(
    "wasted_share",
    f"""{M}, s AS (SELECT coalesce(sum(hourly_cost) FILTER (cpu_utilization < 20 AND memory_utilization < 30), 0) AS w,
      sum(hourly_cost) AS t FROM metrics)
    SELECT {r('w', 'wasted_cost', 4)}, {r('t', 'total_cost', 4)}, {r('w / t * 100', 'wasted_pct', 4)} FROM s""",
)
def wasted_share(spark, sf_dir):
    return rounded(L.wasted_share(metrics(spark, sf_dir)), 4)


@query(
    "fleet_waste",
    f"""{M}, s AS (SELECT workload_type AS archetype, avg(cpu_utilization) AS c, avg(memory_utilization) AS m,
      sum(hourly_cost) AS t, grouping(workload_type) = 1 AS is_total FROM metrics GROUP BY ROLLUP (workload_type))
    SELECT archetype, {r('c', 'avg_cpu_utilization')}, {r('m', 'avg_memory_utilization')}, {r('t', 'total_cost', 4)},
      is_total, {r('(100 - c) * 0.7', 'cpu_waste_percentage')}, {r('(100 - m) * 0.5', 'memory_waste_percentage')},
      {r('((100 - c) * 0.7 + (100 - m) * 0.5) / 2', 'total_waste_percentage')},
      {r('((100 - c) * 0.7 + (100 - m) * 0.5) / 2', 'optimization_potential')} FROM s""",
)
def fleet_waste(spark, sf_dir):
    fleet = metrics(spark, sf_dir).withColumnRenamed("workload_type", "archetype")
    return rounded(L.fleet_waste(fleet), 6, total_cost=4)


@query(
    "cost_optimization_recommendations",
    f"""{FLAGGED}, a AS (SELECT resource_id, avg(cpu_utilization) AS c, avg(memory_utilization) AS m,
      avg(hourly_cost) AS h, avg(waste_percentage) AS w, avg(efficiency_score) AS e,
      count(*) FILTER (is_idle) * 1.0 / count(*) AS i FROM f GROUP BY resource_id),
    s AS (SELECT *, CASE WHEN i > 0.3 THEN h * i ELSE 0 END + CASE WHEN c < 20 AND m < 30 THEN h * 0.3 ELSE 0 END
      + CASE WHEN e < 40 THEN h * 0.2 ELSE 0 END AS sv FROM a)
    SELECT resource_id, {r('c', 'avg_cpu')}, {r('m', 'avg_memory')}, {r('h', 'avg_cost')}, {r('w', 'avg_waste')},
      {r('e', 'avg_efficiency')}, {r('i', 'idle_ratio')}, {r('sv', 'potential_savings')},
      {r('least(100, sv / nullif(h, 0) * 100)', 'optimization_score')},
      list_filter([CASE WHEN i > 0.3 THEN 'shutdown_when_idle' END,
        CASE WHEN c < 20 AND m < 30 THEN 'rightsize_instance' END, CASE WHEN e < 40 THEN 'optimize_workload' END],
        lambda x: x IS NOT NULL) AS recommendations FROM s""",
)
def cost_optimization_recommendations(spark, sf_dir):
    return rounded(L.cost_optimization(flagged(spark, sf_dir)))


@query(
    "savings_strategy",
    f"""{FLAGGED}, a AS (SELECT CASE workload_type WHEN 'view' THEN 'database_view' ELSE workload_type END AS workload_type,
      avg(cpu_utilization) AS c, avg(memory_utilization) AS m, avg(waste_percentage) AS w FROM f GROUP BY 1)
    SELECT workload_type, {r('c', 'avg_cpu')}, {r('m', 'avg_memory')}, {r('w', 'current_waste')},
      {r('''w * CASE WHEN c < 20 THEN 0.7 WHEN w > 50 THEN 0.6 WHEN contains(workload_type, 'database') THEN 0.4
        ELSE 0.5 END''', 'potential_savings')},
      CASE WHEN c < 20 THEN 'Aggressive auto-scaling or serverless' WHEN w > 50 THEN 'Right-sizing and scheduling'
        WHEN contains(workload_type, 'database') THEN 'Reserved instances and caching'
        ELSE 'Standard auto-scaling' END AS optimization_strategy FROM a""",
)
def savings_strategy(spark, sf_dir):
    named = F.when(F.col("workload_type") == "view", "database_view").otherwise(F.col("workload_type"))
    return rounded(L.savings_strategy(flagged(spark, sf_dir).withColumn("workload_type", named)))


@query(
    "workload_statistics",
    f"""{FLAGGED} SELECT workload_type, {r('avg(cpu_utilization)', 'avg_cpu')}, {r('avg(memory_utilization)', 'avg_memory')},
    {r('avg(waste_percentage)', 'avg_waste')}, {r('avg(efficiency_score)', 'avg_efficiency')},
    count(*) FILTER (is_idle) AS idle_count, count(*) FILTER (is_overprovisioned) AS overprovisioned_count
    FROM f GROUP BY workload_type""",
)
def workload_statistics(spark, sf_dir):
    return rounded(L.workload_statistics(flagged(spark, sf_dir)))


@query(
    "hour_of_day_profile",
    f"""{M} SELECT CAST(hour(timestamp) AS INTEGER) AS hour,
    CASE WHEN hour(timestamp) <= 5 THEN 'Night - Minimal activity' WHEN hour(timestamp) <= 8 THEN 'Morning ramp-up'
      WHEN hour(timestamp) <= 11 THEN 'Peak morning activity' WHEN hour(timestamp) <= 13 THEN 'Lunch dip'
      WHEN hour(timestamp) <= 16 THEN 'Afternoon peak' WHEN hour(timestamp) <= 18 THEN 'End of day wind-down'
      WHEN hour(timestamp) <= 23 THEN 'Evening - Reduced activity' END AS period,
    {r('avg(cpu_utilization)', 'mean_cpu_utilization')}, {r('avg(memory_utilization)', 'mean_memory_utilization')},
    count(*) AS rows FROM metrics GROUP BY 1, 2""",
)
def hour_of_day_profile(spark, sf_dir):
    profile = L.hour_of_day_profile(metrics(spark, sf_dir), "timestamp", ["cpu_utilization", "memory_utilization"])
    return rounded(profile)


@query(
    "weekday_profile",
    f"""{M} SELECT workload_type, CAST(isodow(timestamp) - 1 AS INTEGER) AS weekday, isodow(timestamp) >= 6 AS is_weekend,
    {r('avg(cpu_utilization)', 'mean_cpu_utilization')}, count(*) AS rows FROM metrics GROUP BY 1, 2, 3""",
)
def weekday_profile(spark, sf_dir):
    return rounded(L.weekday_profile(metrics(spark, sf_dir), "timestamp", ["cpu_utilization"], ["workload_type"]))


@query(
    "workload_correlations",
    f"""{M}, n AS (SELECT *, hourly_cost * memory_utilization AS net, cpu_utilization * cpu_utilization AS iops FROM metrics)
    SELECT workload_type, 'cpu_utilization' AS col1, 'memory_utilization' AS col2,
      {r('corr(cpu_utilization, memory_utilization)', 'correlation')} FROM n GROUP BY 1
    UNION ALL SELECT workload_type, 'cpu_utilization', 'network_in_mbps', {r('corr(cpu_utilization, net)', 'correlation')}
      FROM n GROUP BY 1
    UNION ALL SELECT workload_type, 'cpu_utilization', 'disk_iops', {r('corr(cpu_utilization, iops)', 'correlation')}
      FROM n GROUP BY 1
    UNION ALL SELECT workload_type, 'memory_utilization', 'network_in_mbps', {r('corr(memory_utilization, net)', 'correlation')}
      FROM n GROUP BY 1""",
)
def workload_correlations(spark, sf_dir):
    rich = metrics(spark, sf_dir).withColumns(
        {
            "network_in_mbps": F.col("hourly_cost") * F.col("memory_utilization"),
            "disk_iops": F.col("cpu_utilization") * F.col("cpu_utilization"),
        }
    )
    return rounded(L.workload_correlations(rich))


@query(
    "workload_signature",
    f"""{M}, l AS (SELECT *, lag(cpu_utilization) OVER (PARTITION BY workload_type, resource_id
      ORDER BY timestamp, event_id) AS b FROM metrics)
    SELECT workload_type, {r('avg(cpu_utilization)', 'mean_cpu')}, {r('var_samp(cpu_utilization)', 'var_cpu')},
      {r('corr(cpu_utilization, memory_utilization)', 'cpu_memory_corr')}, {r('corr(b, cpu_utilization)', 'lag1_corr')},
      {r('''avg((greatest(0, (100 - greatest(cpu_utilization * 1.2, 30)) / 100)
      + greatest(0, (100 - greatest(memory_utilization * 1.2, 40)) / 100)) / 2 * 100) / 100''', 'waste_fraction')}
    FROM l GROUP BY workload_type""",
)
def workload_signature(spark, sf_dir):
    return rounded(L.workload_signature(metrics(spark, sf_dir), order=["timestamp", "event_id"]))


# -- dataset contract ---------------------------------------------------------------


@query(
    "ml_dataset_normaliser",
    f"""{M} SELECT event_id, resource_id, cpu_utilization, 'web_application' AS workload_type, 'AWS' AS cloud_provider,
    false AS is_anomaly FROM metrics""",
)
def ml_dataset_normaliser(spark, sf_dir):
    bare = metrics(spark, sf_dir).drop("workload_type", "is_anomaly")
    return D.normalise(bare).select(
        "event_id", "resource_id", "cpu_utilization", "workload_type", "cloud_provider", "is_anomaly"
    )


STATS = ("cpu_utilization", "memory_utilization", "hourly_cost")


@query(
    "dataset_statistics",
    f"""{M}, s AS (SELECT 'dataset' AS section, 'rows' AS name, 'count' AS stat, CAST(count(*) AS DOUBLE) AS value FROM metrics
    UNION ALL SELECT 'dataset', 'columns', 'count', 8
    UNION ALL SELECT 'dataset', 'is_anomaly', 'rate', count(*) FILTER (is_anomaly) * 1.0 / count(*) FROM metrics
    UNION ALL SELECT 'dataset', 'resource_id', 'distinct', count(DISTINCT resource_id) FROM metrics
    UNION ALL SELECT 'dataset', 'timestamp', 'start', floor(epoch(min(timestamp))) FROM metrics
    UNION ALL SELECT 'dataset', 'timestamp', 'end', floor(epoch(max(timestamp))) FROM metrics
    UNION ALL SELECT 'workload', workload_type, 'count', count(*) FROM metrics GROUP BY workload_type """
    + "".join(
        f" UNION ALL SELECT 'metric', '{c}', '{stat}', {fn} FROM metrics"
        for c in STATS
        for stat, fn in (
            ("mean", f"avg({c})"),
            ("std", f"stddev_samp({c})"),
            ("min", f"min({c})"),
            ("max", f"max({c})"),
            ("q25", f"quantile_cont({c}, 0.25)"),
            ("median", f"quantile_cont({c}, 0.5)"),
            ("q75", f"quantile_cont({c}, 0.75)"),
        )
    )
    + f") SELECT section, name, stat, {r('value', 'value')} FROM s",
)
def dataset_statistics(spark, sf_dir):
    df = metrics(spark, sf_dir)
    quartiles = P.numeric_column_summary(df.select(*STATS))
    return rounded(D.with_quartiles(D.dataset_statistics(df), quartiles))


@query(
    "dataset_validation_report",
    f"""SELECT 'cpu_utilization out of valid range [0, 100]' AS rule, count(*) FILTER (value > 100 OR value < 0) AS violations
    FROM events UNION ALL SELECT 'memory_utilization out of valid range [0, 100]', 0
    UNION ALL SELECT 'hourly_cost cannot be negative', count(*) FILTER (value - 1 < 0) FROM events""",
)
def dataset_validation_report(spark, sf_dir):
    raw = metrics(spark, sf_dir).drop("cpu_utilization", "hourly_cost")
    values = table(spark, sf_dir, "events").select("event_id", "value")
    faulty = raw.join(values, "event_id").withColumns(
        {"cpu_utilization": F.col("value"), "hourly_cost": F.col("value") - 1}
    )
    return D.range_report(faulty)


@query(
    "dataset_quarantine",
    """SELECT event_id, list_filter([CASE WHEN value > 100 THEN 'cpu_utilization out of valid range [0, 100]' END,
      CASE WHEN value < 1 THEN 'hourly_cost cannot be negative' END], lambda x: x IS NOT NULL) AS violations
    FROM events WHERE value > 100 OR value < 1""",
)
def dataset_quarantine(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    faulty = events.select(
        "event_id",
        F.col("user_id").cast("string").alias("resource_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("cpu_utilization"),
        F.lit(50.0).alias("memory_utilization"),
        (F.col("value") - 1).alias("hourly_cost"),
    )
    return D.quarantine(faulty).select("event_id", "violations")
