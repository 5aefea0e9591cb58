"""Streaming forms, run over the files that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.catalog.cost_queries import FLAGS_SQL
from grainwise.catalog.registry import query, r, rounded
from grainwise.sources.views import METRICS_SQL, metrics_of, table
from grainwise.plans.scratch import scratch_path
from grainwise.streaming.rollup import accepted, quarantine_stream, quarantined, read_stream, run_available, stream_flags, stream_roll_up, stream_violations


def event_stream(spark, sf_dir):
    return read_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


@query(
    "stream_roll_up",
    f"""SELECT CAST(ts AS DATE) AS date, event_type, {r('sum(value)', 'value', 2)}, count(*) AS records FROM events
    WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
)
def stream_rolled_up(spark, sf_dir):
    """Days that the watermark has passed; later ones are still open."""
    rolled = stream_roll_up(event_stream(spark, sf_dir), ["event_type"], "ts", "value")
    closed = run_available(rolled, "rollup")
    return rounded(closed.select(F.col("period_start").cast("date").alias("date"), "event_type", "value", "records"), 2)


@query(
    "stream_waste_flags",
    f"""WITH {METRICS_SQL}, {FLAGS_SQL} SELECT event_id, is_idle, is_overprovisioned,
    {r('waste_percentage', 'waste_percentage')},
    memory_utilization BETWEEN 0 AND 100 AND cpu_utilization BETWEEN 0 AND 100 AND hourly_cost >= 0 AS is_valid FROM f""",
)
def stream_waste_flags(spark, sf_dir):
    flagged = run_available(stream_flags(metrics_of(event_stream(spark, sf_dir))), "flags")
    return rounded(flagged.select("event_id", "is_idle", "is_overprovisioned", "waste_percentage", "is_valid"))


@query(
    "stream_interval_violations",
    """WITH b AS (SELECT event_type, avg(value) - 2 * stddev_samp(value) AS lo, avg(value) + 2 * stddev_samp(value) AS hi
      FROM events GROUP BY event_type)
    SELECT event_id, event_type, value FROM events JOIN b USING (event_type) WHERE value < lo OR value > hi""",
)
def stream_interval_violations(spark, sf_dir):
    spread = 2 * F.stddev("value")
    bounds = table(spark, sf_dir, "events").groupBy("event_type").agg(
        (F.avg("value") - spread).alias("lower"), (F.avg("value") + spread).alias("upper")
    )
    found = stream_violations(event_stream(spark, sf_dir), bounds, ["event_type"], "value")
    return run_available(found.select("event_id", "event_type", "value"), "violations")


@query(
    "stream_quarantine",
    """SELECT event_id, value <= 100 AND value >= 1 AS is_valid, list_filter([CASE WHEN value > 100 THEN 'cpu_utilization out of valid range [0, 100]' END,
      CASE WHEN value < 1 THEN 'hourly_cost cannot be negative' END], lambda x: x IS NOT NULL) AS violations FROM events""",
)
def stream_quarantined(spark, sf_dir):
    """Both sides of the stream after it has run and been started once more over the same files."""
    value = F.col("value")
    rows = event_stream(spark, sf_dir).select(
        "event_id", value.alias("cpu_utilization"), F.lit(50.0).alias("memory_utilization"), (value - 1).alias("hourly_cost")
    )
    path = scratch_path(spark, "quarantine")
    for _ in range(2):
        quarantine_stream(rows, f"{path}/rows", f"{path}/state").start().awaitTermination()
    good = accepted(spark, f"{path}/rows", rows.schema).withColumn("violations", F.array().cast("array<string>"))
    both = good.unionByName(quarantined(spark, f"{path}/rows", rows.schema))
    return both.select("event_id", (F.size("violations") == 0).alias("is_valid"), "violations")
