"""Cost over time and per-row transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.catalog.registry import query, r, rounded
from grainwise.operators import cost as C
from grainwise.operators import transforms as X
from grainwise.sources.views import BILLING_SQL, METRICS_SQL, billing, billing_frame, metrics, table

B, M = f"WITH {BILLING_SQL}", f"WITH {METRICS_SQL}"
DAILY = f"{B}, daily AS (SELECT date, count(*) AS value FROM billing GROUP BY date)"


@query("daily_observation_counts", f"{B} SELECT date, count(*) AS count FROM billing GROUP BY date")
def daily_observation_counts(spark, sf_dir):
    return C.daily_observation_counts(billing(spark, sf_dir))


@query(
    "daily_metric_density",
    f"SELECT l_shipdate, {r('sum(l_extendedprice)', 'value', 2)} FROM lineitem GROUP BY l_shipdate",
)
def daily_metric_density(spark, sf_dir):
    return rounded(C.temporal_density(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice"), 2)


@query(
    "daily_summary",
    f"""{B} SELECT date, count(*) AS record_count, {r('sum(cost)', 'total_cost', 2)},
    {r('stddev_samp(cost)', 'cost_std', 4)} FROM billing GROUP BY date""",
)
def daily_summary(spark, sf_dir):
    return rounded(C.daily_summary(billing(spark, sf_dir)), 4, total_cost=2)


@query(
    "time_bucket_counts",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS count FROM events GROUP BY 1",
)
def time_bucket_counts(spark, sf_dir):
    return C.time_bucket_counts(table(spark, sf_dir, "events"), "ts", "6 hours")


def _quality(source: str, date: str, metric: str) -> str:
    return f"""d AS (SELECT {date} AS date, count(*) AS records, sum({metric}) AS s FROM {source} GROUP BY 1),
    l AS (SELECT *, lag(s) OVER (ORDER BY date) AS b FROM d),
    o AS (SELECT min(date) AS min_date, max(date) AS max_date, count(*) AS coverage_days,
      stddev_samp(records) / avg(records) AS cv, corr(b, s) AS lag1 FROM l)
    SELECT min_date, max_date, coverage_days,
      CAST(date_diff('day', min_date, max_date) + 1 AS BIGINT) AS expected_days,
      round(coverage_days * 100.0 / (date_diff('day', min_date, max_date) + 1), 2) AS completeness_pct,
      round(cv, 4) AS record_volume_cv, round(coalesce(lag1, 0), 4) AS metric_lag1_autocorr,
      CASE WHEN cv < 0.15 AND lag1 > 0.7 THEN 'stable' WHEN cv < 0.30 AND lag1 > 0.5 THEN 'variable'
        ELSE 'volatile' END AS stability_class FROM o"""


@query("temporal_quality_orders", f"{B}, {_quality('billing', 'date', 'cost')}")
def temporal_quality_orders(spark, sf_dir):
    return C.temporal_quality_metrics(billing(spark, sf_dir), "date", "cost")


@query("temporal_quality_events", f"WITH {_quality('events', 'CAST(ts AS DATE)', 'value')}")
def temporal_quality_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("date", F.col("ts").cast("date"))
    return C.temporal_quality_metrics(events, "date", "value")


def _distribution(source: str, column: str) -> str:
    ps = (0, 1, 10, 25, 50, 75, 90, 99, 100)
    q = ", ".join(f"quantile_cont({column}, {p / 100}) AS p{p}" for p in ps)
    shown = ", ".join(r(f"p{p}", f"p{p}", 4) for p in ps)
    return f"""q AS (SELECT {q}, avg({column}) AS m, stddev_samp({column}) AS s, count(*) AS n FROM {source}),
    o AS (SELECT any_value(q) AS q, avg(({column} - m) ** 3) / any_value(s) ** 3 AS sk,
      count(*) FILTER ({column} < p25 - 1.5 * (p75 - p25) OR {column} > p75 + 1.5 * (p75 - p25)) AS oc,
      any_value(n) AS n FROM {source}, q)
    SELECT {shown.replace('CAST(p', 'CAST(q.p')}, round(sk, 3) AS skewness, oc AS outlier_count_iqr,
      round(oc * 100.0 / n, 2) AS outlier_pct,
      CASE WHEN sk > 1 THEN 'log_transform' WHEN oc * 100.0 / n > 10 THEN 'robust' ELSE 'linear' END AS modeling_rec
    FROM o"""


@query("cost_distribution_orders", f"{B}, {_distribution('billing', 'cost')}")
def cost_distribution_orders(spark, sf_dir):
    return rounded(C.cost_distribution_metrics(billing(spark, sf_dir), "cost"), 4)


@query("cost_distribution_events", f"WITH {_distribution('events', 'value')}")
def cost_distribution_events(spark, sf_dir):
    return rounded(C.cost_distribution_metrics(table(spark, sf_dir, "events"), "value"), 4)


@query(
    "entity_anomaly_ranking",
    f"""{B}, d AS (SELECT n_name AS entity, date, count(*) AS c FROM billing GROUP BY ALL)
    SELECT entity, {r('avg(c)', 'mean_daily_records')}, {r('stddev_samp(c)', 'std_daily_records')},
      count(*) AS days_present, {r('stddev_samp(c) / avg(c)', 'cv')} FROM d GROUP BY entity
    HAVING count(*) >= 10 ORDER BY stddev_samp(c) / avg(c) DESC, entity LIMIT 5""",
)
def entity_anomaly_ranking(spark, sf_dir):
    return rounded(C.detect_entity_anomalies(billing(spark, sf_dir), "n_name", min_days=10, top_n=5))


def _share(bucket: str) -> str:
    return f"""{B}, e AS (SELECT {bucket} AS time, c_mktsegment, sum(cost) AS c FROM billing GROUP BY ALL)
    SELECT time, c_mktsegment, {r('c', 'metric_raw', 2)}, {r('sum(c) OVER (PARTITION BY time)', 'period_total', 2)},
      {r('c / nullif(sum(c) OVER (PARTITION BY time), 0)', 'metric_normalized')} FROM e"""


@query("entity_share_by_day", _share("CAST(date AS TIMESTAMP)"))
def entity_share_by_day(spark, sf_dir):
    table_ = C.normalize_by_period(billing(spark, sf_dir), ["c_mktsegment"], "cost", "date")
    return rounded(table_, 6, metric_raw=2, period_total=2)


@query(
    "entity_share_rounded_period",
    """WITH e AS (SELECT time_bucket(INTERVAL 12 HOUR, ts + INTERVAL 6 HOUR) AS time, event_type,
      sum(value) AS c FROM events GROUP BY ALL)
    SELECT time, event_type, """
    + f"""{r('c', 'metric_raw', 2)}, {r('sum(c) OVER (PARTITION BY time)', 'period_total', 2)},
      {r('c / nullif(sum(c) OVER (PARTITION BY time), 0)', 'metric_normalized')} FROM e""",
)
def entity_share_rounded_period(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    shares = C.normalize_by_period(events, ["event_type"], "value", "ts", "12 hours", rounding="round")
    return rounded(shares, 6, metric_raw=2, period_total=2)


def _share(bucket: str) -> str:
    return f"""WITH e AS (SELECT CAST({bucket} AS TIMESTAMP) AS time, event_type, sum(value) AS c FROM events GROUP BY ALL)
    SELECT time, event_type, {r('c', 'metric_raw', 2)}, {r('sum(c) OVER (PARTITION BY time)', 'period_total', 2)},
      {r('c / nullif(sum(c) OVER (PARTITION BY time), 0)', 'metric_normalized')} FROM e"""


@query("entity_share_by_week", _share("date_trunc('week', ts)"))
def entity_share_by_week(spark, sf_dir):
    shares = C.normalize_by_period(table(spark, sf_dir, "events"), ["event_type"], "value", "ts", "1 week")
    return rounded(shares, 6, metric_raw=2, period_total=2)


@query("entity_share_by_month", _share("date_trunc('month', ts)"))
def entity_share_by_month(spark, sf_dir):
    shares = C.normalize_by_period(table(spark, sf_dir, "events"), ["event_type"], "value", "ts", "1 month")
    return rounded(shares, 6, metric_raw=2, period_total=2)


@query("temporal_quality_instants", f"WITH {_quality('events', 'ts', 'value')}")
def temporal_quality_instants(spark, sf_dir):
    """The series on raw instants: as long as the table."""
    return C.temporal_quality_metrics(table(spark, sf_dir, "events"), "ts", "value")


ALIGNED = """s AS (SELECT n_name, o_orderpriority, date, sum(cost) AS c FROM billing GROUP BY ALL),
  spans AS (SELECT n_name, o_orderpriority, min(date) AS a, max(date) AS b FROM s GROUP BY ALL),
  spine AS (SELECT n_name, o_orderpriority, date FROM spans
    JOIN (SELECT DISTINCT date FROM billing) ON date BETWEEN a AND b)"""


@query(
    "aligned_entity_series",
    f"""{B}, {ALIGNED} SELECT n_name, o_orderpriority, date, {r('coalesce(c, 0)', 'cost', 2)}
    FROM spine LEFT JOIN s USING (n_name, o_orderpriority, date)""",
)
def aligned_entity_series(spark, sf_dir):
    return rounded(C.align_entities(billing(spark, sf_dir), ["n_name", "o_orderpriority"], "date", "cost"), 2)


@query(
    "contribution_stack",
    f"""{B} SELECT date, {r("coalesce(sum(cost) FILTER (c_mktsegment = 'BUILDING'), 0)", 'BUILDING', 2)},
    {r("coalesce(sum(cost) FILTER (c_mktsegment = 'MACHINERY'), 0)", 'MACHINERY', 2)} FROM billing
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY date""",
)
def contribution_stack(spark, sf_dir):
    frame = billing(spark, sf_dir).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    aligned = C.align_entities(frame, ["c_mktsegment"], "date", "cost")
    return rounded(C.contribution_stack(aligned, "c_mktsegment", "date", "cost", ["BUILDING", "MACHINERY"]), 2)


@query(
    "cumulative_stack",
    f"""{B}, s AS (SELECT r_name, date, sum(cost) AS c FROM billing GROUP BY ALL),
    p AS (SELECT r_name, min(date) AS a, max(date) AS b FROM s GROUP BY r_name),
    f AS (SELECT p.r_name, d.date, coalesce(s.c, 0) AS c FROM p
      JOIN (SELECT DISTINCT date FROM billing) d ON d.date BETWEEN a AND b
      LEFT JOIN s ON s.r_name = p.r_name AND s.date = d.date)
    SELECT r_name, date, {r('c', 'cost', 2)}, {r('sum(c) OVER (PARTITION BY date ORDER BY r_name)', 'stacked', 2)}
    FROM f""",
)
def cumulative_stack(spark, sf_dir):
    aligned = C.align_entities(billing(spark, sf_dir), ["r_name"], "date", "cost")
    return rounded(C.cumulative_stack(aligned, "r_name", "date", "cost"), 2)


@query(
    "data_quality_report",
    f"""SELECT event_type, count(*) AS rows, count(*) - count(ts) AS ts_nulls, count(*) - count(value) AS value_nulls,
    count(*) - count(label) AS label_nulls, count(*) FILTER (label) AS anomalies,
    {r('count(*) FILTER (label) * 100.0 / count(*)', 'anomaly_pct')}
    FROM (SELECT event_type, ts, value, value > 150 AS label FROM events) GROUP BY event_type""",
)
def data_quality_report(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value", (F.col("value") > 150).alias("label"))
    return rounded(C.data_quality_report(events, ["event_type"], "label"))


@query(
    "value_distribution_by_date",
    f"""SELECT CAST(ts AS DATE) AS date, count(value) AS n, {r('avg(value)', 'mean')},
    {r('min(value)', 'p0')}, {r('quantile_cont(value, 0.25)', 'p25')}, {r('median(value)', 'p50')},
    {r('quantile_cont(value, 0.75)', 'p75')}, {r('max(value)', 'p100')} FROM events GROUP BY 1""",
)
def value_distribution_by_date(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("date", F.col("ts").cast("date"))
    return rounded(C.value_distribution_by_date(events, "date", "value"))


# -- transforms ---------------------------------------------------------------------


@query(
    "pct_change_by_entity",
    f"""{B}, d AS (SELECT r_name, date, sum(cost) AS cost FROM billing GROUP BY ALL)
    SELECT r_name, date, {r('cost', 'cost', 2)},
      {r('(cost - lag(cost) OVER w) / nullif(lag(cost) OVER w, 0)', 'pct_change')}
    FROM d WINDOW w AS (PARTITION BY r_name ORDER BY date)""",
)
def pct_change_by_entity(spark, sf_dir):
    daily = billing_frame(spark, sf_dir).aggregate(["r_name"]).df
    return rounded(daily.transform(X.pct_change("cost", "date", "r_name", calendar=True)), 6, cost=2)


@query(
    "pct_change_of_rows",
    f"""SELECT event_id, user_id, {r('(value - lag(value) OVER w) / nullif(lag(value) OVER w, 0)', 'pct_change')}
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def pct_change_of_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    changed = events.transform(X.pct_change("value", ["ts", "event_id"], "user_id"))
    return rounded(changed.select("event_id", "user_id", "pct_change"))


@query(
    "group_summary_stats",
    f"""SELECT event_type, count(value) AS count, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'stddev')},
    {r('min(value)', 'min')}, {r('max(value)', 'max')} FROM events GROUP BY event_type""",
)
def group_summary_stats(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").transform(X.summary_stats("value", "event_type")))


CHANGE = f"""{DAILY}, ch AS (SELECT date, value, (value - lag(value) OVER (ORDER BY date)) * 1.0
    / nullif(lag(value) OVER (ORDER BY date), 0) AS change FROM daily)"""


@query(
    "day_over_day_change",
    f"""{CHANGE} SELECT date, value, {r('change', 'change')}, abs(change) >= 0.3 AS flagged
    FROM ch WHERE change IS NOT NULL""",
)
def day_over_day_change(spark, sf_dir):
    return rounded(billing(spark, sf_dir).transform(X.day_over_day("date", threshold=0.3)))


@query(
    "largest_drops",
    f"{CHANGE} SELECT date, value, {r('change', 'change')} FROM ch WHERE change IS NOT NULL ORDER BY change, date, value LIMIT 5",
)
def largest_drops(spark, sf_dir):
    daily = billing(spark, sf_dir).transform(X.daily_totals("date"))
    changed = daily.transform(X.pct_change("value", "date", output_col="change", calendar=True))
    return rounded(changed.transform(X.largest_drops("change", 5)))


@query(
    "cutoff_detection",
    f"""{CHANGE}, cut AS (SELECT min(date) AS c FROM ch WHERE change < -0.8)
    SELECT r_name, count(*) AS n, min(date) AS first_date, max(date) AS last_date
    FROM billing, cut WHERE c IS NULL OR date < c GROUP BY r_name""",
)
def cutoff_detection(spark, sf_dir):
    facts = billing(spark, sf_dir)
    daily = facts.transform(X.daily_totals("date")).transform(
        X.pct_change("value", "date", output_col="change", calendar=True)
    )
    kept = facts.transform(X.before_cutoff(daily, "date", "change", -0.8))
    return kept.groupBy("r_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "derived_unit_costs",
    f"""{M} SELECT event_id, {r('hourly_cost / (4.0 + 0.001)', 'cost_per_cpu')},
    {r('hourly_cost / (memory_utilization + 0.001)', 'cost_per_gb')},
    {r('(cpu_utilization + memory_utilization) / 2', 'efficiency_score')} FROM metrics""",
)
def derived_unit_costs(spark, sf_dir):
    sized = metrics(spark, sf_dir).withColumns({"cpu_cores": F.lit(4.0), "memory_gb": F.col("memory_utilization")})
    costs = sized.transform(X.with_unit_costs())
    return rounded(costs.select("event_id", "cost_per_cpu", "cost_per_gb", "efficiency_score"))


FACTORS = {"click": 0.1, "view": 0.2, "purchase": 0.35, "signup": 0.25, "error": 0.5}
FLAGS_SQL = f"""f AS (SELECT *, cpu_utilization < 5 AND memory_utilization < 10 AS is_idle,
    cpu_utilization < 20 AND memory_utilization < 30 AS is_overprovisioned,
    (greatest(0, (100 - greatest(cpu_utilization * 1.2, 30)) / 100)
      + greatest(0, (100 - greatest(memory_utilization * 1.2, 40)) / 100)) / 2 * 100 AS waste_percentage,
    0.5 * (100 - cpu_utilization) + 0.5 * (100 - memory_utilization) AS waste_linear,
    least(greatest((100 - abs(cpu_utilization - 70) + 100 - abs(memory_utilization - 80)) / 2 - 100 *
      CASE workload_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in FACTORS.items())} ELSE 0 END, 0), 100)
      AS efficiency_score FROM metrics)"""


@query(
    "waste_and_idle_flags",
    f"""{M}, {FLAGS_SQL} SELECT event_id, is_idle, is_overprovisioned, {r('waste_percentage', 'waste_percentage')},
    {r('waste_linear', 'waste_linear')}, {r('efficiency_score', 'efficiency_score')} FROM f""",
)
def waste_and_idle_flags(spark, sf_dir):
    flagged = metrics(spark, sf_dir).transform(X.with_waste_flags(FACTORS))
    return rounded(
        flagged.select(
            "event_id", "is_idle", "is_overprovisioned", "waste_percentage", "waste_linear", "efficiency_score"
        )
    )


@query(
    "rolling_overprovisioned",
    f"""{M}, w AS (SELECT event_id, sum(cpu_utilization) OVER x / 20.0 AS c, sum(memory_utilization) OVER x / 20.0 AS m
      FROM metrics WINDOW x AS (PARTITION BY resource_id ORDER BY timestamp, event_id
        ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
    SELECT event_id, {r('c', 'cpu_smooth')}, {r('m', 'memory_smooth')}, c < 20 AND m < 30 AS is_overprovisioned FROM w""",
)
def rolling_overprovisioned(spark, sf_dir):
    rolled = metrics(spark, sf_dir).transform(X.rolling_overprovisioned(order=["timestamp", "event_id"]))
    return rounded(rolled.select("event_id", "cpu_smooth", "memory_smooth", "is_overprovisioned"))


@query(
    "minmax_normalisation",
    f"""WITH f AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-20')
    SELECT event_id, {r('(value - lo) / nullif(hi - lo, 0)', 'value_norm')} FROM events, f
    WHERE ts >= TIMESTAMP '2024-01-20'""",
)
def minmax_normalisation(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    scaled = events.where(F.col("ts") >= cut).transform(X.minmax_scaled(events.where(F.col("ts") < cut), ["value"]))
    return rounded(scaled.select("event_id", "value_norm"))


def _fourier(expr: str, period: int, terms: int, prefix: str) -> str:
    return ", ".join(
        r(f"{fn}({expr} * (2.0 * {k} / {period}) * pi())", f"{prefix}_{fn}{k}")
        for k in range(1, terms + 1)
        for fn in ("cos", "sin")
    )


@query(
    "fourier_time_features",
    f"""SELECT event_id, {_fourier('hour(ts)', 24, 4, 'hour')},
    {_fourier('(isodow(ts) - 1)', 7, 2, 'weekday')} FROM events""",
)
def fourier_time_features(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return rounded(events.transform(X.calendar_features("ts")).drop("ts"))


@query(
    "category_index_encoding",
    """SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END
    AS INTEGER) AS event_index FROM events""",
)
def category_index_encoding(spark, sf_dir):
    from grainwise.functions.utilisation import category_index

    index = category_index("event_type", ["view", "click", "purchase"])
    return table(spark, sf_dir, "events").select("event_id", index.alias("event_index"))


@query("clean_training_subset", f"{M} SELECT event_id, resource_id, is_anomaly FROM metrics WHERE NOT is_anomaly")
def clean_training_subset(spark, sf_dir):
    return metrics(spark, sf_dir).transform(X.without_anomalies()).select("event_id", "resource_id", "is_anomaly")
