"""Positions, training windows, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.catalog.registry import query, r, rounded
from grainwise.operators import windows as V
from grainwise.plans.ordering import with_position
from grainwise.sources.views import METRICS_SQL, SIGNAL_SQL, metrics, signal, table

M, S = f"WITH {METRICS_SQL}", f"WITH {SIGNAL_SQL}"
KEYS, ORDER = ["series_id"], ["ts", "event_id"]


@query(
    "global_position",
    "SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS pos FROM events",
)
def global_position(spark, sf_dir):
    return with_position(table(spark, sf_dir, "events").select("event_id", "ts"), [], ["ts", "event_id"]).drop("ts")


@query("series_position", f"{S} SELECT event_id, series_id, CAST(pos AS BIGINT) AS pos, n FROM signal")
def series_position(spark, sf_dir):
    placed = with_position(signal(spark, sf_dir).select("event_id", "series_id", "ts"), KEYS, ORDER, length="n")
    return placed.drop("ts")


ROWS = """w AS (SELECT resource_id, timestamp, event_id, list(hourly_cost) OVER x AS seq,
    lead(hourly_cost, {n}) OVER y AS target, lead(timestamp, {n} - 1) OVER y AS end_time,
    row_number() OVER y - 1 AS pos, count(*) OVER (PARTITION BY resource_id) AS n FROM metrics
    WINDOW x AS (PARTITION BY resource_id ORDER BY timestamp, event_id ROWS BETWEEN CURRENT ROW AND {n} - 1 FOLLOWING),
      y AS (PARTITION BY resource_id ORDER BY timestamp, event_id))"""


@query(
    "forecast_sequences",
    f"""{M}, {ROWS.format(n=12)} SELECT resource_id, seq AS input_sequence, target, timestamp AS start_time, end_time
    FROM w WHERE pos % 6 = 0 AND pos + 12 < n""",
)
def forecast_sequences(spark, sf_dir):
    return V.forecast_sequences(metrics(spark, sf_dir), 12, 6, tie_cols=["event_id"])


@query(
    "sliding_context_windows",
    f"""{M}, {ROWS.format(n=8)} SELECT resource_id, seq AS context, target, timestamp FROM w
    WHERE pos % 3 = 0 AND pos + 8 < n""",
)
def sliding_context_windows(spark, sf_dir):
    return V.sliding_windows(metrics(spark, sf_dir), 8, 3, tie_cols=["event_id"])


ANOMALY = """a AS (SELECT resource_id, timestamp, event_id, CAST(is_anomaly AS INTEGER) AS label,
    list(cpu_utilization) OVER x AS cpu_sequence, list(memory_utilization) OVER x AS memory_sequence,
    list(hourly_cost) OVER x AS cost_sequence,
    row_number() OVER (PARTITION BY resource_id, is_anomaly ORDER BY timestamp, event_id) - 1 AS win,
    count(*) OVER (PARTITION BY resource_id, is_anomaly) AS n FROM metrics
    WINDOW x AS (PARTITION BY resource_id, is_anomaly ORDER BY timestamp, event_id
      ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))"""


@query(
    "anomaly_windows",
    f"""{M}, {ANOMALY} SELECT resource_id, timestamp, event_id, label, CAST(win AS BIGINT) AS "window", cpu_sequence,
    memory_sequence, cost_sequence FROM a WHERE win + 6 <= n""",
)
def anomaly_windows(spark, sf_dir):
    return V.anomaly_windows(metrics(spark, sf_dir), 6, tie_cols=["event_id"])


@query(
    "anomaly_oversampling",
    f"""{M}, {ANOMALY}, v AS (SELECT resource_id, label, win FROM a WHERE win + 6 <= n),
    c AS (SELECT count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS have FROM v),
    t AS (SELECT ceil(normal * 0.5) AS want, have FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', resource_id, label, win, '42')),
      resource_id, label, win) - 1 AS place FROM v WHERE label = 1),
    e AS (SELECT resource_id, label, win, unnest(range(greatest(1, CAST(floor(want / have) AS BIGINT)
      + CASE WHEN place < want % have THEN 1 ELSE 0 END))) AS replica FROM p, t)
    SELECT resource_id, label, CAST(win AS BIGINT) AS "window", CAST(replica AS INTEGER) AS replica FROM e
    UNION ALL SELECT resource_id, label, win, 0 FROM v WHERE label = 0""",
)
def anomaly_oversampling(spark, sf_dir):
    windows = V.anomaly_windows(metrics(spark, sf_dir), 6, tie_cols=["event_id"])
    return V.oversample_anomalies(windows, contamination=0.5).select("resource_id", "label", "window", "replica")


@query(
    "hash_train_test_split",
    f"""SELECT event_id, CASE WHEN CAST(('0x' || md5(concat_ws('|', event_id, '42'))[1:8]) AS BIGINT) / 4294967296.0
    < 0.8 THEN 'train' ELSE 'test' END AS split FROM events""",
)
def hash_train_test_split(spark, sf_dir):
    return V.hash_split(table(spark, sf_dir, "events").select("event_id"), ["event_id"])


@query(
    "chronological_split",
    f"""{M}, o AS (SELECT event_id, row_number() OVER (ORDER BY timestamp, resource_id, event_id) - 1 AS pos,
      count(*) OVER () AS n FROM metrics)
    SELECT event_id, CASE WHEN pos < n - floor(n * 0.2) - floor(n * 0.1) THEN 'train'
      WHEN pos < n - floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split FROM o""",
)
def chronological_split(spark, sf_dir):
    split = V.chronological_split(metrics(spark, sf_dir), tie_cols=["resource_id", "event_id"])
    return split.select("event_id", "split")


@query("every_kth_row", f"{S} SELECT series_id, event_id, CAST(pos AS BIGINT) AS pos, value FROM signal WHERE pos % 7 = 0")
def every_kth_row(spark, sf_dir):
    return V.every_kth(signal(spark, sf_dir), 7, KEYS, ORDER).select("series_id", "event_id", "pos", "value")


@query(
    "evenly_spaced_rows",
    """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)
    SELECT event_id FROM o WHERE pos IN (SELECT (k * (SELECT count(*) - 1 FROM events)) // 199 FROM range(200) t(k))""",
)
def evenly_spaced_rows(spark, sf_dir):
    return V.evenly_spaced_rows(table(spark, sf_dir, "events"), 200, ["ts", "event_id"]).select("event_id")


@query(
    "random_rows",
    """SELECT event_id, value FROM events ORDER BY md5(concat_ws('|', event_id, '42')), event_id LIMIT 500""",
)
def random_rows(spark, sf_dir):
    return V.sample_rows(table(spark, sf_dir, "events"), 500, ["event_id"]).select("event_id", "value")


@query(
    "stratified_sample",
    """WITH s AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
      ORDER BY md5(concat_ws('|', event_id, '42')), event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS c,
      count(*) OVER () AS n FROM events)
    SELECT event_id, event_type FROM s WHERE place < round(c * least(1.0, 1000.0 / n))""",
)
def stratified_sample(spark, sf_dir):
    sampled = V.sample_rows(table(spark, sf_dir, "events"), 1000, ["event_id"], stratify_col="event_type")
    return sampled.select("event_id", "event_type")


def _subsample_sql() -> str:
    stats = {
        "mean": "avg(value)", "std": "stddev_pop(value)", "variance": "var_pop(value)", "min": "min(value)",
        "max": "max(value)", "q25": "quantile_cont(value, 0.25)", "median": "quantile_cont(value, 0.5)",
        "q75": "quantile_cont(value, 0.75)",
    }
    rows = [
        f"""SELECT series_id, '{name}' AS stat, {fn} AS f, {fn} FILTER (pos % 5 = 0) AS s FROM signal GROUP BY series_id"""
        for name, fn in stats.items()
    ]
    return f"""{S}, x AS ({' UNION ALL '.join(rows)}) SELECT series_id, stat, {r('f', 'full_value', 4)},
    {r('s', 'sub_value', 4)}, {r('(s - f) / nullif(f, 0) * 100', 'diff_pct', 4)} FROM x"""


@query("subsample_statistics", _subsample_sql())
def subsample_statistics(spark, sf_dir):
    return rounded(V.subsample_statistics(signal(spark, sf_dir), 5, "value", KEYS, ORDER), 4)


def _lags_sql(source: str, lags) -> str:
    return " UNION ALL ".join(
        f"""SELECT a.series_id, CAST({k} AS INTEGER) AS lag, corr(b.value, a.value) AS autocorr FROM {source} a
        LEFT JOIN {source} b ON a.series_id = b.series_id AND b.pos = a.pos - {k} GROUP BY a.series_id"""
        for k in lags
    )


def _safe_corr(sql: str) -> str:
    """corr of one or two points, or of constants, is undefined: NULL."""
    return f"SELECT series_id, lag, {r('CASE WHEN isnan(autocorr) THEN NULL ELSE autocorr END', 'autocorr', 5)} FROM ({sql})"


@query("lag_correlations", f"{S} {_safe_corr(_lags_sql('signal', (1, 5, 24)))}")
def lag_correlations(spark, sf_dir):
    return rounded(V.lag_correlations(signal(spark, sf_dir), "value", [1, 5, 24], KEYS, ORDER), 5)


@query(
    "subsample_autocorrelation",
    f"""{S}, sub AS (SELECT series_id, pos // 5 AS pos, value FROM signal WHERE pos % 5 = 0),
    f AS ({_lags_sql('signal', (1, 10, 20))}), s AS ({_lags_sql('sub', (2, 4))})
    SELECT f.series_id, f.lag, CAST(f.lag // 5 AS INTEGER) AS sub_lag, {r('f.autocorr', 'full_autocorr', 5)},
      {r('s.autocorr', 'sub_autocorr', 5)}, coalesce(abs(f.autocorr - s.autocorr) < 0.1, false) AS preserved
    FROM f LEFT JOIN s ON f.series_id = s.series_id AND s.lag = f.lag // 5""",
)
def subsample_autocorrelation(spark, sf_dir):
    compared = V.subsample_autocorrelation(signal(spark, sf_dir), 5, "value", KEYS, ORDER, (1, 10, 20))
    return rounded(compared, 5)


@query(
    "large_random_pick",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, '42')), l_orderkey, l_linenumber, l_partkey LIMIT 20000""",
)
def large_random_pick(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return V.sample_rows(table(spark, sf_dir, "lineitem").select(*keys), 20000, keys)


@query(
    "anomaly_training_set",
    f"""{M}, {ANOMALY}, v AS (SELECT *, CAST(win AS BIGINT) AS "window" FROM a WHERE win + 6 <= n),
    c AS (SELECT count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS have FROM v),
    t AS (SELECT ceil(normal * 0.5) AS want, have FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', resource_id, label, win, '42')),
      resource_id, label, win) - 1 AS place FROM v WHERE label = 1),
    e AS (SELECT resource_id, label, "window", cpu_sequence, memory_sequence, cost_sequence,
        CAST(unnest(range(greatest(1, CAST(floor(want / have) AS BIGINT) + CASE WHEN place < want % have THEN 1 ELSE 0 END))) AS INTEGER) AS replica FROM p, t
      UNION ALL SELECT resource_id, label, "window", cpu_sequence, memory_sequence, cost_sequence, 0 FROM v WHERE label = 0),
    s AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', resource_id, label, "window", replica, '42')), resource_id, label, "window", replica) - 1 AS shuffled_at,
      count(*) OVER () AS total FROM e)
    SELECT resource_id, label, "window", replica, cpu_sequence, memory_sequence, cost_sequence, shuffled_at,
      CASE WHEN shuffled_at < floor(total * 0.8) THEN 'train' ELSE 'test' END AS split FROM s""",
)
def anomaly_training_set(spark, sf_dir):
    return V.anomaly_training_set(metrics(spark, sf_dir), 6, 0.5, tie_cols=["event_id"]).drop("timestamp", "event_id")
