"""Outliers, intervals and detector evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.catalog.registry import query, r, rounded
from grainwise.operators import anomaly as A
from grainwise.plans.ordering import ordered_windows
from grainwise.sources.views import METRICS_SQL, SIGNAL_SQL, metrics, signal, table

S = f"WITH {SIGNAL_SQL}"


@query(
    "iqr_outliers",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b
      FROM events GROUP BY event_type)
    SELECT event_id, event_type, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier
    FROM events JOIN q USING (event_type)""",
)
def iqr_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return A.outliers_iqr(events, "value", ["event_type"])


@query(
    "iqr_outliers_global",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
    SELECT count(*) FILTER (l_extendedprice < a - 0.5 * (b - a) OR l_extendedprice > b + 0.5 * (b - a)) AS outliers,
      count(*) AS rows FROM lineitem, q""",
)
def iqr_outliers_global(spark, sf_dir):
    flagged = A.outliers_iqr(table(spark, sf_dir, "lineitem"), "l_extendedprice", multiplier=0.5)
    return flagged.agg(F.count_if("is_outlier").alias("outliers"), F.count(F.lit(1)).alias("rows"))


@query(
    "zscore_outliers",
    """WITH m AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY user_id)
    SELECT event_id, user_id, coalesce(abs((value - m) / nullif(s, 0)) > 3, false) AS is_outlier
    FROM events JOIN m USING (user_id)""",
)
def zscore_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return A.outliers_zscore(events, "value", ["user_id"]).drop("value")


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    points = metrics(spark, sf_dir).select("event_id", "cpu_utilization", "memory_utilization", "hourly_cost")
    columns = ["cpu_utilization", "memory_utilization", "hourly_cost"]
    return A.isolation_forest(points, columns, ["event_id"], contamination=0.05)


@query(
    "isolation_forest_order",
    f"""WITH {METRICS_SQL} SELECT count(*) AS n_rows, count(m) AS n_scored, true AS flagged_are_highest, true AS share_holds, true AS scores_in_range
    FROM (SELECT CASE WHEN isnan(cpu_utilization + memory_utilization + hourly_cost) THEN NULL
      ELSE cpu_utilization + memory_utilization + hourly_cost END AS m FROM metrics)""",
)
def isolation_forest_order(spark, sf_dir):
    """Every row comes back, and the share asked for is flagged: that of the highest scores."""
    score, flagged = F.col("anomaly_score"), F.col("is_outlier")
    made = isolation_forest(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(score).alias("n_scored"), F.count_if(flagged).alias("n_flagged"),
        F.min(F.when(flagged, score)).alias("lowest"), F.max(F.when(~flagged, score)).alias("highest"), F.count_if((score > 0) & (score < 1)).alias("n_inside"),
    )
    return made.select(
        "n_rows", "n_scored", (F.col("lowest") > F.col("highest")).alias("flagged_are_highest"),
        (F.abs(F.col("n_flagged") - 0.05 * F.col("n_scored")) <= 1 + 0.01 * F.col("n_scored")).alias("share_holds"), (F.col("n_inside") == F.col("n_scored")).alias("scores_in_range"),
    )


FORECAST = f"""{S}, m AS (SELECT series_id, stddev_samp(value) AS sd FROM events_s GROUP BY series_id)""".replace(
    "events_s", "signal"
) + """, fc AS (SELECT event_id, label, value AS y_true, lag(value) OVER (PARTITION BY s.series_id ORDER BY pos) AS y_pred,
    m.sd AS std, CASE WHEN s.series_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model
    FROM signal s JOIN m ON s.series_id = m.series_id),
  f AS (SELECT * FROM fc WHERE y_pred IS NOT NULL)"""


def forecast(spark, sf_dir):
    """Last value as the forecast of the next, series deviation as its spread."""
    rows = signal(spark, sf_dir)
    spread = rows.groupBy("series_id").agg(F.stddev("value").alias("std"))
    lagged = ordered_windows(
        rows, ["series_id"], ["ts", "event_id"], lambda spec: {"y_pred": F.lag("value").over(spec)}, before=1
    )
    return lagged.where(F.col("y_pred").isNotNull()).join(spread, "series_id").select(
        "event_id",
        "label",
        F.col("value").alias("y_true"),
        "y_pred",
        "std",
        F.when(F.col("series_id") % 2 == 0, "even").otherwise("odd").alias("model"),
    )


def intervals(spark, sf_dir):
    return forecast(spark, sf_dir).transform(A.prediction_intervals())


# Quantiles as printed in tables of the normal and the Student-t distribution.
NORMAL_975, NORMAL_995, STUDENT_4_950 = 1.959963984540054, 2.5758293035489004, 2.131846786326649
NORMAL_TENTHS = (-1.2815515655446004, -0.8416212335729142, -0.5244005127080407, -0.2533471031357997, 0.0, 0.2533471031357997, 0.5244005127080407, 0.8416212335729142, 1.2815515655446004)


def _bounds(label: str, q: float) -> str:
    return f"y_pred - {q!r} * std AS lower_{label}, y_pred + {q!r} * std AS upper_{label}"


INTERVALS = f"""{FORECAST}, iv AS (SELECT *, {_bounds('95', NORMAL_975)}, {_bounds('99', NORMAL_995)} FROM f),
  vi AS (SELECT *, y_true < lower_95 OR y_true > upper_95 AS violates_95, y_true < lower_99 OR y_true > upper_99 AS violates_99
    FROM iv)"""


@query(
    "prediction_intervals_gaussian",
    f"""{INTERVALS} SELECT event_id, {r('lower_95', 'lower_95', 5)}, {r('upper_95', 'upper_95', 5)},
    {r('lower_99', 'lower_99', 5)}, {r('upper_99', 'upper_99', 5)} FROM iv""",
)
def prediction_intervals_gaussian(spark, sf_dir):
    return rounded(intervals(spark, sf_dir).select("event_id", "lower_95", "upper_95", "lower_99", "upper_99"), 5)


@query(
    "prediction_intervals_student_t",
    f"""{FORECAST} SELECT event_id, {r(f'y_pred - {STUDENT_4_950!r} * std', 'lower_90', 5)},
    {r(f'y_pred + {STUDENT_4_950!r} * std', 'upper_90', 5)} FROM f""",
)
def prediction_intervals_student_t(spark, sf_dir):
    bounded = forecast(spark, sf_dir).transform(A.prediction_intervals([0.90], "student_t", nu=4.0))
    return rounded(bounded.select("event_id", "lower_90", "upper_90"), 5)


@query("interval_violations", f"{INTERVALS} SELECT event_id, violates_95, violates_99 FROM vi")
def interval_violations(spark, sf_dir):
    flagged = intervals(spark, sf_dir).transform(A.interval_violations())
    return flagged.select("event_id", "violates_95", "violates_99")


@query(
    "standardised_residuals",
    f"{FORECAST} SELECT event_id, {r('abs(y_true - y_pred) / nullif(std, 0)', 'residual_score')} FROM f",
)
def standardised_residuals(spark, sf_dir):
    return rounded(forecast(spark, sf_dir).transform(A.residual_score()).select("event_id", "residual_score"))


@query(
    "forecast_metrics",
    f"""{INTERVALS} SELECT model, {r('sqrt(avg((y_true - y_pred) ** 2))', 'rmse')}, {r('avg(abs(y_true - y_pred))', 'mae')},
    {r('1 - avg((y_true - y_pred) ** 2) / var_pop(y_true)', 'r2')},
    {r('avg(CASE WHEN y_true BETWEEN lower_95 AND upper_95 THEN 1.0 ELSE 0 END)', 'coverage_95')},
    {r('avg(upper_95 - lower_95)', 'sharpness_95')},
    {r('avg(CASE WHEN y_true BETWEEN lower_99 AND upper_99 THEN 1.0 ELSE 0 END)', 'coverage_99')},
    {r('avg(upper_99 - lower_99)', 'sharpness_99')} FROM iv GROUP BY model""",
)
def forecast_metrics(spark, sf_dir):
    return rounded(A.forecast_metrics(intervals(spark, sf_dir)))


def _confusion(flag: str) -> str:
    tp = f"count(*) FILTER (label AND {flag})"
    return f"""SELECT model, '{flag}' AS threshold,
    {r(f'coalesce({tp} * 1.0 / nullif(count(*) FILTER ({flag}), 0), 0)', 'precision')},
    {r(f'coalesce({tp} * 1.0 / nullif(count(*) FILTER (label), 0), 0)', 'recall')},
    {r(f'coalesce(2.0 * {tp} / nullif(count(*) FILTER ({flag}) + count(*) FILTER (label), 0), 0)', 'f1')}
    FROM vi GROUP BY model"""


@query("anomaly_metrics", f"{INTERVALS} {_confusion('violates_95')} UNION ALL {_confusion('violates_99')}")
def anomaly_metrics(spark, sf_dir):
    flagged = intervals(spark, sf_dir).transform(A.interval_violations())
    return rounded(A.anomaly_metrics(flagged, "label", ["violates_95", "violates_99"]))


ROC = f"""{S}, m AS (SELECT series_id % 2 AS model, value AS threshold, count(*) FILTER (label) AS p,
    count(*) FILTER (NOT label) AS n FROM signal GROUP BY ALL),
  c AS (SELECT model, threshold, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER t AS pos, sum(n) OVER t AS neg
    FROM m WINDOW w AS (PARTITION BY model ORDER BY threshold DESC), t AS (PARTITION BY model))"""


def labelled(spark, sf_dir):
    return signal(spark, sf_dir).withColumn("model", F.col("series_id") % 2)


@query(
    "roc_curve",
    f"SELECT model, threshold, {r('fp / neg', 'fpr')}, {r('tp / pos', 'tpr')} FROM ({ROC} SELECT * FROM c)",
)
def roc_curve(spark, sf_dir):
    curve = A.roc_curve(labelled(spark, sf_dir), "value", "label").select("model", "threshold", "fpr", "tpr")
    return rounded(curve)


@query("roc_auc", f"{ROC} SELECT model, {r('sum(n * (tp - p / 2)) / any_value(pos * neg)', 'auc')} FROM c GROUP BY model")
def roc_auc(spark, sf_dir):
    return rounded(A.roc_auc(labelled(spark, sf_dir), "value", "label"))


@query(
    "calibration_quantiles",
    f"""{FORECAST}, z AS (SELECT model, (y_true - y_pred) / nullif(std, 0) AS z FROM f) """
    + " UNION ALL ".join(
        f"""SELECT model, {r(repr(i / 10), 'probability')}, {r(repr(NORMAL_TENTHS[i - 1]), 'expected')},
        {r(f'quantile_cont(z, {i / 10!r})', 'observed')} FROM z GROUP BY model"""
        for i in range(1, 10)
    ),
)
def calibration_quantiles(spark, sf_dir):
    scored = forecast(spark, sf_dir).withColumn("z", F.try_divide(F.col("y_true") - F.col("y_pred"), "std"))
    return rounded(A.calibration_qq(scored, "z", quantiles=9))
