"""Baseline forecasts and their scores."""

from __future__ import annotations

from grainwise.catalog.registry import query, r, rounded
from grainwise.operators import forecast as F_
from grainwise.sources.views import SIGNAL_SQL, signal

KEYS, ORDER = ["series_id"], ["ts", "event_id"]
S = f"WITH {SIGNAL_SQL}"


def train(spark, sf_dir):
    return F_.positioned(signal(spark, sf_dir), KEYS, ORDER)


@query(
    "naive_forecast",
    f"""{S} SELECT series_id, CAST(h AS INTEGER) AS step, {r('value', 'y_pred')}
    FROM signal, range(1, 9) t(h) WHERE pos = n - 1""",
)
def naive_forecast(spark, sf_dir):
    return rounded(F_.naive_forecast(train(spark, sf_dir), KEYS, "value", 8))


@query(
    "seasonal_naive_forecast",
    f"""{S} SELECT series_id, CAST(h AS INTEGER) AS step, {r('value', 'y_pred')}
    FROM signal, range(1, 18) t(h) WHERE n >= 7 AND pos = n - 7 + (h - 1) % 7""",
)
def seasonal_naive_forecast(spark, sf_dir):
    return rounded(F_.seasonal_naive_forecast(train(spark, sf_dir), KEYS, "value", 17, 7))


@query(
    "moving_average_forecast",
    f"""{S}, a AS (SELECT series_id, avg(value) AS m FROM signal WHERE pos >= n - 6 GROUP BY series_id)
    SELECT series_id, CAST(h AS INTEGER) AS step, {r('m', 'y_pred')} FROM a, range(1, 6) t(h)""",
)
def moving_average_forecast(spark, sf_dir):
    return rounded(F_.moving_average_forecast(train(spark, sf_dir), KEYS, "value", 5, 6))


H = 10
SCORED = f"""{S}, tr AS (SELECT series_id, pos, value, n - {H} AS n FROM signal WHERE n > {H} AND pos < n - {H}),
  te AS (SELECT series_id, pos - (n - {H}) + 1 AS step, value AS y FROM signal WHERE n > {H} AND pos >= n - {H}),
  sc AS (SELECT series_id, avg(abs(d)) AS scale FROM (SELECT series_id, value - lag(value) OVER
    (PARTITION BY series_id ORDER BY pos) AS d FROM tr) GROUP BY series_id),
  fc AS (SELECT 'naive' AS model, series_id, step, value AS p FROM te JOIN tr USING (series_id) WHERE tr.pos = n - 1
    UNION ALL SELECT 'seasonal_naive_' || k, te.series_id, step, value FROM te JOIN tr USING (series_id),
      (VALUES (3), (7)) s(k) WHERE n >= k AND tr.pos = n - k + (step - 1) % k
    UNION ALL SELECT 'moving_average_5', te.series_id, step, m FROM te JOIN
      (SELECT series_id, avg(value) AS m FROM tr WHERE pos >= n - 5 GROUP BY series_id) a USING (series_id)),
  g AS (SELECT model, abs(y - p) AS e, y, scale FROM fc JOIN te USING (series_id, step) JOIN sc USING (series_id)),
  t AS (SELECT model, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, avg(e / nullif(abs(y), 0)) * 100 AS mape,
    avg(e / nullif(scale, 0)) AS mase FROM g GROUP BY model)"""


def comparison(spark, sf_dir):
    return F_.compare_baselines(signal(spark, sf_dir), KEYS, ORDER, "value", H, periods=[3, 7], windows=[5])


@query(
    "baseline_comparison",
    f"""{SCORED} SELECT model, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('mape', 'mape', 4)}, {r('mase', 'mase')},
    model = (SELECT model FROM t ORDER BY mase, model LIMIT 1) AS best FROM t""",
)
def baseline_comparison(spark, sf_dir):
    return rounded(comparison(spark, sf_dir), 6, mape=4)


@query(
    "best_seasonal_period",
    f"""{SCORED} SELECT CAST(replace(model, 'seasonal_naive_', '') AS INTEGER) AS best_period, {r('mase', 'mase')}
    FROM t WHERE starts_with(model, 'seasonal_naive_') ORDER BY t.mase, model LIMIT 1""",
)
def best_seasonal_period(spark, sf_dir):
    return rounded(F_.best_period(comparison(spark, sf_dir)))


@query(
    "rolling_origin_backtest",
    f"""{S}, o AS (SELECT series_id, value, c, pos - (n - c) AS off FROM signal, (VALUES (5), (10), (20)) v(c) WHERE n > c),
    f AS (SELECT series_id, c, arg_max(value, off) AS naive, avg(value) AS ma FROM o WHERE off BETWEEN -5 AND -1 GROUP BY ALL),
    g AS (SELECT c, value AS y, naive, ma FROM o JOIN f USING (series_id, c) WHERE off BETWEEN 0 AND 4),
    l AS (SELECT c, 'naive' AS model, y, abs(y - naive) AS e FROM g
      UNION ALL SELECT c, 'moving_average', y, abs(y - ma) FROM g)
    SELECT CAST(c AS INTEGER) AS cutoff, model, {r('avg(e)', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')},
      {r('avg(e / nullif(abs(y), 0)) * 100', 'mape', 4)} FROM l GROUP BY c, model""",
)
def rolling_origin_backtest(spark, sf_dir):
    return rounded(F_.backtest(signal(spark, sf_dir), KEYS, ORDER, "value", 5, [5, 10, 20]), 6, mape=4)


@query(
    "seasonal_backtest",
    f"""{S}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY pos)) AS step_error FROM signal),
    o AS (SELECT series_id, value, step_error, n, c, pos - (n - c) AS off FROM d, (VALUES (6), (12), (24)) v(c)),
    z AS (SELECT series_id, c, avg(step_error) AS scale FROM o WHERE off < 0 GROUP BY ALL),
    f AS (SELECT series_id, c, arg_max(value, off) AS naive, avg(value) AS ma FROM o WHERE off BETWEEN -5 AND -1 AND n > c GROUP BY ALL),
    g AS (SELECT series_id, c, off, value AS y FROM o WHERE off BETWEEN 0 AND 5),
    l AS (SELECT series_id, c, 'naive' AS model, y, abs(y - naive) AS e FROM g JOIN f USING (series_id, c)
      UNION ALL SELECT series_id, c, 'moving_average', y, abs(y - ma) FROM g JOIN f USING (series_id, c)
      UNION ALL SELECT g.series_id, g.c, 'seasonal_naive_' || p, y, abs(y - o.value) FROM g, (VALUES (4), (7)) w(p), o
        WHERE o.series_id = g.series_id AND o.c = g.c AND o.n - o.c >= p AND o.off = g.off % p - p)
    SELECT CAST(c AS INTEGER) AS cutoff, model, {r('avg(e)', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')},
      {r('avg(e / nullif(abs(y), 0)) * 100', 'mape', 4)}, {r('avg(e / nullif(scale, 0))', 'mase')}
    FROM l JOIN z USING (series_id, c) GROUP BY c, model""",
)
def seasonal_backtest(spark, sf_dir):
    scores = F_.backtest(signal(spark, sf_dir), KEYS, ORDER, "value", 6, [6, 12, 24], periods=[4, 7])
    return rounded(scores, 6, mape=4)
