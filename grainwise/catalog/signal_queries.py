"""Autocorrelation, spectra, seasonality and unit roots of the event series."""

from __future__ import annotations

from grainwise.catalog.registry import query, r, rounded
from grainwise.operators import signals as G
from grainwise.sources.views import SIGNAL_SQL, signal, table

KEYS, ORDER = ["series_id"], ["ts", "event_id"]
ARGS = (KEYS, ORDER, "value")
LAGS = 30
S = f"WITH {SIGNAL_SQL}"
ACF = f"""{S}, c AS (SELECT series_id, pos, n, value - avg(value) OVER (PARTITION BY series_id) AS x FROM signal),
  p AS (SELECT a.series_id, k AS lag, any_value(a.n) AS n, coalesce(sum(a.x * b.x), 0) AS s FROM c a
    JOIN range({LAGS + 1}) t(k) ON k <= a.n // 2 LEFT JOIN c b ON a.series_id = b.series_id AND b.pos = a.pos + k
    GROUP BY a.series_id, k),
  acf AS (SELECT series_id, lag, s / nullif(max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY series_id), 0) AS acf, n
    FROM p)"""


def acf(spark, sf_dir):
    return G.autocorrelation(signal(spark, sf_dir), *ARGS, max_lag=LAGS)


@query(
    "autocorrelation_function",
    f"""{ACF} SELECT series_id, CAST(lag AS INTEGER) AS lag, {r('acf', 'acf')}, {r('1.96 / sqrt(n)', 'confidence')} FROM acf""",
)
def autocorrelation_function(spark, sf_dir):
    return rounded(acf(spark, sf_dir))


def by_type(spark, sf_dir):
    """A few long series, one of event types; long enough for the default lags and distances."""
    return table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")


TYPED = (["event_type"], ORDER, "value")


@query("autocorrelation_peaks")
def autocorrelation_peaks(spark, sf_dir):
    return rounded(G.acf_peaks(G.autocorrelation(by_type(spark, sf_dir), *TYPED), ["event_type"], height=0.05))


@query(
    "forecast_horizon_limits",
    f"""{ACF}, l AS (SELECT series_id, coalesce(min(lag) FILTER (acf < 0.3), count(*)) AS m FROM acf GROUP BY series_id)
    SELECT series_id, CAST(least(50, m // 4) AS INTEGER) AS short_term, CAST(least(200, m // 2) AS INTEGER) AS medium_term,
      CAST(m AS INTEGER) AS long_term FROM l""",
)
def forecast_horizon_limits(spark, sf_dir):
    return G.forecast_horizons(acf(spark, sf_dir), KEYS)


WELCH = f"""{S}, c AS (SELECT series_id, pos, n, value, least(2048, n // 4) AS size FROM signal WHERE n >= 8),
  d AS (SELECT *, size - size // 2 AS step, (n - size // 2) // (size - size // 2) AS segs FROM c),
  g AS (SELECT series_id, n, size, seg, pos - seg * step AS t, value - avg(value) OVER (PARTITION BY series_id, seg) AS x
    FROM d JOIN range(600) s(seg) ON seg < segs AND pos >= seg * step AND pos < seg * step + size),
  w AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * t / size) AS taper FROM g),
  f AS (SELECT series_id, n, size, seg, bin, (sum(x * taper * cos(2 * pi() * bin * t / size)) ** 2
      + sum(x * taper * sin(2 * pi() * bin * t / size)) ** 2) / sum(taper * taper)
      * CASE WHEN bin = 0 OR (size % 2 = 0 AND bin = size / 2) THEN 1 ELSE 2 END AS power
    FROM w JOIN range(1025) b(bin) ON bin <= size // 2 GROUP BY series_id, n, size, seg, bin),
  psd AS (SELECT series_id, bin, bin / any_value(size) AS frequency, any_value(n) AS n, avg(power) AS psd
    FROM f GROUP BY series_id, bin)"""


@query(
    "welch_power_spectrum",
    f"""{WELCH} SELECT series_id, CAST(bin AS INTEGER) AS bin, {r('frequency', 'frequency')}, {r('1 / frequency', 'period')},
    {r('psd', 'psd', 4)} FROM psd WHERE bin > 0 AND 1 / frequency >= 2 AND 1 / frequency <= n / 2""",
)
def welch_power_spectrum(spark, sf_dir):
    return rounded(G.welch_psd(signal(spark, sf_dir), *ARGS), 6, psd=4)


@query("spectral_peaks")
def spectral_peaks(spark, sf_dir):
    return rounded(G.spectral_peaks(G.welch_psd(by_type(spark, sf_dir), *TYPED), ["event_type"]), 6, power=4)


def _decomposition(period: int) -> str:
    half = period // 2
    ends = f"- 0.5 * (lag(value, {half}) OVER o + lead(value, {half}) OVER o)" if period % 2 == 0 else ""
    return f"""{S}, t AS (SELECT series_id, event_id, pos, value, pos % {period} AS phase,
      CASE WHEN count(value) OVER w = {2 * half + 1} THEN (sum(value) OVER w {ends}) / {period} END AS trend FROM signal
      WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING),
        o AS (PARTITION BY series_id ORDER BY pos)),
    p AS (SELECT series_id, phase, avg(value - trend) AS m FROM t GROUP BY ALL),
    q AS (SELECT series_id, phase, m - avg(m) OVER (PARTITION BY series_id) AS seasonal FROM p),
    dec AS (SELECT series_id, event_id, CAST(t.pos AS BIGINT) AS pos, value, trend, seasonal,
      value - trend - seasonal AS residual FROM t LEFT JOIN q USING (series_id, phase))"""


@query(
    "seasonal_decomposition",
    f"""{_decomposition(6)} SELECT series_id, event_id, pos, {r('trend', 'trend', 7)}, {r('seasonal', 'seasonal', 7)},
    {r('residual', 'residual', 7)} FROM dec""",
)
def seasonal_decomposition(spark, sf_dir):
    parts = G.seasonal_decomposition(signal(spark, sf_dir), *ARGS, period=6)
    return rounded(parts.select("series_id", "event_id", "pos", "trend", "seasonal", "residual"), 7)


@query(
    "seasonality_strength",
    f"""{_decomposition(7)}, st AS (SELECT series_id, greatest(0, 1 - var_pop(residual) /
      nullif(var_pop(CASE WHEN residual IS NOT NULL THEN seasonal + residual END), 0)) AS s FROM dec GROUP BY series_id)
    SELECT series_id, {r('s', 'strength')}, CASE WHEN s > 0.6 THEN 'Strong' WHEN s > 0.3 THEN 'Moderate' ELSE 'Weak' END
      AS classification FROM st""",
)
def seasonality_strength(spark, sf_dir):
    parts = G.seasonal_decomposition(signal(spark, sf_dir), *ARGS, period=7)
    return rounded(G.seasonality_strength(parts, KEYS))


@query("adf_stationarity")
def adf_stationarity(spark, sf_dir):
    return rounded(G.adf_test(signal(spark, sf_dir), *ARGS))


ADF0 = f"""{S}, c AS (SELECT series_id, pos, n, value - avg(value) OVER (PARTITION BY series_id) AS x FROM signal),
  d AS (SELECT series_id, x AS cur, lag(x) OVER (PARTITION BY series_id ORDER BY pos) AS prev FROM c),
  a AS (SELECT series_id, count(*) AS m, regr_slope(cur - prev, prev) AS g, regr_sxx(cur - prev, prev) AS sxx,
    regr_syy(cur - prev, prev) AS syy FROM d WHERE prev IS NOT NULL GROUP BY series_id)"""


@query(
    "dickey_fuller_statistic",
    f"""{ADF0} SELECT series_id, {r('g / sqrt((syy - g * g * sxx) / (m - 2) / sxx)', 'adf_statistic', 5)}, m AS nobs FROM a""",
)
def dickey_fuller_statistic(spark, sf_dir):
    """Without lagged differences the test is a simple regression, which SQL can repeat."""
    return rounded(G.adf_test(signal(spark, sf_dir), *ARGS, max_lag=0).select("series_id", "adf_statistic", "nobs"), 5)
