"""Signal operators against direct NumPy formulas, on several blocks and on both paths."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.operators import signals as G


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    t = np.arange(600)
    walk = np.cumsum(rng.normal(size=300))
    return {"wave": 10 + 3 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.5, 600), "walk": walk, "tiny": np.array([1.0, 2.0, 4.0])}


@pytest.fixture
def table(spark, series):
    data = [(k, i, float(v)) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, "k string, t int, v double").repartition(4)


ARGS = (["k"], ["t"], "v")


@pytest.mark.parametrize("block", [64, 65536])
def test_autocorrelation(table, series, either_path, block):
    out = G.autocorrelation(table, *ARGS, max_lag=60, block_rows=block)
    got = {(r.k, r.lag): r.acf for r in out.collect()}
    for key, v in series.items():
        x, lags = v - v.mean(), min(60, len(v) // 2)
        for lag in range(lags + 1):
            assert got[(key, lag)] == pytest.approx(np.sum(x[: len(x) - lag] * x[lag:]) / np.sum(x * x), abs=1e-9)
        assert (key, lags + 1) not in got


def test_peaks_and_horizon_of_a_wave(table):
    acf = G.autocorrelation(table, *ARGS, max_lag=200)
    peaks = [r.lag for r in G.acf_peaks(acf, ["k"]).where("k = 'wave'").orderBy("lag").collect()]
    assert peaks[:3] == pytest.approx([24, 48, 72], abs=1)
    horizon = {r.k: r for r in G.forecast_horizons(acf, ["k"]).collect()}
    assert horizon["wave"].long_term == 5 and horizon["wave"].short_term == 1


def test_welch(table, series, either_path):
    out = {(r.k, r.bin): r for r in G.welch_psd(table, *ARGS, max_segment=128).collect()}
    v = series["wave"] - series["wave"].mean()
    m, step = 128, 64
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
    spectra = []
    for s in range((len(v) - m // 2) // step):
        part = v[s * step : s * step + m]
        power = np.abs(np.fft.rfft((part - part.mean()) * taper)) ** 2 / np.sum(taper**2)
        power[1:-1] *= 2
        spectra.append(power)
    want = np.mean(spectra, axis=0)
    got = np.array([out[("wave", b)].psd for b in range(1, m // 2 + 1)])
    assert got == pytest.approx(want[1:])
    assert not any(k == "tiny" for k, _ in out)


def test_spectral_peak_of_a_wave(table):
    psd = G.welch_psd(table, *ARGS)
    top = G.spectral_peaks(psd, ["k"]).where("k = 'wave' and rank = 1").first()
    assert top.period == pytest.approx(24, rel=0.1) and top.strength == "Very Strong"


def test_peak_helpers():
    y = np.array([0, 2, 2, 0, 5, 1, 3, 0.0])
    assert list(G._local_maxima(y)) == [1, 4, 6]
    assert list(G._apart(np.array([1, 4, 6]), y[[1, 4, 6]], 3)) == [1, 4]
    assert [G._prominence(y, p) for p in (1, 4, 6)] == [2.0, 5.0, 2.0]


@pytest.mark.parametrize("period", [24, 7])
def test_decomposition_adds_up(table, series, either_path, period):
    parts = G.seasonal_decomposition(table, *ARGS, period=period).where("k = 'wave'").orderBy("pos").collect()
    v, half = series["wave"], period // 2
    kernel = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    want = np.convolve(v, kernel, "valid")
    got = [r.trend for r in parts[half : len(parts) - half]]
    assert got == pytest.approx(list(want)) and parts[0].trend is None and parts[-1].trend is None
    assert all(abs(r.trend + r.seasonal + r.residual - r.v) < 1e-9 for r in parts if r.trend is not None)


def test_strength_separates_wave_from_walk(table):
    strength = {r.k: r for r in G.seasonality_strength(G.seasonal_decomposition(table, *ARGS, period=24), ["k"]).collect()}
    assert strength["wave"].classification == "Strong" and strength["wave"].strength > 0.9
    assert strength["walk"].strength < 0.6 and strength["tiny"].strength == 0.0


def regression(v, lags, start):
    """t-value of the level and AIC by ordinary least squares on rows start.."""
    dx = np.diff(v)
    at = np.arange(start, len(v))
    x = np.column_stack([np.ones(len(at)), v[at - 1], *(dx[at - 1 - i] for i in range(1, lags + 1))])
    y = dx[at - 1]
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = np.sum((y - x @ beta) ** 2)
    n, k = x.shape
    error = np.sqrt(rss / (n - k) * np.linalg.inv(x.T @ x)[1, 1])
    return beta[1] / error, n * (np.log(2 * np.pi * rss / n) + 1) + 2 * k, n


@pytest.mark.parametrize("block", [50, 65536])
def test_adf_matches_least_squares(table, series, either_path, block):
    got = {r.k: r for r in G.adf_test(table, *ARGS, max_lag=6, block_rows=block).collect()}
    for key in ("wave", "walk"):
        v = series[key]
        best = min(range(7), key=lambda p: regression(v, p, 7)[1])
        statistic, _, n = regression(v, best, best + 1)
        assert got[key].used_lag == best and got[key].nobs == n
        assert got[key].adf_statistic == pytest.approx(statistic, rel=1e-6)
    assert got["wave"].stationary and not got["walk"].stationary


def test_adf_constants():
    # Published 5 % point for 100 observations and its p-value.
    assert G._polynomial(G.CRITICAL["critical_5"], 1 / 100) == pytest.approx(-2.891, abs=2e-3)
    assert G._adf_p_value(-2.8615) == pytest.approx(0.05, abs=2e-3)
    assert G._adf_p_value(5.0) == 1.0 and G._adf_p_value(-30.0) == 0.0
    assert G.adf_lags(100) == 12 and G.adf_lags(4) == 0
