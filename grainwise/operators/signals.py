"""Signal statistics of many long series: autocorrelation, spectra, seasonality, unit roots.

Python sees bounded pieces only: a block of rows with its halo, one spectral segment, or
one already aggregated table per series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.functions.stats import known
from grainwise.plans.ordering import BLOCK_ROWS, map_pieces, ordered_windows, spread, with_blocks, with_position
from grainwise.plans.scratch import join_measured, join_on_keys, materialize


def _centred(df: DataFrame, keys: Sequence[str], order: Sequence[str], value_col: str) -> DataFrame:
    """(keys, pos, n, x): positions with the value less its series mean.

    A missing value (NULL or NaN) keeps its position and stands at the mean: it adds nothing
    to any product, and what lies beyond the gap keeps its distance.
    """
    keys = list(keys)
    rows = df.select(*keys, *order, known(value_col).alias("v"))
    means = rows.groupBy(*keys).agg(F.avg("v").alias("mean"))
    placed = with_position(rows, keys, order, pos="pos", length="n")
    x = F.coalesce(F.col("v") - F.col("mean"), F.lit(0.0))
    return join_measured(placed, means, keys).select(*keys, "pos", "n", x.alias("x"))


def _keys_schema(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


# -- autocorrelation ----------------------------------------------------------------


def autocorrelation(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value_col: str,
    max_lag: int = 1000,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Biased autocorrelation up to ``max_lag`` (at most half the series), with its bound.

    Every block multiplies its own rows with those up to ``max_lag`` ahead; the partial
    products of all blocks are added up per series and lag.
    """
    keys = list(keys)
    x = _centred(df, keys, order, value_col)
    blocks = with_blocks(x, before=0, after=max_lag, size=max(block_rows, max_lag))

    def products(piece: pd.DataFrame) -> dict[str, np.ndarray]:
        x, home = piece["x"].to_numpy(), piece["__home"].to_numpy()
        n = int(piece["n"].iloc[0])
        own, lags = x[home], min(max_lag, n // 2)
        ahead = np.zeros(len(own) + lags)
        ahead[: min(len(x), len(ahead))] = x[: len(ahead)]
        return {"lag": np.arange(lags + 1), "s": np.correlate(ahead, own, "valid"), "n": np.full(lags + 1, n)}

    partial = map_pieces(blocks, keys, products, "lag int, s double, n bigint")
    summed = partial.groupBy(*keys, "lag").agg(F.sum("s").alias("s"), F.max("n").alias("n"))
    # At most max_lag + 1 rows per series.
    at_zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(*keys))
    return summed.select(
        *keys,
        "lag",
        F.try_divide("s", at_zero).alias("acf"),
        (F.lit(1.96) / F.sqrt(F.col("n").cast("double"))).alias("confidence"),
    )


# -- peaks --------------------------------------------------------------------------


def _local_maxima(y: np.ndarray) -> np.ndarray:
    """Indices of strict local maxima; a flat top counts once, at its middle."""
    if len(y) < 3:
        return np.array([], dtype=int)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(y) != 0) + 1])
    ends = np.concatenate([starts[1:] - 1, [len(y) - 1]])
    levels = y[starts]
    top = np.zeros(len(starts), dtype=bool)
    top[1:-1] = (levels[1:-1] > levels[:-2]) & (levels[1:-1] > levels[2:])
    return (starts[top] + ends[top]) // 2


def _apart(peaks: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Keep the highest peaks such that no two are closer than ``distance``."""
    kept: list[int] = []
    for i in np.argsort(heights, kind="stable")[::-1]:
        if all(abs(int(peaks[i]) - k) >= distance for k in kept):
            kept.append(int(peaks[i]))
    return np.array(sorted(kept), dtype=int)


def _prominence(y: np.ndarray, peak: int) -> float:
    """Height above the higher of the two lowest points before larger values on each side."""
    higher = np.flatnonzero(y > y[peak])
    left = higher[higher < peak].max(initial=-1)
    right = higher[higher > peak].min(initial=len(y))
    return float(y[peak] - max(y[left + 1 : peak + 1].min(), y[peak:right].min()))


def acf_peaks(
    acf: DataFrame,
    keys: Sequence[str],
    height: float = 0.2,
    distance: int = 10,
    top: int = 10,
) -> DataFrame:
    """The first ``top`` autocorrelation peaks per series with pattern and strength."""
    keys = list(keys)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["lag"] > 0].sort_values("lag")
        y = pdf["acf"].to_numpy()
        peaks = _local_maxima(y)
        peaks = peaks[y[peaks] >= height]
        chosen = _apart(peaks, y[peaks], distance)[:top]
        return pdf.iloc[chosen][[*keys, "lag", "acf"]]

    schema = T.StructType([*_keys_schema(acf, keys), acf.schema["lag"], acf.schema["acf"]])
    peaks = acf.where(F.col("acf").isNotNull()).groupBy(*keys).applyInPandas(find, schema)
    bands = F.concat_ws(
        ", ",
        F.when(F.col("lag").between(50, 150), "Hourly/Sub-hourly"),
        F.when(F.col("lag").between(300, 700), "Daily"),
    )
    return peaks.withColumns(
        {
            "pattern": F.when(bands == "", "Other").otherwise(bands),
            "strength": F.when(F.col("acf") > 0.6, "strong").when(F.col("acf") >= 0.2, "moderate").otherwise("weak"),
        }
    )


def forecast_horizons(acf: DataFrame, keys: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """Short, medium and long horizons from the first lag below the threshold."""
    decay = F.coalesce(F.min(F.when(F.col("acf") < threshold, F.col("lag"))), F.count(F.lit(1)).cast("int"))
    limits = acf.groupBy(*keys).agg(decay.alias("limit"))
    limit = F.col("limit")
    return limits.select(
        *keys,
        F.least(F.lit(50), F.floor(limit / 4)).cast("int").alias("short_term"),
        F.least(F.lit(200), F.floor(limit / 2)).cast("int").alias("medium_term"),
        limit.cast("int").alias("long_term"),
    )


# -- spectrum -----------------------------------------------------------------------


def welch_psd(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value_col: str,
    sampling_rate: float = 1.0,
    max_segment: int = 2048,
    min_rows: int = 8,
) -> DataFrame:
    """Power spectral density by averaged, half-overlapping, Hann-tapered segments.

    Series with fewer than ``min_rows`` rows have no spectrum: their segments would be one row long.

    A segment is a quarter of the series, at most ``max_segment`` rows. Kept periods reach
    from two samples to half the series. A row takes part in at most two segments, which
    are the only units that Python works on.
    """
    keys = list(keys)
    x = _centred(df, keys, order, value_col).where(F.col("n") >= max(4, min_rows))
    size = F.least(F.lit(max_segment), F.floor(F.col("n") / 4)).cast("bigint")
    step = F.col("size") - F.floor(F.col("size") / 2)
    count = F.floor((F.col("n") - F.floor(F.col("size") / 2)) / F.col("step"))
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("pos") - F.col("size") + 1) / F.col("step")))
    last = F.least(F.floor(F.col("pos") / F.col("step")), F.col("count") - 1)
    cut = x.withColumn("size", size).withColumn("step", step).withColumn("count", count)
    cut = cut.withColumns({"first": first, "last": last}).where(F.col("first") <= F.col("last"))
    segments = (
        cut.withColumn("segment", F.explode(F.sequence("first", "last")))
        .groupBy(*keys, "n", "size", "segment")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("rows"))
        .withColumn("values", F.transform("rows", lambda row: row.getField("x")))
    )

    def periodogram(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            v = np.asarray(v, dtype=float)
            m = len(v)
            taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
            power = np.abs(np.fft.rfft((v - v.mean()) * taper)) ** 2 / (sampling_rate * np.sum(taper**2))
            power[1 : (None if m % 2 else -1)] *= 2
            out.append(power)
        return pd.Series(out)

    spectrum = F.pandas_udf(periodogram, "array<double>")
    bins = segments.select(*keys, "n", "size", F.posexplode(spectrum("values")).alias("bin", "power"))
    averaged = bins.groupBy(*keys, "bin").agg(
        F.avg("power").alias("psd"), F.first("size").alias("size"), F.first("n").alias("n")
    )
    frequency = F.col("bin") * F.lit(sampling_rate) / F.col("size")
    period = F.try_divide(F.lit(1.0), F.col("frequency"))
    kept = averaged.withColumn("frequency", frequency).withColumn("period", period)
    duration = F.col("n") / F.lit(sampling_rate)
    return kept.where(
        (F.col("bin") > 0) & (F.col("period") >= 2.0 / sampling_rate) & (F.col("period") <= duration / 2)
    ).select(*keys, "bin", "frequency", "period", "psd")


def spectral_peaks(
    psd: DataFrame, keys: Sequence[str], prominence: float = 0.05, distance: int = 20, top: int = 10
) -> DataFrame:
    """The strongest spectral peaks per series by power, labelled by their prominence.

    Prominence is measured on the spectrum divided by its maximum.
    """
    keys = list(keys)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frequency")
        y = pdf["psd"].to_numpy()
        y = y / y.max() if len(y) and y.max() > 0 else y
        peaks = _local_maxima(y)
        heights = {int(p): _prominence(y, p) for p in _apart(peaks, y[peaks], distance)}
        chosen = sorted((p for p, h in heights.items() if h >= prominence), key=lambda p: -y[p])[:top]
        found = pdf.iloc[chosen][[*keys, "frequency", "period", "psd"]].rename(columns={"psd": "power"})
        found["prominence"] = [heights[p] for p in chosen]
        found["rank"] = np.arange(1, len(chosen) + 1, dtype="int32")
        return found[[*keys, "rank", "frequency", "period", "power", "prominence"]]

    schema = T.StructType(
        [
            *_keys_schema(psd, keys),
            T.StructField("rank", T.IntegerType()),
            T.StructField("frequency", T.DoubleType()),
            T.StructField("period", T.DoubleType()),
            T.StructField("power", T.DoubleType()),
            T.StructField("prominence", T.DoubleType()),
        ]
    )
    label = (
        F.when(F.col("prominence") > 0.3, "Very Strong")
        .when(F.col("prominence") > 0.15, "Strong")
        .when(F.col("prominence") > 0.05, "Moderate")
        .otherwise("Weak")
    )
    return psd.groupBy(*keys).applyInPandas(find, schema).withColumn("strength", label)


# -- seasonality --------------------------------------------------------------------


def seasonal_decomposition(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value_col: str, period: int
) -> DataFrame:
    """Classical additive decomposition: centred moving average, phase means, residual.

    An even period weighs the two ends of its moving average by half. Rows whose frame is
    incomplete have no trend and no residual.
    """
    keys, half = list(keys), period // 2
    value = F.col(value_col).cast("double")

    def trend(spec):
        frame = spec.rowsBetween(-half, half)
        inner = F.sum(value).over(frame)
        if period % 2 == 0:
            ends = F.lag(value, half).over(spec) + F.lead(value, half).over(spec)
            inner = inner - 0.5 * ends
        full = F.count(value).over(frame) == 2 * half + 1
        return {"trend": F.when(full, inner / period)}

    smoothed = ordered_windows(
        df.select(*keys, *order, value_col), keys, list(order), trend, before=half, after=half, pos="pos"
    ).withColumn("phase", (F.col("pos") % period).cast("int"))
    phases = smoothed.groupBy(*keys, "phase").agg(F.avg(value - F.col("trend")).alias("m"))
    # One row per phase of a series.
    level = F.avg("m").over(Window.partitionBy(*keys))
    phases = phases.select(*keys, "phase", (F.col("m") - level).alias("seasonal"))
    joined = join_measured(smoothed, phases, [*keys, "phase"], "left")
    return joined.withColumn("residual", value - F.col("trend") - F.col("seasonal"))


def seasonality_strength(decomposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 - var(residual) / var(seasonal + residual), not below 0, with a label."""
    rest = F.col("residual")
    ratio = F.try_divide(F.var_pop(rest), F.var_pop(F.when(rest.isNotNull(), F.col("seasonal") + rest)))
    strength = F.greatest(F.lit(0.0), 1 - ratio)
    label = F.when(F.col("strength") > 0.6, "Strong").when(F.col("strength") > 0.3, "Moderate").otherwise("Weak")
    return decomposed.groupBy(*keys).agg(strength.alias("strength")).withColumn("classification", label)


# -- unit root ----------------------------------------------------------------------

# MacKinnon's published response surfaces for the constant-only test.
# p-value polynomials (1994) in the statistic, and critical values (2010) in 1/nobs.
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
P_RANGE = (-18.83, 2.74)
P_SWITCH = -1.61
CRITICAL = {
    "critical_1": (-3.43035, -6.5393, -16.786, -79.433),
    "critical_5": (-2.86154, -2.8903, -4.234, -40.040),
    "critical_10": (-2.56677, -1.5384, -2.809),
}


def _polynomial(coefficients: Sequence[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def _adf_p_value(statistic: float) -> float:
    if statistic > P_RANGE[1]:
        return 1.0
    if statistic < P_RANGE[0]:
        return 0.0
    return NormalDist().cdf(_polynomial(P_SMALL if statistic <= P_SWITCH else P_LARGE, statistic))


def adf_lags(n: int, max_lag: int | None = None) -> int:
    """Largest lag to try: the usual rule of 12 (n/100)^(1/4), capped by the length."""
    rule = math.ceil(12.0 * (n / 100.0) ** 0.25) if max_lag is None else max_lag
    return max(0, min(n // 2 - 2, rule))


def _design(x: np.ndarray, at: np.ndarray, lags: int) -> np.ndarray:
    """Rows (1, x[t-1], dx[t-1], ..., dx[t-lags], dx[t]) for the given t."""
    dx = np.diff(x, prepend=np.nan)
    columns = [np.ones(len(at)), x[at - 1], *(dx[at - i] for i in range(1, lags + 1)), dx[at]]
    return np.column_stack(columns)


def _least_squares(gram: np.ndarray, lags: int) -> tuple[float, float]:
    """(t-statistic of the level, AIC) of the regression with the given lags."""
    chosen = [*range(lags + 2), len(gram) - 1]
    g = gram[np.ix_(chosen, chosen)]
    xx, xy, yy, n = g[:-1, :-1], g[:-1, -1], g[-1, -1], g[0, 0]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    rss = max(float(yy - beta @ xy), 1e-300)
    k = len(beta)
    aic = n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * k
    error = math.sqrt(rss / max(n - k, 1) * inverse[1, 1])
    return (float(beta[1] / error) if error > 0 else math.nan), aic


def adf_test(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value_col: str,
    max_lag: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; the lag order is chosen by AIC.

    Blocks contribute their cross-product matrices, which are added up per series. The
    regressions themselves are solved on the summed matrix, of a size set by the lag
    order alone. All orders are compared on the same rows; the chosen one is fitted again
    on all rows it can use. A series without degrees of freedom for the test keeps its row,
    with NULL for the statistic, the limits and the verdict.
    """
    keys = list(keys)
    # Written once: the length, the blocks and the heads all read it.
    x = materialize(_centred(df, keys, order, value_col))
    longest = x.agg(F.max("n")).first()[0] or 0
    reach = adf_lags(longest, max_lag) + 1
    blocks = with_blocks(x, before=reach, after=0, size=max(block_rows, reach))

    def cross_products(piece: pd.DataFrame) -> dict[str, np.ndarray]:
        lags, pos = adf_lags(int(piece["n"].iloc[0]), max_lag), piece["pos"].to_numpy()
        at = np.flatnonzero(piece["__home"].to_numpy() & (pos > lags))
        rows = _design(piece["x"].to_numpy(), at, lags)
        gram = (rows.T @ rows).ravel()
        return {"cell": np.arange(len(gram)), "s": gram}

    cells = (
        map_pieces(blocks, keys, cross_products, "cell int, s double")
        .groupBy(*keys, "cell")
        .agg(F.sum("s").alias("s"))
    )
    grams = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "s"))).alias("g"))
    heads = (
        x.where(F.col("pos") <= reach)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("h"), F.max("n").alias("n"))
    )
    fields = ["adf_statistic", "p_value", "used_lag", "nobs", *CRITICAL]

    def solve(gram: pd.Series, head: pd.Series, n: pd.Series) -> pd.DataFrame:
        results = []
        for cell_sums, first_values, length in zip(gram, head, n, strict=True):
            lags = adf_lags(int(length), max_lag)
            width = lags + 3
            full = np.asarray(cell_sums, dtype=float).reshape(width, width)
            used = min(range(lags + 1), key=lambda p: _least_squares(full, p)[1])
            # Rows before the common sample that the chosen order can use as well.
            start = np.asarray(first_values, dtype=float)
            early = np.arange(used + 1, lags + 1)
            chosen = [*range(used + 2), width - 1]
            refit = full[np.ix_(chosen, chosen)].copy()
            if len(early):
                rows = _design(start, early, used)
                refit += rows.T @ rows
            statistic, _ = _least_squares(refit, used)
            nobs = int(round(refit[0, 0]))
            if nobs <= used + 2:  # no degrees of freedom are left
                results.append([math.nan, math.nan, used, nobs, *(math.nan for _ in CRITICAL)])
                continue
            limits = [_polynomial(c, 1.0 / nobs) for c in CRITICAL.values()]
            results.append([statistic, _adf_p_value(statistic), used, nobs, *limits])
        return pd.DataFrame(results, columns=fields)

    returned = "adf_statistic double, p_value double, used_lag int, nobs bigint, " + ", ".join(
        f"{c} double" for c in CRITICAL
    )
    solver = F.pandas_udf(solve, returned)
    joined = spread(join_on_keys(grams, heads, keys), keys)
    solved = joined.withColumn(
        "r",
        solver(
            F.transform("g", lambda c: c.getField("s")), F.transform("h", lambda c: c.getField("x")), F.col("n")
        ),
    )
    named = [F.col(f"r.{c}") if c in ("used_lag", "nobs") else known(F.col(f"r.{c}")).alias(c) for c in fields]
    return solved.select(*keys, *named).withColumn("stationary", F.col("p_value") < 0.05)
