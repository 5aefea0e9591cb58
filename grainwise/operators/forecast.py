"""Baseline forecasts for many series at once, and their scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.plans.ordering import ordered_windows, with_position
from grainwise.plans.scratch import join_on_keys, materialize


def positioned(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Series with 0-based ``pos`` and length ``n``."""
    return with_position(df, keys, order, pos="pos", length="n")


def _horizon(h: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")


def naive_forecast(train: DataFrame, keys: Sequence[str], value_col: str, horizon: int) -> DataFrame:
    """The last value, for every step."""
    last = train.groupBy(*keys).agg(F.max_by(value_col, "pos").alias("y_pred"))
    return last.select(*keys, _horizon(horizon), "y_pred")


def seasonal_naive_forecast(
    train: DataFrame, keys: Sequence[str], value_col: str, horizon: int, period: int
) -> DataFrame:
    """The value of the same phase in the last full cycle, repeated.

    Series shorter than one period have no forecast.
    """
    season = train.where((F.col("pos") >= F.col("n") - period) & (F.col("n") >= period)).select(
        *keys, (F.col("pos") - (F.col("n") - period)).cast("int").alias("phase"), F.col(value_col).alias("y_pred")
    )
    # Each of the at most `period` rows serves the steps phase+1, phase+1+period, ...
    steps = F.sequence(F.col("phase") + 1, F.lit(horizon), F.lit(period))
    return season.where(F.col("phase") + 1 <= horizon).select(*keys, F.explode(steps).alias("step"), "y_pred")


def moving_average_forecast(
    train: DataFrame, keys: Sequence[str], value_col: str, horizon: int, window: int
) -> DataFrame:
    """Mean of the last ``window`` values, for every step."""
    recent = train.where(F.col("pos") >= F.col("n") - window)
    mean = recent.groupBy(*keys).agg(F.avg(value_col).alias("y_pred"))
    return mean.select(*keys, _horizon(horizon), "y_pred")


def holdout(df: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Split positioned series into all but the last ``horizon`` rows and those rows.

    The test part carries ``step`` 1..horizon. Series without a training row are dropped.
    """
    usable = df.where(F.col("n") > horizon).withColumn("n", F.col("n") - horizon)
    train = usable.where(F.col("pos") < F.col("n"))
    test = usable.where(F.col("pos") >= F.col("n")).withColumn("step", (F.col("pos") - F.col("n") + 1).cast("int"))
    return train, test


def naive_scale(train: DataFrame, keys: Sequence[str], order: Sequence[str], value_col: str) -> DataFrame:
    """In-sample mean absolute one-step error of the naive forecast, per series."""
    lagged = ordered_windows(
        train, list(keys), list(order), lambda spec: {"__before": F.lag(value_col).over(spec)}, before=1
    )
    return lagged.groupBy(*keys).agg(F.avg(F.abs(F.col(value_col) - F.col("__before"))).alias("scale"))


def _with_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value_col: str) -> DataFrame:
    """Series with ``pos``, ``n`` and the value before, from one window."""
    lag = lambda spec: {"__before": F.lag(value_col).over(spec)}
    return ordered_windows(df.select(*keys, *order, value_col), keys, order, lag, before=1, pos="pos", length="n")


def _one_step_error(value_col: str, when: Column | None = None) -> Column:
    error = F.abs(F.col(value_col) - F.col("__before"))
    return F.avg(error if when is None else F.when(when, error))


def point_metrics(scored: DataFrame, group_cols: Sequence[str], value_col: str = "y_true") -> DataFrame:
    """MAE, RMSE, MAPE and, with a ``scale`` column, MASE.

    MAPE leaves out zero actuals. MASE divides every error by its series' naive scale.
    """
    error = F.abs(F.col(value_col) - F.col("y_pred"))
    metrics = [
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.try_divide(error, F.abs(value_col))) * 100).alias("mape"),
    ]
    if "scale" in scored.columns:
        metrics.append(F.avg(F.try_divide(error, "scale")).alias("mase"))
    return scored.groupBy(*group_cols).agg(*metrics)


def compare_baselines(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value_col: str,
    horizon: int,
    periods: Sequence[int] = (),
    windows: Sequence[int] = (),
) -> DataFrame:
    """Score naive, seasonal-naive and moving-average forecasts on a holdout.

    One row per model, best MASE first; ``best`` marks the winner.
    """
    keys, order = list(keys), list(order)
    # Positions and lags come from one window and are written once for all models.
    train, test = holdout(materialize(_with_lag(df, keys, order, value_col)), horizon)
    forecasts = [naive_forecast(train, keys, value_col, horizon).withColumn("model", F.lit("naive"))]
    forecasts += [
        seasonal_naive_forecast(train, keys, value_col, horizon, p).withColumn("model", F.lit(f"seasonal_naive_{p}"))
        for p in periods
    ]
    forecasts += [
        moving_average_forecast(train, keys, value_col, horizon, w).withColumn("model", F.lit(f"moving_average_{w}"))
        for w in windows
    ]
    predicted = reduce(DataFrame.unionByName, forecasts)
    actual = join_on_keys(
        test.select(*keys, "step", F.col(value_col).alias("y_true")),
        train.groupBy(*keys).agg(_one_step_error(value_col).alias("scale")),
        keys,
        "left",
    )
    scored = join_on_keys(predicted, actual, [*keys, "step"])
    table = point_metrics(scored, ["model"])
    best = table.agg(F.min_by("model", F.struct("mase", "model")).alias("m")).scalar()
    return table.withColumn("best", F.col("model") == best).orderBy("mase", "model")


def best_period(table: DataFrame, prefix: str = "seasonal_naive_") -> DataFrame:
    """The seasonal period with the lowest MASE."""
    seasonal = table.where(F.col("model").startswith(prefix)).withColumn(
        "period", F.regexp_replace("model", prefix, "").cast("int")
    )
    return seasonal.agg(F.min_by("period", F.struct("mase", "period")).alias("best_period"), F.min("mase").alias("mase"))


def backtest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value_col: str,
    horizon: int,
    cutoffs_back: Sequence[int],
    window: int = 5,
    periods: Sequence[int] = (),
) -> DataFrame:
    """Rolling-origin scores of the naive, moving-average and seasonal-naive forecasts.

    A cut-off of b trains on all but the last b rows and scores the ``horizon`` rows that
    follow. Only the rows that some cut-off reaches are paired with the cut-offs. A season of
    ``periods`` rows forecasts each step by the row of its phase in the last full cycle before
    the cut-off; a series with less than a cycle before it is not scored for that period. With
    periods there is also MASE, by the one-step errors before the cut-off.
    """
    keys, order = list(keys), list(order)
    if min(cutoffs_back) < horizon:
        raise ValueError("every cut-off must leave at least `horizon` rows to score")
    placed = _with_lag(df, keys, order, value_col) if periods else positioned(df.select(*keys, *order, value_col), keys, order)
    placed = materialize(placed) if periods else placed
    origins = F.array(*(F.lit(b) for b in cutoffs_back))
    reached = placed.where(F.col("pos") >= F.col("n") - (max(cutoffs_back) + max(window, *periods, 0)))
    relative = reached.withColumn("cutoff", F.explode(origins)).withColumn(
        "offset", F.col("pos") - (F.col("n") - F.col("cutoff"))
    )
    group = [*keys, "cutoff"]
    trained = relative.where((F.col("offset") < 0) & (F.col("n") > F.col("cutoff")))
    fitted = trained.where(F.col("offset") >= -window).groupBy(*group).agg(
        F.max_by(value_col, "offset").alias("naive"), F.avg(value_col).alias("moving_average")
    )
    actual = relative.where((F.col("offset") >= 0) & (F.col("offset") < horizon)).select(
        *group, "offset", F.col(value_col).alias("y_true")
    )
    models = [
        F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("y_pred"))
        for m in ("naive", "moving_average")
    ]
    scored = join_on_keys(actual, fitted, group).select(*group, "y_true", F.inline(F.array(*models)))
    if not periods:
        return point_metrics(scored, ["cutoff", "model"])
    named = lambda p: F.lit(f"seasonal_naive_{p}").alias("model")
    season = [
        trained.where((F.col("offset") >= -p) & (F.col("n") - F.col("cutoff") >= p)).select(
            *group, named(p), (F.col("offset") + p).alias("phase"), F.col(value_col).cast("double").alias("y_pred")
        )
        for p in periods
    ]
    phases = F.array(*(F.struct(named(p), (F.col("offset") % p).alias("phase")) for p in periods))
    wanted = actual.select(*group, "y_true", F.inline(phases))
    seasonal = join_on_keys(wanted, reduce(DataFrame.unionByName, season), [*group, "model", "phase"])
    scales = placed.groupBy(*keys).agg(
        *(_one_step_error(value_col, F.col("pos") < F.col("n") - b).alias(f"__scale_{i}") for i, b in enumerate(cutoffs_back))
    )
    by_cutoff = F.array(*(F.struct(F.lit(b).alias("cutoff"), F.col(f"__scale_{i}").alias("scale")) for i, b in enumerate(cutoffs_back)))
    both = scored.unionByName(seasonal.select(*scored.columns))
    return point_metrics(join_on_keys(both, scales.select(*keys, F.inline(by_cutoff)), group, "left"), ["cutoff", "model"])
