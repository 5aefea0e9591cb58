"""Outliers, interval forecasts and detector evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.stats import known, normal_quantile, student_t_quantile
from grainwise.plans.ordering import exact_percentiles, hash_order, prefix_sums
from grainwise.plans.scratch import join_measured, materialize


def outliers_iqr(
    df: DataFrame, value_col: str, keys: Sequence[str] = (), multiplier: float = 1.5, output_col: str = "is_outlier"
) -> DataFrame:
    """Flag values outside the quartiles by more than ``multiplier`` IQR (strict).

    NULL and NaN are missing: they move no quartile and are never flagged.
    """
    keys = list(keys)
    q = exact_percentiles(df, keys, value_col, {"__q1": 0.25, "__q3": 0.75})
    joined = join_measured(df, q, keys, "left")
    reach = multiplier * (F.col("__q3") - F.col("__q1"))
    value = known(value_col)
    flag = (value < F.col("__q1") - reach) | (value > F.col("__q3") + reach)
    return joined.withColumn(output_col, F.coalesce(flag, F.lit(False))).drop("__q1", "__q3")


def outliers_zscore(
    df: DataFrame, value_col: str, keys: Sequence[str] = (), threshold: float = 3.0, output_col: str = "is_outlier"
) -> DataFrame:
    """Flag values more than ``threshold`` sample deviations from the mean.

    Constant groups and single rows have no outliers. NULL and NaN are missing and never flagged.
    """
    keys = list(keys)
    value = known(value_col)
    moments = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev(value).alias("__std"))
    z = F.abs(F.try_divide(value - F.col("__mean"), "__std"))
    flagged = join_measured(df, moments, keys, "left").withColumn(output_col, F.coalesce(z > threshold, F.lit(False)))
    return flagged.drop("__mean", "__std")


# -- isolation forest ---------------------------------------------------------------

_FOREST_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def _path_correction(n: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search in a random tree over n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1.0)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1.0), np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, rows: np.ndarray, seed: int) -> pd.DataFrame:
    """One isolation tree over a subsample: split at random until points are alone."""
    rng = np.random.default_rng((seed, tree))
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[list[float]] = []
    queue = [(rows, 0)]
    while queue:
        points, depth = queue.pop(0)
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(rows.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(usable) == 0:
            nodes.append([tree, len(nodes), -1, 0.0, -1, -1, depth + float(_path_correction(len(points)))])
            continue
        feature = int(rng.choice(usable))
        low, high = points[:, feature].min(), points[:, feature].max()
        threshold = float(rng.uniform(low, high))
        first_child = len(nodes) + 1 + len(queue)
        nodes.append([tree, len(nodes), feature, threshold, first_child, first_child + 1, 0.0])
        below = points[:, feature] < threshold
        queue += [(points[below], depth + 1), (points[~below], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])


def _mean_depths(forest: list[tuple[np.ndarray, ...]], points: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points))
    for feature, threshold, left, right, depth in forest:
        at = np.zeros(len(points), dtype=int)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            node = at[rows]
            goes_left = points[rows, feature[node]] < threshold[node]
            at[rows] = np.where(goes_left, left[node], right[node])
        total += depth[at]
    return total / len(forest)


def isolation_forest(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    contamination: float = 0.05,
    trees: int = 100,
    sample_size: int = 256,
    seed: int = 42,
    exact_cut: bool = False,
) -> DataFrame:
    """Multivariate outliers by an isolation forest (Liu, Ting and Zhou, 2008).

    Adds ``anomaly_score`` (higher is more isolated) and ``is_outlier`` for the top
    ``contamination`` share. Trees are grown one per group on at most ``sample_size``
    rows drawn by hash of ``keys``; the finished forest has a size fixed by its
    parameters and travels with the scoring tasks. Only growing samples: every row comes
    back and is scored, once, but for rows with a NULL or NaN feature, which keep a NULL
    score and are no outliers.
    """
    columns, keys = list(columns), list(keys)
    whole = F.lit(True)
    for c in columns:
        whole = whole & known(c).isNotNull()
    complete = df.where(whole)
    unit = F.conv(F.substring(hash_order(keys, seed), 1, 8), 16, 10).cast("double") / float(16**8)
    # A uniform pool of about 2 * trees * sample_size rows, whatever the table size.
    total, wanted = complete.count(), float(2 * trees * sample_size)
    pool = complete.where(unit * total < wanted).select(*keys, *columns)
    # A row is dealt only to trees where its draw is among about the 2 * sample_size smallest;
    # the grouped step trims exactly. No row is copied for the other trees.
    threshold = 2.0 * sample_size * 1_000_000 / max(min(total, wanted), 1.0)
    draw = lambda tree: F.xxhash64(*keys, tree, F.lit(seed))
    taking = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: F.pmod(draw(tree), F.lit(1_000_000)) < threshold)
    kept = pool.withColumn("tree", F.explode(taking)).withColumn("__draw", draw(F.col("tree")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = pdf.sort_values("__draw").head(sample_size)
        return _grow(int(pdf["tree"].iloc[0]), chosen[columns].to_numpy(dtype=float), seed)

    nodes = kept.select("tree", "__draw", *columns).groupBy("tree").applyInPandas(grow, _FOREST_SCHEMA).toPandas()
    forest = [
        tuple(part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth"))
        for _, part in nodes.sort_values(["tree", "node"]).groupby("tree")
    ]
    scale = float(_path_correction(sample_size))

    def score(*series: pd.Series) -> pd.Series:
        points = np.column_stack([s.to_numpy(dtype=float) for s in series])
        return pd.Series(np.power(2.0, -_mean_depths(forest, points) / scale))

    scorer = F.pandas_udf(score, "double")
    scored = df.withColumn("anomaly_score", F.when(whole, scorer(*(F.col(c) for c in columns))))
    # The cut-off reads the features only and takes scores of its own: scoring twice costs
    # less than a written copy of the whole table or a join with it.
    scores = complete.select(scorer(*(F.col(c) for c in columns)).alias("anomaly_score"))
    if exact_cut:
        cut = exact_percentiles(materialize(scores), [], "anomaly_score", {"cut": 1.0 - contamination})
    else:
        cut = scores.agg(F.percentile_approx("anomaly_score", 1.0 - contamination).alias("cut"))
    return scored.withColumn("is_outlier", F.coalesce(F.col("anomaly_score") > cut.scalar(), F.lit(False)))


# -- intervals ----------------------------------------------------------------------


def interval_label(level: float) -> str:
    """0.95 becomes 95, 0.999 becomes 99_9."""
    return f"{level * 100:.6g}".replace(".", "_")


def prediction_intervals(
    levels: Sequence[float] = (0.95, 0.99),
    distribution: str = "gaussian",
    nu: float = 4.0,
    mean_col: str = "y_pred",
    std_col: str = "std",
):
    """Closure adding ``lower_L`` and ``upper_L`` for each confidence level."""
    quantile = {"gaussian": normal_quantile, "student_t": lambda p: student_t_quantile(p, nu)}.get(distribution)
    if quantile is None:
        raise ValueError(f"Unknown distribution '{distribution}': choose gaussian or student_t")
    bounds: dict[str, Column] = {}
    for level in levels:
        reach = F.lit(quantile(1 - (1 - level) / 2)) * F.col(std_col)
        bounds[f"lower_{interval_label(level)}"] = F.col(mean_col) - reach
        bounds[f"upper_{interval_label(level)}"] = F.col(mean_col) + reach
    return lambda df: df.withColumns(bounds)


def interval_violations(levels: Sequence[float] = (0.95, 0.99), actual_col: str = "y_true"):
    """Closure flagging values outside their interval."""

    def outside(name: str) -> Column:
        actual = F.col(actual_col)
        return (actual < F.col(f"lower_{name}")) | (actual > F.col(f"upper_{name}"))

    names = [interval_label(level) for level in levels]
    return lambda df: df.withColumns({f"violates_{name}": outside(name) for name in names})


def residual_score(actual_col: str = "y_true", mean_col: str = "y_pred", std_col: str = "std"):
    """Closure adding the absolute standardised residual."""
    score = F.try_divide(F.abs(F.col(actual_col) - F.col(mean_col)), std_col)
    return lambda df: df.withColumn("residual_score", score)


# -- evaluation ---------------------------------------------------------------------


def forecast_metrics(df: DataFrame, model_col: str = "model", levels: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """RMSE, MAE, R2, coverage and sharpness per model; one aggregation."""
    actual, predicted = F.col("y_true"), F.col("y_pred")
    error = actual - predicted
    metrics = [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(actual))).alias("r2"),
    ]
    for level in levels:
        name = interval_label(level)
        lower, upper = F.col(f"lower_{name}"), F.col(f"upper_{name}")
        metrics.append(F.avg(((actual >= lower) & (actual <= upper)).cast("double")).alias(f"coverage_{name}"))
        metrics.append(F.avg(upper - lower).alias(f"sharpness_{name}"))
    return df.groupBy(model_col).agg(*metrics)


def anomaly_metrics(
    df: DataFrame, actual_col: str, flag_cols: Sequence[str], model_col: str = "model"
) -> DataFrame:
    """Precision, recall and F1 per model and flag column; undefined ratios are 0."""
    entries = [F.struct(F.lit(c).alias("threshold"), F.col(c).cast("boolean").alias("flag")) for c in flag_cols]
    long = df.select(model_col, F.col(actual_col).cast("boolean").alias("actual"), F.inline(F.array(*entries)))
    hits = F.count_if(F.col("actual") & F.col("flag"))
    counts = long.groupBy(model_col, "threshold").agg(
        hits.alias("tp"), F.count_if("flag").alias("flagged"), F.count_if("actual").alias("positives")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, flagged, positives = F.col("tp"), F.col("flagged"), F.col("positives")
    return counts.select(
        model_col,
        "threshold",
        ratio(tp, flagged).alias("precision"),
        ratio(tp, positives).alias("recall"),
        ratio(2 * tp, flagged + positives).alias("f1"),
    )


def roc_curve(df: DataFrame, score_col: str, actual_col: str, model_col: str = "model") -> DataFrame:
    """False and true positive rate at every distinct score, from the highest down."""
    merged = (
        df.where(F.col(score_col).isNotNull())
        .groupBy(model_col, F.col(score_col).alias("threshold"))
        .agg(F.count_if(F.col(actual_col)).alias("__p"), F.count_if(~F.col(actual_col)).alias("__n"))
    )
    ranked = prefix_sums(
        merged, [model_col], [F.desc("threshold")], {"tp": "__p", "fp": "__n"}, {"positives": "__p", "negatives": "__n"}
    )
    return ranked.select(
        model_col,
        "threshold",
        F.try_divide("fp", "negatives").alias("fpr"),
        F.try_divide("tp", "positives").alias("tpr"),
        F.col("__p").alias("tied_positives"),
        F.col("__n").alias("tied_negatives"),
        "tp",
        "fp",
        "positives",
        "negatives",
    )


def roc_auc(df: DataFrame, score_col: str, actual_col: str, model_col: str = "model") -> DataFrame:
    """Area under the curve by the trapezoid rule; tied scores form one step."""
    curve = roc_curve(df, score_col, actual_col, model_col)
    # A step of d negatives and t positives adds d * (tp before it + t / 2).
    area = F.sum(F.col("tied_negatives") * (F.col("tp") - F.col("tied_positives") / 2))
    return curve.groupBy(model_col).agg(
        F.try_divide(area, F.first("positives") * F.first("negatives").cast("double")).alias("auc")
    )


def calibration_qq(df: DataFrame, score_col: str, model_col: str = "model", quantiles: int = 99) -> DataFrame:
    """Observed quantiles of standardised residuals against those of a normal."""
    probs = [(i + 1) / (quantiles + 1) for i in range(quantiles)]
    names = {f"q{i}": p for i, p in enumerate(probs)}
    observed = exact_percentiles(df, [model_col], score_col, names)
    rows = [
        F.struct(
            F.lit(p).alias("probability"),
            F.lit(normal_quantile(p)).alias("expected"),
            F.col(name).alias("observed"),
        )
        for name, p in names.items()
    ]
    return observed.select(model_col, F.inline(F.array(*rows)))
