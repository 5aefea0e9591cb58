"""Training windows, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.stats import pearson
from grainwise.plans.ordering import exact_percentiles, hash_order, ordered_windows, pick_by_hash, with_position
from grainwise.plans.scratch import join_on_keys


#: Least rows in a block of a series whose windows are cut at once.
WINDOW_BLOCK = 1024


def _cut_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int, stride: int, beyond: int = 0) -> DataFrame:
    """(keys, __at, __window): windows of ``length`` rows from every ``stride``-th position on.

    A window also holds the ``beyond`` rows that follow it, and one that lacks any of its rows
    is left out. Rows are sent to the block of their position, the first rows of a block to the one before
    as well; each block is put in order once and its windows are slices of it. Rows that start
    no window so make no array, and a hot series is as many groups as it has blocks.
    """
    reach = length + beyond
    size = -(-max(WINDOW_BLOCK, reach) // stride) * stride
    placed = with_position(df, keys, order, pos="__at", length="__n")
    home, offset = F.floor(F.col("__at") / F.lit(size)).cast("bigint"), F.col("__at") % size
    both = F.array_compact(F.array(home, F.when((offset < reach - 1) & (home > 0), home - 1)))
    row = F.struct("__at", *(c for c in df.columns if c not in keys))
    blocks = placed.withColumn("__block", F.explode(both)).groupBy(*keys, "__block").agg(F.sort_array(F.collect_list(row)).alias("__rows"), F.first("__n").alias("__n"))
    first = F.col("__block") * size
    last = F.least(first + size - 1, F.col("__n") - reach)
    starts = F.when(last >= first, F.sequence(first, last, F.lit(stride).cast("bigint")))
    cut = F.transform(starts, lambda s: F.struct(s.alias("__at"), F.slice("__rows", (s - first + 1).cast("int"), reach).alias("__window")))
    return blocks.select(*keys, F.inline(cut))


def forecast_sequences(
    df: DataFrame,
    length: int = 168,
    stride: int = 24,
    target_col: str = "hourly_cost",
    keys: Sequence[str] = ("resource_id",),
    time_col: str = "timestamp",
    tie_cols: Sequence[str] = (),
) -> DataFrame:
    """Sliding input sequences with the value that follows, every ``stride`` rows.

    A sequence never crosses a resource, and one that has no next row is left out.
    """
    keys = list(keys)
    rows = df.select(*keys, time_col, *tie_cols, F.col(target_col).alias("__value"))
    cut = _cut_windows(rows, keys, [time_col, *tie_cols], length, stride, beyond=1)
    at = lambda i, c: F.get("__window", F.lit(i)).getField(c)
    return cut.select(
        *keys,
        F.slice(F.col("__window").getField("__value"), 1, length).alias("input_sequence"),
        at(length, "__value").alias("target"),
        at(0, time_col).alias("start_time"),
        at(length - 1, time_col).alias("end_time"),
    )


def sliding_windows(
    df: DataFrame,
    window_size: int = 24,
    stride: int = 6,
    target_col: str = "hourly_cost",
    keys: Sequence[str] = ("resource_id",),
    time_col: str = "timestamp",
    tie_cols: Sequence[str] = (),
) -> DataFrame:
    """Context windows: the forecast sequences under their other names."""
    return forecast_sequences(df, window_size, stride, target_col, keys, time_col, tie_cols).select(
        F.col("input_sequence").alias("context"), "target", F.col("start_time").alias("timestamp"), *keys
    )


def anomaly_windows(
    df: DataFrame,
    window_size: int = 24,
    keys: Sequence[str] = ("resource_id",),
    time_col: str = "timestamp",
    tie_cols: Sequence[str] = (),
    label_col: str = "is_anomaly",
) -> DataFrame:
    """Windows of cpu, memory and cost, built separately on normal and anomalous rows."""
    keys, metrics = list(keys), ["cpu_utilization", "memory_utilization", "hourly_cost"]
    labelled = df.where(F.col(label_col).isNotNull()).select(
        *keys, time_col, *tie_cols, *metrics, F.col(label_col).cast("int").alias("label")
    )
    cut = _cut_windows(labelled, [*keys, "label"], [time_col, *tie_cols], window_size, stride=1)
    start = F.get("__window", F.lit(0))
    return cut.select(
        *keys,
        start.getField(time_col).alias("timestamp"),
        *(start.getField(c).alias(c) for c in tie_cols),
        "label",
        F.col("__at").alias("window"),
        *(F.col("__window").getField(c).alias(f"{name}_sequence") for c, name in zip(metrics, ("cpu", "memory", "cost"), strict=True)),
    )


COPIES_AT_ONCE = 1000


def oversample_anomalies(
    windows: DataFrame, keys: Sequence[str] = ("resource_id",), contamination: float = 0.1, seed: int = 42
) -> DataFrame:
    """Replicate anomalous windows until they reach ``contamination`` of the normal ones.

    Every anomalous window gets the same number of copies but for a remainder, which goes
    to the windows with the smallest hash. ``replica`` is 0 for originals. With no
    anomalies at all the normal windows are returned as they are.
    """
    ident = [*keys, "label", "window"]
    sizes = windows.agg(
        F.struct(
            F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("have")
        ).alias("s")
    ).scalar()
    want = F.ceil(sizes.getField("normal") * F.lit(contamination))
    have = sizes.getField("have")
    anomalies = windows.where(F.col("label") == 1)
    order = with_position(
        anomalies.select(*ident).withColumn("__h", hash_order(ident, seed)), [], ["__h", *ident], pos="__place"
    ).drop("__h")
    whole = F.floor(F.try_divide(want, have)).cast("int")
    extra = (F.col("__place") < F.try_mod(want, have)).cast("int")
    copies = F.greatest(whole + extra, F.lit(1))
    # Copies are numbered in two steps, spread out between them: neither an array nor a task
    # holds all copies of a window.
    runs = order.withColumn("__copies", copies).withColumn(
        "__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / COPIES_AT_ONCE).cast("int")))
    )
    first = F.col("__run") * COPIES_AT_ONCE
    last = F.least(first + COPIES_AT_ONCE, F.col("__copies")) - 1
    numbered = runs.repartition(*ident, "__run").withColumn("replica", F.explode(F.sequence(first, last)))
    replicated = join_on_keys(anomalies, numbered.drop("__copies", "__run"), ident)
    return windows.where(F.col("label") == 0).withColumn("replica", F.lit(0)).unionByName(replicated.drop("__place"))


def hash_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Train/test label by hash: order-free, repeatable, no shuffle."""
    bucket = F.conv(F.substring(hash_order(keys, seed), 1, 8), 16, 10).cast("double") / float(16**8)
    return df.withColumn("split", F.when(bucket < 1.0 - test_size, "train").otherwise("test"))


def shuffled_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Places in a repeatable random order and a split with exact shares: the first floor((1 - test_size) n) rows train.

    Only the keys, which must tell rows apart, are put in order; the rows receive ``shuffled_at`` and ``split``.
    """
    placed = with_position(df.select(*keys).withColumn("__h", hash_order(keys, seed)), [], ["__h", *keys], pos="shuffled_at", length="__n")
    train = F.col("shuffled_at") < F.floor(F.col("__n") * F.lit(1.0 - test_size))
    labels = placed.select(*keys, "shuffled_at", F.when(train, "train").otherwise("test").alias("split"))
    return join_on_keys(df, labels, keys)


def anomaly_training_set(
    df: DataFrame,
    window_size: int = 24,
    contamination: float = 0.1,
    test_size: float = 0.2,
    keys: Sequence[str] = ("resource_id",),
    time_col: str = "timestamp",
    tie_cols: Sequence[str] = (),
    label_col: str = "is_anomaly",
    seed: int = 42,
) -> DataFrame:
    """Oversampled anomaly windows in shuffled order with a train/test label, ready to be written by ``split``."""
    windows = anomaly_windows(df, window_size, keys, time_col, tie_cols, label_col)
    return shuffled_split(oversample_anomalies(windows, keys, contamination, seed), [*keys, "label", "window", "replica"], test_size, seed)


def chronological_split(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.1,
    time_col: str = "timestamp",
    tie_cols: Sequence[str] = ("resource_id",),
) -> DataFrame:
    """Label rows train, validation or test by their place in global time order.

    Only the order columns are sorted, to find the two boundary keys. The rows themselves
    are labelled by comparison and do not move; rows equal in all order columns stay together.
    """
    order = [time_col, *tie_cols]
    placed = with_position(df.select(*order), [], order, pos="__at", length="__n")
    test = F.floor(F.col("__n") * F.lit(test_size))
    val = F.floor(F.col("__n") * F.lit(val_size))
    train = F.col("__n") - test - val
    key = F.struct(*order)
    bounds = placed.agg(
        F.struct(
            F.min(F.when(F.col("__at") >= train, key)).alias("val"),
            F.min(F.when(F.col("__at") >= train + val, key)).alias("test"),
        ).alias("b")
    ).scalar()

    def before(bound: Column) -> Column:
        return bound.isNull() | (key < bound)

    label = (
        F.when(before(bounds.getField("val")), "train")
        .when(before(bounds.getField("test")), "validation")
        .otherwise("test")
    )
    return df.withColumn("split", label)


def every_kth(df: DataFrame, k: int, keys: Sequence[str], order: Sequence[str], pos: str = "pos") -> DataFrame:
    """Rows 0, k, 2k, ... of each series."""
    return with_position(df, keys, order, pos=pos).where(F.col(pos) % k == 0)


def nyquist_factor(max_frequency: float | None) -> int:
    """Subsampling step that keeps the given highest frequency, between 10 and 30."""
    if not max_frequency:
        return 30
    return min(30, max(10, int(1 / (2 * max_frequency)) // 2))


def evenly_spaced_rows(df: DataFrame, m: int, order: Sequence[str], method: str = "evenly_spaced", seed: int = 42) -> DataFrame:
    """``m`` rows: evenly spaced over the ordered table, or random by hash."""
    if method == "evenly_spaced":
        placed = with_position(df, [], order, pos="__at", length="__n")
        if m == 1:
            return placed.where(F.col("__at") == 0).drop("__at", "__n")
        # Row i is picked when i = k (n-1) div (m-1) for a grid point k. The only k that can
        # reach it is the smallest one with k (n-1) >= i (m-1); whole numbers throughout.
        k = f"((__at * {m - 1} + __n - 2) div (__n - 1))"
        hit = (F.col("__n") <= m) | F.expr(f"{k} * (__n - 1) div {m - 1} = __at")
        return placed.where(hit).drop("__at", "__n")
    if method == "random":
        return pick_by_hash(df, order, m, seed)
    if method == "kmeans":
        raise NotImplementedError("kmeans selection is not available: use evenly_spaced or random")
    raise ValueError(f"Unknown method '{method}': choose evenly_spaced, random or kmeans")


def sample_rows(
    df: DataFrame, n: int, keys: Sequence[str], stratify_col: str | None = None, seed: int = 42
) -> DataFrame:
    """Repeatable sample of ``n`` rows, or in proportion to the strata.

    A stratum of s out of N rows gives round(s n / N) of them.
    """
    if stratify_col is None:
        return pick_by_hash(df, keys, n, seed)
    hashed = df.withColumn("__h", hash_order(keys, seed))
    placed = with_position(hashed, [stratify_col], ["__h", *keys], pos="__at", length="__stratum")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    quota = F.round(F.col("__stratum") * F.least(F.lit(1.0), F.lit(float(n)) / total))
    return placed.where(F.col("__at") < quota).drop("__h", "__at", "__stratum")


SUBSAMPLE_STATS = ("mean", "std", "variance", "min", "max", "q25", "median", "q75")


def subsample_statistics(df: DataFrame, k: int, value_col: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Eight statistics of the full series against every k-th row, with percent difference.

    Deviations are population ones.
    """
    placed = with_position(df, keys, order, pos="__at")
    both = placed.select(
        *keys,
        F.col(value_col).alias("v"),
        F.explode(F.array_compact(F.array(F.lit("full"), F.when(F.col("__at") % k == 0, F.lit("sub"))))).alias("segment"),
    )
    group = [*keys, "segment"]
    moments = both.groupBy(*group).agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.var_pop("v").alias("variance"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quartiles = exact_percentiles(both, group, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    stats = join_on_keys(moments, quartiles, group)
    long = stats.select(
        *group,
        F.inline(F.array(*(
            F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in SUBSAMPLE_STATS
        ))),
    )
    wide = long.groupBy(*keys, "stat").agg(
        F.max(F.when(F.col("segment") == "full", F.col("value"))).alias("full_value"),
        F.max(F.when(F.col("segment") == "sub", F.col("value"))).alias("sub_value"),
    )
    return wide.withColumn(
        "diff_pct", F.try_divide(F.col("sub_value") - F.col("full_value"), "full_value") * 100
    )


def lag_correlations(
    df: DataFrame, value_col: str, lags: Sequence[int], keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Pearson correlation of a series with itself at each lag; NULL when too short."""
    keys = list(keys)
    lagged = ordered_windows(
        df.select(*keys, *order, value_col),
        keys,
        list(order),
        lambda spec: {f"__lag{k}": F.lag(value_col, k).over(spec) for k in lags},
        before=max(lags),
    )
    wide = lagged.groupBy(*keys).agg(*(pearson(f"__lag{k}", value_col).alias(f"__r{k}") for k in lags))
    rows = [F.struct(F.lit(k).alias("lag"), F.col(f"__r{k}").alias("autocorr")) for k in lags]
    return wide.select(*keys, F.inline(F.array(*rows)))


def subsample_autocorrelation(
    df: DataFrame,
    k: int,
    value_col: str,
    keys: Sequence[str],
    order: Sequence[str],
    lags: Sequence[int] = (1, 10, 50, 250, 1250),
) -> DataFrame:
    """Autocorrelation at each lag against that of every k-th row at ``lag // k``."""
    full = lag_correlations(df, value_col, lags, keys, order).withColumnRenamed("autocorr", "full_autocorr")
    short = sorted({lag // k for lag in lags if lag // k > 0})
    paired = full.withColumn("sub_lag", (F.col("lag") / k).cast("int"))
    if short:
        sub = lag_correlations(every_kth(df, k, keys, order), value_col, short, keys, order)
        sub = sub.select(*keys, F.col("lag").alias("sub_lag"), F.col("autocorr").alias("sub_autocorr"))
        paired = join_on_keys(paired, sub, [*keys, "sub_lag"], "left")
    else:
        paired = paired.withColumn("sub_autocorr", F.lit(None).cast("double"))
    close = F.abs(F.col("full_autocorr") - F.col("sub_autocorr")) < 0.1
    return paired.withColumn("preserved", F.coalesce(close, F.lit(False)))
