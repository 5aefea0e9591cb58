"""Comparing value distributions of data segments.

Segments are rows of one long table (segment, value). A comparison is a row
(name, left, right) of segment names, so any number of pairs is answered at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.stats import kolmogorov_tail, known
from grainwise.plans.ordering import exact_percentiles, prefix_sums
from grainwise.plans.scratch import join_measured, join_on_keys, materialize

Pairs = Mapping[str, tuple[str, str]]


def _value_counts(df: DataFrame, segment_col: str, value_col: str) -> DataFrame:
    """Occurrences per segment and value; NULL and NaN are missing."""
    return (
        df.where(known(value_col).isNotNull())
        .groupBy(F.col(segment_col).alias("segment"), F.col(value_col).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _per_pair(counts: DataFrame, pairs: Pairs) -> DataFrame:
    """Rows (name, side, value, n): each segment once for every pair it belongs to."""
    roles = [
        F.when(
            F.col("segment") == segment,
            F.struct(F.lit(name).alias("name"), F.lit(side).alias("side")),
        )
        for name, sides in pairs.items()
        for side, segment in enumerate(sides)
    ]
    return counts.withColumn("__role", F.explode(F.array_compact(F.array(*roles)))).select(
        F.col("__role.name").alias("name"), F.col("__role.side").alias("side"), "value", "n"
    )


def ks_tests(
    df: DataFrame, pairs: Pairs, segment_col: str = "segment", value_col: str = "value", alpha: float = 0.05
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test for every pair.

    Equal values are merged before anything is ordered. The statistic is exact, the
    p-value asymptotic.
    """
    per = _per_pair(_value_counts(df, segment_col, value_col), pairs)
    merged = per.groupBy("name", "value").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("__a"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("__b"),
    )
    ranked = prefix_sums(
        merged, ["name"], ["value"], {"__ca": "__a", "__cb": "__b"}, {"n1": "__a", "n2": "__b"}
    )
    gap = F.abs(F.try_divide("__ca", "n1") - F.try_divide("__cb", "n2"))
    result = ranked.groupBy("name").agg(
        F.max(gap).alias("ks_statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    tested = result.withColumn("p_value", kolmogorov_tail(F.col("ks_statistic"), n1, n2))
    different = F.col("p_value") < alpha
    return tested.select(
        "name",
        "ks_statistic",
        "p_value",
        different.alias("significant"),
        F.when(different, "Different distributions").otherwise("Similar distributions").alias("interpretation"),
    )


def _binned(per: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Add bin number and bounds over the joint range of each group; the last bin is closed."""
    ranges = per.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    joined = join_measured(per, ranges, list(keys))
    # A group of one single value gets a unit range around it.
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    joined = joined.withColumns({"lo": lo, "hi": hi})
    scaled = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return joined.withColumn("bin", F.least(scaled, F.lit(bins - 1)).cast("int"))


def kl_divergences(
    df: DataFrame,
    pairs: Pairs,
    segment_col: str = "segment",
    value_col: str = "value",
    bins: int = 100,
    symmetric: bool = True,
) -> DataFrame:
    """KL divergence of histograms over common bins for every pair, in nats.

    The small constant is added to the probabilities without normalising again. With
    ``symmetric`` each pair also gets the reverse direction under a name of its own.
    """
    per = _per_pair(_value_counts(df, segment_col, value_col), pairs)
    counts = (
        _binned(per, ["name"], bins)
        .groupBy("name", "bin")
        .agg(
            F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("b"),
        )
    )
    # At most `bins` rows per pair. Empty bins contribute epsilon * ln(1) = 0 and need no rows.
    totals = counts.groupBy("name").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    epsilon = F.lit(1e-10)
    p, q = F.col("a") / F.col("na") + epsilon, F.col("b") / F.col("nb") + epsilon
    sums = (
        join_on_keys(counts, totals, ["name"])
        .where((F.col("na") > 0) & (F.col("nb") > 0))
        .groupBy("name")
        .agg(F.sum(p * F.ln(p / q)).alias("forward"), F.sum(q * F.ln(q / p)).alias("backward"))
    )
    names = F.split("name", " vs ")
    swapped = F.when(F.col("name").contains(" vs "), F.concat_ws(" ↔ ", F.reverse(names))).otherwise(
        F.concat("name", F.lit(" (reversed)"))
    )
    entries = [F.struct(F.col("name").alias("name"), F.col("forward").alias("kl_divergence"))]
    if symmetric:
        entries.append(F.struct(swapped.alias("name"), F.col("backward").alias("kl_divergence")))
    value = F.col("kl_divergence")
    return (
        sums.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.name", "e.kl_divergence")
        .withColumn(
            "interpretation",
            F.when(value > 1.0, "Very different").when(value > 0.1, "Moderately different").otherwise("Similar"),
        )
    )


def empirical_cdf(df: DataFrame, segment_col: str = "segment", value_col: str = "value") -> DataFrame:
    """Share of values up to each distinct value, per segment."""
    counts = _value_counts(df, segment_col, value_col)
    ranked = prefix_sums(counts, ["segment"], ["value"], {"__upto": "n"}, {"__n": "n"})
    return ranked.select("segment", "value", (F.col("__upto") / F.col("__n")).alias("cdf"))


def density_histogram(df: DataFrame, bins: int = 50, segment_col: str = "segment", value_col: str = "value") -> DataFrame:
    """Equal-width histogram per segment, normalised to unit area; empty bins included."""
    binned = _binned(_value_counts(df, segment_col, value_col), ["segment"], bins)
    counts = binned.groupBy("segment", "bin").agg(F.sum("n").alias("count"))
    bounds = binned.groupBy("segment").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum("n").alias("total")
    )
    spine = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = join_on_keys(spine, counts, ["segment", "bin"], "left")
    width = (F.col("hi") - F.col("lo")) / bins
    count = F.coalesce("count", F.lit(0))
    return filled.select(
        "segment",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        count.alias("count"),
        (count / (F.col("total") * width)).alias("density"),
    )


#: Bandwidths within which a grid point is in reach of a value.
KERNEL_REACH = 9


def gaussian_kde(
    df: DataFrame,
    points: int = 200,
    segment_col: str = "segment",
    value_col: str = "value",
    bins: int | None = None,
) -> DataFrame:
    """Gaussian kernel density of each segment on a common grid over the joint range.

    Scott's bandwidth. Equal values are merged first; every distinct value then meets only
    the grid points within KERNEL_REACH bandwidths, beyond which its kernel is below 1e-17
    of its peak. As bandwidths fall with the rows, so does the number of those points. Sums
    are made map-side, so the shuffle carries one row per task and grid point. Points out of
    every value's reach have density 0; NULL and NaN take no part, constant segments have no
    density. ``bins`` trades exactness for a fixed amount of work per segment: values are
    first moved to the centre of one of so many cells of its range.
    """
    counts = _value_counts(df, segment_col, value_col)
    if bins:
        cells = _binned(counts, ["segment"], bins)
        centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
        counts = cells.groupBy("segment", centre.alias("value")).agg(F.sum("n").alias("n"))
    value = known(value_col)
    sizes = df.where(value.isNotNull()).groupBy(F.col(segment_col).alias("segment")).agg(
        F.count(F.lit(1)).alias("size"), F.stddev(value.cast("double")).alias("std")
    )
    bandwidth = F.col("std") * F.pow(F.col("size").cast("double"), -0.2)
    spread = materialize(sizes.select("segment", "size", bandwidth.alias("h")).where(F.col("h") > 0))
    grid = counts.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("g")).scalar()
    lo, step = grid.getField("lo"), (grid.getField("hi") - grid.getField("lo")) / (points - 1)
    place, reach = (F.col("value") - F.col("lo")) / F.col("step"), KERNEL_REACH * F.col("h") / F.col("step")
    first = F.greatest(F.ceil(place - reach), F.lit(0)).cast("int")
    last = F.least(F.floor(place + reach), F.lit(points - 1)).cast("int")
    met = join_measured(counts, spread, ["segment"]).withColumns({"lo": lo, "step": step}).withColumns({"first": first, "last": last}).where("first <= last")
    z = (F.col("lo") + F.col("point") * F.col("step") - F.col("value")) / F.col("h")
    kernel = F.exp(-0.5 * z * z) / (F.col("h") * F.sqrt(2 * F.pi())) * F.col("n")
    weights = met.withColumn("point", F.explode(F.sequence("first", "last"))).select("segment", "point", kernel.alias("w"), "size")
    every = spread.select("segment", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), F.lit(0.0).alias("w"), "size")
    return weights.unionByName(every).groupBy("segment", "point").agg((F.sum("w") / F.first("size")).alias("pdf")).select("segment", "point", (lo + F.col("point") * step).alias("x"), "pdf")


def distribution_report(
    df: DataFrame, pairs: Pairs, segment_col: str = "segment", value_col: str = "value", alpha: float = 0.05
) -> DataFrame:
    """KS verdict and KL divergence per pair, with the most different pair marked."""
    ks = ks_tests(df, pairs, segment_col, value_col, alpha)
    kl = kl_divergences(df, pairs, segment_col, value_col, symmetric=False)
    both = join_on_keys(ks, kl.select("name", "kl_divergence"), ["name"], "left")
    largest = ks.agg(F.max("ks_statistic").alias("m")).scalar()
    return both.withColumn("largest_difference", F.col("ks_statistic") == largest)


def segment_statistics(
    df: DataFrame,
    segment_col: str = "segment",
    value_col: str = "value",
    population: bool = True,
    quartiles: bool = True,
) -> DataFrame:
    """count, mean, std, min, max and quartiles of each segment."""
    deviation = F.stddev_pop if population else F.stddev_samp
    moments = df.groupBy(segment_col).agg(
        F.count(value_col).alias("count"),
        F.avg(value_col).alias("mean"),
        deviation(value_col).alias("std"),
        F.min(value_col).alias("min"),
        F.max(value_col).alias("max"),
    )
    if not quartiles:
        return moments
    spread = exact_percentiles(df, [segment_col], value_col, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return join_on_keys(moments, spread, [segment_col], "left")


def with_segments(df: DataFrame, segments: Mapping[str, Column], value_col: str = "value") -> DataFrame:
    """Long (segment, value) table; a row belongs to every segment whose condition holds."""
    names = [F.when(test, F.lit(name)) for name, test in segments.items()]
    return df.select(F.explode(F.array_compact(F.array(*names))).alias("segment"), F.col(value_col).alias("value"))
