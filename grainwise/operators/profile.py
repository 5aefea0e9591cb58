"""Column profiling: one value-count pass serves density, cardinality and entropy."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.functions.semantics import cardinality_class, column_semantics
from grainwise.functions.stats import entropy_from_counts, harmonic_score, known, pearson
from grainwise.plans.ordering import exact_percentiles
from grainwise.plans.scratch import join_on_keys, materialize

DIGEST_OVER = 64


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _is_text(field: T.StructField) -> bool:
    return not isinstance(field.dataType, (*WHOLE, T.DoubleType, T.FloatType))


def _plain_text(field: T.StructField) -> Column:
    column, kind = F.col(f"`{field.name}`"), field.dataType
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
    return F.to_json(F.struct(column.alias("v"))) if nested else column.cast("string")


def _digest(text: Column) -> Column:
    """Long texts are compared by digest; their beginning travels along as a sample."""
    digest = F.concat(F.md5(text), F.lit(":"), F.substring(text, 1, 50))
    return F.when(F.length(text) > DIGEST_OVER, F.rpad(digest, DIGEST_OVER + 19, " ")).otherwise(text)


def _typed(field: T.StructField) -> tuple[Column, Column, Column]:
    """The value as (bigint, double, text), two of them NULL; no number is printed here."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    whole, real, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, WHOLE):
        whole = column.cast("bigint")
    elif not _is_text(field):
        real = column.cast("double")
    else:
        text = _digest(_plain_text(field))
    return whole, real, text


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long table (column, dtype, value, sample, is_zero, n): occurrences per column and value.

    All columns are counted in a single shuffle on typed values. Texts longer than 64
    characters are identified by their digest.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    entries = []
    for i, field in enumerate(fields):
        whole, real, text = _typed(field)
        entries.append(
            F.struct(F.lit(i).alias("at"), whole.alias("whole"), real.alias("real"), text.alias("text"))
        )
    long = df.select(F.inline(F.array(*entries)))
    counts = long.groupBy("at", "whole", "real", "text").agg(F.count(F.lit(1)).alias("n"))
    digested = F.length("text") > DIGEST_OVER
    names, kinds = F.array(*(F.lit(f.name) for f in fields)), F.array(*(F.lit(f.dataType.simpleString()) for f in fields))
    decimals = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.DecimalType)]
    value = F.coalesce(F.col("whole").cast("string"), F.col("real").cast("string"), F.col("text"))
    zero = (F.col("whole") == 0) | (F.col("real") == 0)
    if decimals:
        zero = zero | (F.col("at").isin(decimals) & (F.col("text").try_cast("double") == 0))
    return counts.select(
        F.element_at(names, F.col("at") + 1).alias("column"),
        F.element_at(kinds, F.col("at") + 1).alias("dtype"),
        value.alias("value"),
        F.when(digested, F.rtrim(F.substring("text", 34, 50))).otherwise(F.substring(value, 1, 50)).alias("sample"),
        F.coalesce(zero, F.lit(False)).alias("is_zero"),
        "n",
    )


def attribute_analysis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Information profile of every column, most informative first.

    NULL counts as a value for cardinality and entropy. Numeric columns also get the share
    of rows that are not zero; NULLs count as not zero there.
    """
    n = F.sum("n")
    density = F.try_divide(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)), n)
    nonzero = F.try_divide(F.sum(F.when(~F.col("is_zero"), F.col("n")).otherwise(0)), n)
    profile = value_counts(df, columns).groupBy("column", "dtype").agg(
        density.alias("d"),
        nonzero.alias("z"),
        F.try_divide(F.count(F.lit(1)), n).alias("c"),
        entropy_from_counts("n").alias("h"),
        F.coalesce(F.min("sample"), F.lit("<null>")).alias("sample_value"),
    )
    score = harmonic_score(F.col("d"), F.col("z"), F.col("c"), F.col("h"))
    return profile.select(
        "column",
        "dtype",
        F.round("d", 6).alias("value_density"),
        F.round("z", 6).alias("nonzero_density"),
        F.round("c", 6).alias("cardinality_ratio"),
        F.round("h", 4).alias("entropy"),
        F.round(score, 6).alias("information_score"),
        "sample_value",
    ).orderBy(F.desc("information_score"), "column")



def calculate_attribute_scores(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Density, cardinality, entropy without NULLs, their harmonic mean and a class."""
    counts = value_counts(df, columns)
    n = F.sum("n")
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    scored = counts.groupBy("column", "dtype").agg(
        F.try_divide(F.coalesce(F.sum(known), F.lit(0)), n).alias("value_density"),
        F.try_divide(F.count(known), n).alias("cardinality_ratio"),
        entropy_from_counts(known).alias("entropy"),
    )
    return scored.withColumns(
        {
            "cardinality_class": cardinality_class("cardinality_ratio"),
            "attribute_score": harmonic_score(
                F.col("value_density"), F.col("cardinality_ratio"), F.col("entropy")
            ),
        }
    )


def ranked_scores(scores: DataFrame, score_col: str = "attribute_score") -> DataFrame:
    """Positive scores with their median as a reference line; one row per column."""
    positive = scores.where(F.col(score_col) > 1e-9)
    median = positive.agg(F.percentile(score_col, 0.5).alias("m"))
    return positive.withColumn("median_score", median.scalar()).orderBy(F.desc(score_col), "column")


def shannon_entropy(df: DataFrame, columns: Sequence[str] | None = None, null_as_value: bool = True) -> DataFrame:
    """Entropy in nats per column; NULL is a category of its own unless told otherwise."""
    counts = value_counts(df, columns)
    weight = F.col("n") if null_as_value else F.when(F.col("value").isNotNull(), F.col("n"))
    return counts.groupBy("column").agg(entropy_from_counts(weight).alias("entropy"))


def catalog_semantics(catalog: DataFrame, column: str = "column") -> DataFrame:
    """Semantic role of every column listed in a catalog table."""
    s = column_semantics(column)
    return catalog.withColumns(
        {
            "semantic_category": s.getField("category"),
            "semantic_subcategory": s.getField("subcategory"),
            "expected_characteristics": s.getField("expected"),
            "unit": s.getField("unit"),
            "quality_checks": s.getField("quality_checks"),
        }
    )


def stratified_column_filter(
    profile: DataFrame,
    primary_key_threshold: float = 0.9,
    sparse_threshold: float = 0.6,
    grouping_cardinality: float = 0.1,
    grouping_completeness: float = 0.95,
    resource_id_min: float = 0.5,
    resource_id_max: float = 0.9,
    resource_id_completeness: float = 0.95,
    composite_min: float = 0.1,
    composite_max: float = 0.5,
    composite_info_score: float = 0.3,
) -> DataFrame:
    """Flag the columns of a profile for dropping and keeping, with the reason.

    A column may carry both flags or neither.
    """
    card, dens = F.col("cardinality_ratio"), F.col("value_density")
    drops = {
        "primary_key": card > primary_key_threshold,
        "sparse": dens < sparse_threshold,
    }
    keeps = {
        "grouping": (card <= grouping_cardinality) & (dens > grouping_completeness),
        "resource_id": (card > resource_id_min) & (card <= resource_id_max) & (dens > resource_id_completeness),
        "composite": (card > composite_min)
        & (card <= composite_max)
        & (F.col("information_score") > composite_info_score),
    }

    def why(tests: dict[str, Column]) -> Column:
        return F.concat_ws(",", *(F.when(test, F.lit(name)) for name, test in tests.items()))

    flagged = profile.withColumns({"drop_reason": why(drops), "keep_reason": why(keeps)})
    return flagged.withColumns(
        {"drop_flag": F.col("drop_reason") != "", "keep_flag": F.col("keep_reason") != ""}
    )


# -- correlation --------------------------------------------------------------------


def pairwise_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Pearson correlation of every pair of columns, long form, in one aggregation.

    Rows where either value is NULL or NaN do not count for a pair, whatever the plan.
    A handful of pairs is a plain aggregate. Beyond that, generated aggregate code grows
    with the square of the columns, so the co-moments of all pairs are taken as matrix
    products per Arrow batch and one row per pair leaves each task.
    """
    names = list(columns or numeric_columns(df))
    pairs = list(combinations(names, 2))
    if group_cols or len(pairs) <= WIDE_PAIRS:
        return correlations_of(df, pairs, group_cols)
    return _matrix_correlations(df, names)


WIDE_PAIRS = 6


def _matrix_correlations(df: DataFrame, names: list[str]) -> DataFrame:
    # Centring constants: one number per column. A constant column is shifted to exact zeros.
    doubles = df.select(*(known(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)))
    centre = doubles.agg(
        *(F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).alias(c) for c in doubles.columns)
    ).first()
    shift = np.array([np.nan if v is None else v for v in centre])
    first, second = np.triu_indices(len(names), 1)

    def co_moments(batches):
        k = len(shift)
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            n += known.T @ known
            sx += x.T @ known
            sxx += (x * x).T @ known
            sxy += x.T @ x
        cells = {"n": n[first, second], "sxy": sxy[first, second]}
        cells |= {"sx": sx[first, second], "sxx": sxx[first, second]}
        cells |= {"sy": sx[second, first], "syy": sxx[second, first]}
        yield pa.RecordBatch.from_pydict({"i": first.astype("int32"), "j": second.astype("int32"), **cells})

    sums = ["n", "sxy", "sx", "sxx", "sy", "syy"]
    partial = doubles.mapInArrow(co_moments, "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    total = partial.select("i", "j", *sums).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in sums))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    var_x = F.col("sxx") - F.try_divide(sx * sx, n)
    var_y = F.col("syy") - F.try_divide(sy * sy, n)
    # Rounding noise of a column that is constant on the shared rows does not count as variance.
    varies = (var_x > 1e-12 * F.col("sxx")) & (var_y > 1e-12 * F.col("syy"))
    covariance = F.col("sxy") - F.try_divide(sx * sy, n)
    labels = F.array(*(F.lit(c) for c in names))
    return total.select(
        F.element_at(labels, F.col("i") + 1).alias("col1"),
        F.element_at(labels, F.col("j") + 1).alias("col2"),
        F.when(varies, covariance / F.sqrt(var_x * var_y)).alias("correlation"),
    )


def correlations_of(df: DataFrame, pairs: Sequence[tuple[str, str]], group_cols: Sequence[str] = ()) -> DataFrame:
    """Correlation of the listed pairs, optionally by group."""
    wide = df.groupBy(*group_cols).agg(*(pearson(a, b).alias(f"__r{i}") for i, (a, b) in enumerate(pairs)))
    rows = [
        F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.col(f"__r{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(*group_cols, F.inline(F.array(*rows)))


def correlated_pairs(correlations: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs above the threshold (strict), with the absolute correlation."""
    strength = F.abs("correlation")
    return correlations.where(strength > threshold).withColumn("correlation", strength)


def redundant_columns(pairs: DataFrame, scores: DataFrame, score_col: str = "information_score") -> DataFrame:
    """The column to drop of each pair: the lower score, the first one on a tie."""
    score = scores.select("column", F.col(score_col).alias("__s"))
    first = join_on_keys(pairs, score.withColumnsRenamed({"column": "col1", "__s": "__s1"}), ["col1"], "left")
    both = join_on_keys(first, score.withColumnsRenamed({"column": "col2", "__s": "__s2"}), ["col2"], "left")
    keeps_first = F.coalesce("__s1", F.lit(0.0)) > F.coalesce("__s2", F.lit(0.0))
    return both.select(F.when(keeps_first, F.col("col2")).otherwise(F.col("col1")).alias("column")).distinct()


def correlation_summary(correlations: DataFrame, redundant_above: float = 0.95) -> DataFrame:
    strength = F.abs("correlation")
    return correlations.agg(
        F.count("correlation").alias("pairs"),
        F.min(strength).alias("min_abs"),
        F.max(strength).alias("max_abs"),
        F.avg(strength).alias("mean_abs"),
        F.coalesce(F.min(strength) > redundant_above, F.lit(False)).alias("all_redundant"),
    )


def correlation_matrix(correlations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide symmetric matrix with a unit diagonal."""
    mirrored = correlations.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "correlation")
    names = correlations.sparkSession.createDataFrame([(c,) for c in columns], "col1 string")
    diagonal = names.select("col1", F.col("col1").alias("col2"), F.lit(1.0).alias("correlation"))
    full = correlations.select("col1", "col2", "correlation").unionByName(mirrored).unionByName(diagonal)
    return full.groupBy(F.col("col1").alias("column")).pivot("col2", list(columns)).agg(F.first("correlation"))


# -- column summaries ---------------------------------------------------------------


def numeric_column_summary(df: DataFrame, null_threshold: float = 95.0) -> DataFrame:
    """NULL share, distinct values, quartiles and moments of the numeric columns.

    Moments of all columns come from one aggregate without a shuffle of rows. Quartiles and
    distinct values come from equal values merged as what they are, so that large whole
    numbers stay apart; the figures shown are doubles. NaN counts as NULL.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    name = lambda f: F.lit(f.name).alias("column")
    measures = {"null_pct": lambda v: F.try_divide(F.count_if(v.isNull()) * 100.0, F.count(F.lit(1))), "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev}
    wide = df.agg(*(make(known(F.col(f"`{f.name}`"))).alias(f"{m}_{i}") for i, f in enumerate(fields) for m, make in measures.items()))
    base = wide.select(F.inline(F.array(*(F.struct(name(f), *(F.col(f"{m}_{i}").alias(m) for m in measures)) for i, f in enumerate(fields)))))
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    parts, rows = [], df.count()
    for kind, own in (("bigint", [f for f in fields if isinstance(f.dataType, WHOLE)]), ("double", [f for f in fields if not isinstance(f.dataType, WHOLE)])):
        if own:
            entries = [F.struct(name(f), F.col(f"`{f.name}`").cast(kind).alias("value")) for f in own]
            parts.append(exact_percentiles(df.select(F.inline(F.array(*entries))), ["column"], "value", probs, "unique", (len(own), rows)))
    quartiles = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    joined = join_on_keys(base.where(F.col("null_pct") <= null_threshold), quartiles, ["column"], "left")
    return joined.withColumns(
        {"null_pct": F.round("null_pct", 2), "unique": F.coalesce("unique", F.lit(0).cast("bigint"))}
    ).select("column", "null_pct", "min", "max", "mean", "std", *probs, "unique")


def categorical_column_summary(df: DataFrame, null_threshold: float = 95.0) -> DataFrame:
    """NULL share, distinct values, entropy and the most frequent value of text columns.

    Ties for the top value go to the smaller one.
    """
    counts = value_counts(df, string_columns(df))
    n = F.sum("n")
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    # max_by on (count, reversed order of the text) is not available, so the tie-break is
    # a minimum over structs with the negated count.
    top = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("sample").alias("v"))))
    summary = counts.groupBy("column", "dtype").agg(
        F.try_divide(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) * 100.0, n).alias("p"),
        F.count(known).alias("unique"),
        F.try_divide(F.count(known), n).alias("ratio"),
        entropy_from_counts(known).alias("h"),
        top.alias("top"),
        n.alias("rows"),
    )
    return summary.where(F.col("p") <= null_threshold).select(
        "column",
        "dtype",
        F.round("p", 2).alias("null_pct"),
        "unique",
        F.round("ratio", 6).alias("cardinality_ratio"),
        cardinality_class("ratio").alias("card_class"),
        F.round("h", 4).alias("entropy"),
        F.coalesce(F.substring("top.v", 1, 30), F.lit("<null>")).alias("top_value"),
        F.coalesce(F.round(F.try_divide(-F.col("top.k"), F.col("rows")) * 100, 2), F.lit(0.0)).alias("top_value_pct"),
    )


def top_value_frequencies(df: DataFrame, columns: Sequence[str], top_n: int = 10) -> DataFrame:
    """Most frequent values per column, in full, with their share among the values shown.

    Texts beyond 64 characters are counted by digest, which also orders ties among them;
    the full text is looked up for the rows shown, of which there are ``top_n`` per column.
    """
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    best = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    shown = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("column"))
    found = shown.select("column", "rank", "value", F.col("n").alias("count"), share.alias("share"))
    long = [f for f in df.schema.fields if f.name in columns and _is_text(f)]
    if not long:
        return found
    # Counted once; without a digest among the rows shown the texts need no second look.
    found = materialize(found)
    digests = found.where(F.length("value") > DIGEST_OVER).select("column", "value")
    if digests.isEmpty():
        return found
    entries = [F.struct(F.lit(f.name).alias("column"), _plain_text(f).alias("full")) for f in long]
    texts = df.select(F.inline(F.array(*entries))).where(F.length("full") > DIGEST_OVER)
    keyed = texts.select("column", _digest(F.col("full")).alias("value"), "full")
    full = keyed.join(F.broadcast(digests), ["column", "value"]).groupBy("column", "value").agg(F.first("full").alias("full"))
    joined = found.join(F.broadcast(full), ["column", "value"], "left")
    return joined.select("column", "rank", F.coalesce("full", "value").alias("value"), "count", "share")


def dimension_cost_summary(df: DataFrame, dimensions: Sequence[str], cost_col: str, top_n: int = 10) -> DataFrame:
    """Top values of each dimension by cost; all dimensions in one pass."""
    entries = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    long = df.select(cost_col, F.inline(F.array(*entries)))
    costs = long.groupBy("dimension", "value").agg(F.sum(cost_col).alias("total_cost"))
    best = Window.partitionBy("dimension").orderBy(F.desc("total_cost"), "value")
    return costs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)


def dimension_cardinalities(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-NULL values per dimension, long form."""
    if approx:
        wide = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns))
        rows = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("distinct_values")) for c in columns]
        return wide.select(F.inline(F.array(*rows)))
    entries = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*entries)))
    return long.groupBy("dimension").agg(F.count_distinct("value").alias("distinct_values"))


def grouped_quartiles(df: DataFrame, columns: Sequence[str], group_col: str) -> DataFrame:
    """Quartiles of each numeric column per group, NULLs left out, on all rows."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(F.col(group_col).alias("group"), F.inline(F.array(*entries)))
    keys = ["column", "group"]
    quartiles = exact_percentiles(long, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    sizes = long.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return join_on_keys(sizes, quartiles, keys)
