"""Which compound key makes stable series: persistence, discovery, dependencies, Pareto."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainwise.plans.frame import GrainFrame, grain_label
from grainwise.plans.ordering import prefix_sums


def _entity_days(frame: GrainFrame, grains: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per grain and entity with the number of distinct days; one pass over the data.

    Rows are first reduced to distinct (finest keys, day) so that the expansion by grain
    works on far fewer rows than the table holds.
    """
    resolved = {name: frame.resolve_grain(cols) for name, cols in grains.items()}
    used = [key for key in frame.hierarchy if any(key in cols for cols in resolved.values())]
    day, cost = frame.time_col, frame.metric_col
    finest = frame.df.groupBy(*used, day).agg(F.sum(cost).alias(cost))
    sets = [[*cols, day] for cols in resolved.values()]
    days = finest.groupingSets(sets, *used, day).agg(F.sum(cost).alias(cost), F.grouping_id().alias("__gid"))
    days = days.withColumn("grain", grain_label(used, list(resolved.values()), trailing=1, names=list(resolved)))
    return days.groupBy("grain", *used).agg(
        F.count(F.lit(1)).alias("days_present"), F.sum(cost).alias("total_cost")
    )


def grain_persistence_stats(
    frame: GrainFrame, grains: Mapping[str, Sequence[str]], min_days: int = 30
) -> DataFrame:
    """Entities, stable entities and days present for every candidate grain.

    NULL dates are no days; a NULL key is an entity like any other.
    """
    entities = _entity_days(frame.with_df(frame.df.where(F.col(frame.time_col).isNotNull())), grains)
    summary = entities.groupBy("grain").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("days_present") >= min_days).alias("stable_count"),
        F.percentile_approx("days_present", 0.5).alias("median_days"),
        F.avg("days_present").alias("mean"),
    )
    return summary.select(
        "grain",
        "entities",
        "stable_count",
        F.coalesce(F.round(F.try_divide(F.col("stable_count") * 100.0, "entities"), 1), F.lit(0.0)).alias("stable_pct"),
        "median_days",
        F.round("mean", 1).alias("mean_days"),
    )


def grain_candidates(frame: GrainFrame, max_keys: int | None = None, prefixes_only: bool = False) -> dict[str, list[str]]:
    """Candidate grains: prefixes of the hierarchy, or all its subsets up to a size."""
    keys = list(frame.hierarchy)
    if prefixes_only:
        chosen = [keys[: i + 1] for i in range(len(keys))]
    else:
        chosen = [list(c) for size in range(1, (max_keys or len(keys)) + 1) for c in combinations(keys, size)]
    return {" > ".join(c): c for c in chosen}


def grain_discovery(
    frame: GrainFrame,
    grains: Mapping[str, Sequence[str]] | None = None,
    min_days: int = 30,
    stability_threshold: float = 70.0,
) -> DataFrame:
    """Persistence of all candidates, ranked; ``optimal`` marks the finest stable grain.

    A grain is viable when enough of its entities persist. The viable grain with most
    entities wins; without any, the most stable one does.
    """
    stats = grain_persistence_stats(frame, grains or grain_candidates(frame), min_days)
    viable = F.col("stable_pct") >= stability_threshold
    ranked = Window.orderBy(
        F.desc("viable"),
        F.desc(F.when(F.col("viable"), F.col("entities").cast("double")).otherwise(F.col("stable_pct"))),
        "grain",
    )
    # One row per candidate grain at this point.
    return stats.withColumn("viable", viable).withColumn("rank", F.row_number().over(ranked)).withColumn(
        "optimal", F.col("rank") == 1
    )


def top_cost_drivers(
    frame: GrainFrame, grain: Sequence[str], min_days: int = 30, top_n: int = 10
) -> DataFrame:
    """Stable entities by cost with their share of the whole."""
    keys = frame.resolve_grain(grain)
    drivers = (
        _entity_days(frame.with_df(frame.df.where(F.col(frame.time_col).isNotNull())), {"g": keys})
        .where(F.col("days_present") >= min_days)
        .orderBy(F.desc("total_cost"), *keys)
        .limit(top_n)
    )
    total = frame.df.agg(F.sum(frame.metric_col).alias("t")).scalar()
    return drivers.select(*keys, "days_present", "total_cost", F.try_divide("total_cost", total).alias("cost_share"))


def pareto_curve(frame: GrainFrame, grain: Sequence[str]) -> DataFrame:
    """Cumulative share of cost over entities ranked by cost."""
    keys = frame.resolve_grain(grain)
    totals = frame.df.groupBy(*keys).agg(F.sum(frame.metric_col).alias("total_cost"), F.lit(1).cast("bigint").alias("__one"))
    ranked = prefix_sums(
        totals,
        [],
        [F.desc_nulls_last("total_cost"), *(F.col(k) for k in keys)],
        {"rank": "__one", "__upto": "total_cost"},
        {"__all": "total_cost", "__entities": "__one"},
    )
    return ranked.select(
        *keys,
        "total_cost",
        "rank",
        F.try_divide("rank", "__entities").alias("entity_share"),
        F.try_divide("__upto", "__all").alias("cumulative_share"),
    )


def compound_key_analysis(frame: GrainFrame, keys: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Distinct entities and mean rows per entity for several keys in one pass."""
    grains = [frame.resolve_grain(k) for k in (keys or [frame.hierarchy[: i + 1] for i in range(len(frame.hierarchy))])]
    used = [k for k in frame.hierarchy if any(k in g for g in grains)]
    grouped = frame.df.groupingSets([list(g) for g in grains], *used).agg(
        F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("__gid")
    )
    return (
        grouped.withColumn("key", grain_label(used, grains))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("unique_entities"), F.avg("rows").alias("mean_records_per_entity"))
    )


def functional_dependencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For every ordered pair: does a value of A determine the value of B?

    A determines B when there are as many distinct (A, B) pairs as distinct values of A.
    One pass; all distinct counts share a single unpivoted aggregate.
    """
    entries = [
        F.struct(F.lit(c).alias("a"), F.lit("").alias("b"), F.to_json(F.struct(F.col(c).alias("x"))).alias("v"))
        for c in columns
    ]
    entries += [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.to_json(F.struct(F.col(a).alias("x"), F.col(b).alias("y"))).alias("v"),
        )
        for a, b in combinations(columns, 2)
    ]
    distinct = (
        df.select(*columns)
        .distinct()
        .select(F.inline(F.array(*entries)))
        .groupBy("a", "b")
        .agg(F.count_distinct("v").alias("n"))
    )
    # One row per column or pair of columns from here on.
    collected = distinct.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "a", "b"), "n"))).alias("m"))
    order = {c: i for i, c in enumerate(columns)}
    rows = []
    for a, b in permutations(columns, 2):
        low, high = sorted((a, b), key=order.get)
        single, pair = F.element_at("m", F.lit(f"{a}|")), F.element_at("m", F.lit(f"{low}|{high}"))
        rows.append(
            F.struct(
                F.lit(a).alias("determinant"),
                F.lit(b).alias("dependent"),
                single.alias("distinct_determinant"),
                pair.alias("distinct_pairs"),
                (single == pair).alias("holds"),
            )
        )
    return collected.select(F.inline(F.array(*rows)))


def minimal_dependencies(dependencies: DataFrame) -> list[tuple[str, str]]:
    """Edges left after transitive reduction; columns that determine each other stay linked.

    Works on the list of column pairs, not on data.
    """
    edges = {(row.determinant, row.dependent) for row in dependencies.where("holds").collect()}

    def implied(a: str, b: str) -> bool:
        middles = {c for x, c in edges if x == a and c != b}
        return any((c, b) in edges and (c, a) not in edges and (b, c) not in edges for c in middles)

    return sorted((a, b) for a, b in edges if not implied(a, b))


def dependency_edges(dependencies: DataFrame) -> DataFrame:
    """``minimal_dependencies`` as a table (determinant, dependent).

    Dependencies are transitive, so an edge is implied if one column between its ends is enough
    to go round it, which neither end determines back. One row per column pair goes in.
    """
    held = dependencies.where("holds").select("determinant", "dependent")
    edge = lambda name, a, b: held.select(F.col("determinant").alias(a), F.col("dependent").alias(b), F.lit(True).alias(name))
    steps = edge("ac", "a", "c").join(edge("cb", "c", "b"), "c").where("a <> b")
    one_way = steps.join(edge("ca", "c", "a"), ["c", "a"], "left_anti").join(edge("bc", "b", "c"), ["b", "c"], "left_anti")
    implied = one_way.select(F.col("a").alias("determinant"), F.col("b").alias("dependent")).distinct()
    return held.join(implied, ["determinant", "dependent"], "left_anti")
