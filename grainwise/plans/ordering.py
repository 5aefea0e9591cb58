"""Ordered analytics that never put one whole series into one task.

Every operator here takes the same route. A size check decides whether all groups are
small enough for an ordinary window. If not, rows are range-partitioned on the full sort
key, so that a hot series is spread over many tasks, and written once; per-partition
totals (one row per series and partition) supply the offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.functions.stats import known
from grainwise.plans.ranks import distinct_counts, group_sizes, missed, sketched_counts, worth_sketching
from grainwise.plans.scratch import fits_one_task, group_bound, join_measured, join_on_keys, materialize

BLOCK_ROWS = 65_536

_ROW = "__row"
_PART = "__part"
_BLOCK = "__block"


def _as_sort(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _laid_out(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Range-partition and sort by keys and order, number the rows, write once."""
    sort = [F.col(k).asc_nulls_first() for k in keys] + _as_sort(order)
    numbered = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn(_ROW, F.monotonically_increasing_id())
        # The id carries the partition in its upper bits, rows in the lower 33.
        .withColumn(_PART, F.shiftright(_ROW, 33))
    )
    return materialize(numbered)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    pos: str = "pos",
    length: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row inside its series, and optionally the length.

    With no keys the position is global over the whole table.
    """
    if fits_one_task(df, keys):
        spec = Window.partitionBy(*keys)
        out = df.withColumn(pos, (F.row_number().over(spec.orderBy(*_as_sort(order))) - 1).cast("bigint"))
        return out.withColumn(length, F.count(F.lit(1)).over(spec)) if length else out
    laid = _laid_out(df, keys, order)
    runs = laid.groupBy(_PART, *keys).agg(F.min(_ROW).alias("__first"), F.count(F.lit(1)).alias("__n"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        _PART,
        *keys,
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(by_key).alias("__len"),
    )
    out = join_measured(laid, runs, [_PART, *keys]).withColumn(pos, F.col(_ROW) + F.col("__shift"))
    if length:
        out = out.withColumn(length, F.col("__len"))
    return out.drop(_ROW, _PART, "__shift", "__len")


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
    bounded: bool | None = None,
) -> DataFrame:
    """Add inclusive running sums per series.

    ``sums`` maps new column to source column; ``totals`` maps new column to the source
    column whose whole-series sum it receives. ``bounded`` carries over the result of a
    size check that was already made.
    """
    totals = dict(totals or {})
    running = {f"__run_{i}": source for i, source in enumerate(dict.fromkeys(sums.values()))}
    whole = Window.partitionBy(*keys)
    if fits_one_task(df, keys) if bounded is None else bounded:
        to_here = whole.orderBy(*_as_sort(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns(
            {
                **{out: F.sum(source).over(to_here) for out, source in sums.items()},
                **{out: F.sum(source).over(whole) for out, source in totals.items()},
            }
        )
    laid = _laid_out(df, keys, order)
    local = Window.partitionBy(_PART, *keys).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    laid_running = laid.withColumns({name: F.sum(source).over(local) for name, source in running.items()})
    wanted = list(dict.fromkeys([*sums.values(), *totals.values()]))
    runs = laid.groupBy(_PART, *keys).agg(*(F.sum(c).alias(f"__part_{c}") for c in wanted))
    before = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        _PART,
        *keys,
        *(F.sum(f"__part_{c}").over(before).alias(f"__before_{c}") for c in wanted),
        *(F.sum(f"__part_{c}").over(whole).alias(f"__total_{c}") for c in wanted),
    )
    joined = join_on_keys(laid_running, runs, [_PART, *keys])
    by_source = {source: name for name, source in running.items()}

    def carried(source: str) -> Column:
        name, offset = by_source[source], f"__before_{source}"
        return F.when(F.col(name).isNull(), F.col(offset)).otherwise(
            F.col(name) + F.coalesce(F.col(offset), F.lit(0))
        )

    out = joined.withColumns(
        {
            **{o: carried(source) for o, source in sums.items()},
            **{o: F.col(f"__total_{source}") for o, source in totals.items()},
        }
    )
    return out.drop(
        _ROW, _PART, *running, *(f"__before_{c}" for c in wanted), *(f"__total_{c}" for c in wanted)
    )


def with_blocks(
    df: DataFrame, before: int, after: int, size: int = BLOCK_ROWS, pos: str = "pos"
) -> DataFrame:
    """Assign rows to fixed-length blocks of a series and copy the edges.

    Each block holds ``size`` rows of its own plus the ``before`` preceding and ``after``
    following ones. ``__home`` tells own rows from copies.
    """
    if max(before, after) > size:
        raise ValueError(f"halo of {max(before, after)} rows exceeds the block of {size}")
    home = F.floor(F.col(pos) / F.lit(size)).cast("bigint")
    offset = F.col(pos) % size
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        )
    )
    return df.withColumn(_BLOCK, F.explode(copies)).withColumn("__home", F.col(_BLOCK) == home)


def ordered_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    before: int = 0,
    after: int = 0,
    size: int = BLOCK_ROWS,
    pos: str | None = None,
    length: str | None = None,
) -> DataFrame:
    """Add window columns whose frame reaches at most ``before``/``after`` rows.

    ``columns`` receives the window to use. Series within the bound use a plain window
    per key; longer ones are computed block by block with a halo.
    """
    if fits_one_task(df, keys):
        spec = Window.partitionBy(*keys).orderBy(*_as_sort(order))
        extra: dict[str, Column] = {}
        if pos:
            extra[pos] = (F.row_number().over(spec) - 1).cast("bigint")
        if length:
            extra[length] = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return df.withColumns({**extra, **columns(spec)})
    at = pos or "__pos"
    block = max(size, before, after)
    placed = with_blocks(with_position(df, keys, order, pos=at, length=length), before, after, block, at)
    spec = Window.partitionBy(*keys, _BLOCK).orderBy(at)
    out = placed.withColumns(dict(columns(spec))).where("__home").drop(_BLOCK, "__home")
    return out if pos else out.drop(at)


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hash-partition for a compute-bound stage.

    The partition number is given outright: adaptive execution sizes partitions by bytes
    and would leave a few small but expensive ones.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def map_pieces(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[pd.DataFrame], Mapping[str, np.ndarray]],
    schema: str,
    pos: str = "pos",
) -> DataFrame:
    """Run ``fn`` on every (keys, block) piece of ``with_blocks``; returns keys plus ``schema``.

    Pieces are clustered and sorted by Spark and streamed through each task, so a task
    holds one Arrow batch and one piece, and many short series share a task without the
    cost of a group each.
    """
    keys = list(keys)
    columns = df.columns
    marked = (
        spread(df.withColumn("__piece", F.xxhash64(*keys, _BLOCK)), [*keys, _BLOCK])
        .sortWithinPartitions(*keys, _BLOCK, pos)
    )
    fields = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(schema).fields])
    names = fields.names

    def result(piece: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(fn(piece))
        for key in keys:
            out[key] = piece[key].iloc[0]
        return out[names]

    def run(batches):
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            ids = rows["__piece"].to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1)]
            done = [result(rows.iloc[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if done:
                yield pd.concat(done, ignore_index=True)
            rest = rows.iloc[edges[-1] :] if len(rows) else None
        if rest is not None and len(rest):
            yield result(rest)

    return marked.select("__piece", *columns).mapInPandas(run, fields)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    distinct: str | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per entry of ``probs``.

    Long groups go by sketches, which bracket each rank, and a scan that keeps the values in
    the brackets. Else equal values are merged into counts. The wanted ranks are located on
    running counts, which are distributed for groups beyond the bound. ``distinct`` names an
    output column for the number of different values. ``sizes`` are known bounds of the number of
    groups and of the rows in one. Groups without values have no row.
    """
    # NaN is missing, as NULL is; among the values it would stand above all others.
    real = isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType))
    present = df.where(known(value).isNotNull() if real else F.col(value).isNotNull()).select(*keys, value)
    groups, largest = sizes or group_sizes(present, keys)
    if worth_sketching(present, groups, largest):
        counted = sketched_counts(present, keys, value, list(probs.values()))
        picked = materialize(_at_ranks(counted, keys, ["__cell", "__out", value], value, probs, {}, fits_one_task(counted, keys)))
        if not missed(picked, list(probs)):
            if not distinct:
                return picked.select(*keys, *probs)
            different = distinct_counts(present, keys, value, distinct)
            if not keys:
                return picked.withColumn(distinct, different.select(distinct).scalar())
            return join_on_keys(picked, different, keys).select(*keys, *probs, distinct)
    counted = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    bounded = largest <= group_bound(df.sparkSession) > 0
    if not bounded:
        # Merged counts may be few although the rows are many, so look again. They are
        # written once rather than computed for the look and again for the use.
        counted = materialize(counted)
        bounded = fits_one_task(counted, keys)
    totals = {}
    if distinct:
        counted, totals = counted.withColumn("__one", F.lit(1).cast("bigint")), {distinct: "__one"}
    return _at_ranks(counted, keys, [value], value, probs, totals, bounded).select(*keys, *probs, *totals)


def _at_ranks(
    counted: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    totals: Mapping[str, str],
    bounded: bool,
) -> DataFrame:
    """Interpolated values at the wanted ranks of rows that stand for ``__c`` rows each."""
    totals = {"__n": "__c", **totals}
    ranked = prefix_sums(counted, keys, order, {"__upto": "__c"}, totals, bounded)
    targets = {name: f"((__n - 1) * {p!r}D)" for name, p in probs.items()}
    # Only the rows that hold a wanted rank go on: at most two per group and percentile.
    # A short array test keeps the generated code of this step small.
    hit = F.expr(f"exists(array({', '.join(targets.values())}), t -> floor(t) < __upto AND ceil(t) >= __upto - __c)")

    def at_rank(rank: str) -> str:
        return f"max(CASE WHEN __upto - __c <= {rank} AND {rank} < __upto THEN CAST(`{value}` AS DOUBLE) END)"

    aggregates = [
        F.expr(f"{at_rank(f'{fn}{t}')} AS `__{fn}_{name}`") for name, t in targets.items() for fn in ("floor", "ceil")
    ]
    sizes = [F.max(name).alias(name) for name in totals]
    picked = ranked.where(hit).groupBy(*keys).agg(*sizes, *aggregates)
    interpolated = [
        F.expr(
            f"`__floor_{name}` + ({t} - floor{t}) * (`__ceil_{name}` - `__floor_{name}`) AS `{name}`"
        )
        for name, t in targets.items()
    ]
    return picked.select(*keys, *interpolated, *(name for name in totals if name != "__n"))


def hash_order(columns: Sequence[str], seed: int) -> Column:
    """Repeatable pseudo-random sort key of a row: md5 over its keys and the seed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


#: Picks up to this many rows are a bounded top-n in one scan.
TOP_ROWS = 10_000
#: Hexadecimal digits by which each count of the hashes is finer than the one before.
CELL_DIGITS = 4


def pick_by_hash(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest ``hash_order``, ties in order of the keys; all rows if there are fewer.

    A large pick sorts nothing but its border: counts of hash prefixes (65,536 at most at a time)
    give the prefix in which the n-th row lies. Rows below it pass where they are, and only
    rows with that prefix are ranked, over many tasks if they are many.
    """
    if n <= TOP_ROWS:
        return df.orderBy(hash_order(keys, seed), *keys).limit(n)
    hashed = df.withColumn("__h", hash_order(keys, seed))
    prefix, left = "", n
    for digits in (CELL_DIGITS, 2 * CELL_DIGITS):
        cell = F.substring("__h", 1, digits)
        counts = hashed.where(F.startswith("__h", F.lit(prefix))).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
        if not prefix and sum(r.n for r in counts) <= n:
            return df
        for r in counts:
            if left <= r.n:
                break
            left -= r.n
        prefix = r.cell
        if r.n <= TOP_ROWS:
            break
    own = F.substring("__h", 1, len(prefix))
    border = with_position(hashed.where(own == prefix), [], ["__h", *keys], pos="__place").where(F.col("__place") < left)
    return hashed.where(own < prefix).unionByName(border.drop("__place")).drop("__h")
