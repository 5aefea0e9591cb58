"""Reliable cut points and size checks shared by the distributed operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_BOUND_KEY = "spark.grainwise.maxGroupRows"
GROUP_BOUND_DEFAULT = 1_000_000
BROADCAST_ROWS_KEY = "spark.grainwise.broadcastRows"
BROADCAST_ROWS_DEFAULT = 500_000
BROADCAST_BYTES_KEY = "spark.grainwise.broadcastBytes"
BROADCAST_BYTES_DEFAULT = 64 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and scratch tables.

    The folder named by ``spark.checkpoint.dir`` wins. Only a local session may fall back
    to a temporary folder of its own: on a cluster such a folder would not be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the files.

    Needed where two branches must see the very same partition layout.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def group_bound(spark: SparkSession) -> int:
    """Largest group, in rows, that may be handled inside one task."""
    return int(spark.conf.get(GROUP_BOUND_KEY, str(GROUP_BOUND_DEFAULT)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the biggest group; one partially aggregated pass over the keys only."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def fits_one_task(df: DataFrame, keys: Sequence[str]) -> bool:
    """True when every group is proven to be within the group bound."""
    bound = group_bound(df.sparkSession)
    return bound > 0 and largest_group(df, keys) <= bound


def join_measured(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a fact table with one row per key, moving the fact table only if it must move.

    The right side is an aggregate of unknown size. It is written once and counted: a
    small one is broadcast, so that the fact table is not shuffled and a hot key does no
    harm. A large one takes the shuffle join, where adaptive execution splits hot keys.
    """
    written = materialize(right)
    conf = left.sparkSession.conf
    rows_limit = int(conf.get(BROADCAST_ROWS_KEY, str(BROADCAST_ROWS_DEFAULT)))
    bytes_limit = int(conf.get(BROADCAST_BYTES_KEY, str(BROADCAST_BYTES_DEFAULT)))
    size = F.sum(F.octet_length(F.to_json(F.struct(*written.columns))))
    rows, size = written.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    small = rows <= rows_limit and size <= bytes_limit
    return join_on_keys(left, F.broadcast(written) if small else written, keys, how)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left key columns only.

    No broadcast hint is given: adaptive execution broadcasts the right side when its
    measured size allows it and splits skewed partitions otherwise.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    joined = left.join(renamed, condition, how)
    return joined if how == "left_semi" else joined.drop(*(f"__r_{k}" for k in keys))
