"""Scratch tables, size checks and labelled samples shared by the operators."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.plans.scratch import scratch_path

#: Rows of a few narrow columns that may be broadcast; a larger side takes a shuffle join.
BROADCAST_ROWS = 200_000
#: Spark's setting that removes a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: read again, never computed again.

    As nothing else uses the shuffles of this write, their files go as soon as it is done.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table made by ``written`` once all that was read from it is written too."""
    for file in table.inputFiles()[:1]:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as keep them from all columns of ``df``."""
    mark = "__"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a written table of narrow rows has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string")) % parts


def in_sample(key: str, most: int, rows: int) -> Column:
    """True for about ``most`` of ``rows`` rows at most, chosen by a hash of the key: the same rows on every run.

    Used only to fit a model on labelled rows; ``most`` is the documented bound.
    """
    if rows <= most:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) < int(most / rows * (1 << 30))


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """The rows that ``in_sample`` chooses among all of ``df``."""
    return df.where(in_sample(key, most, df.count()))


def share(spark: SparkSession, model) -> Broadcast:
    """Broadcast a model of bounded size together with its class, for ``shared`` in the tasks."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shared(box: Broadcast):
    return pickle.loads(box.value)
