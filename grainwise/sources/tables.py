"""Table readers and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.plans.ordering import with_position

LABELLED_SIGNAL = "value double, label int"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_labelled_signal(spark: SparkSession, path: str) -> DataFrame:
    """Header-less CSV of value and label; the line order becomes the 0-based time.

    File name and line offset inside the file are what defines the order, so the position
    is computed over both and files may be read in parallel.
    """
    lines = spark.read.schema(LABELLED_SIGNAL).csv(path)
    ordered = lines.withColumns(
        {"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start")}
    ).withColumn("__line", F.monotonically_increasing_id())
    placed = with_position(ordered, [], ["__file", "__start", "__line"], pos="timestamp")
    return placed.select("timestamp", "value", "label")


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write parquet, clustered by the partition columns so that no task writes to all of them.

    Rows of one partition value may still be spread over several tasks (rebalance splits
    large ones), so a hot date does not end in one file writer.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_datasets(datasets: Mapping[str, DataFrame], root: str, mode: str = "errorifexists") -> dict[str, str]:
    """Write each named dataset below ``root``; returns the folders."""
    folders = {}
    for name, df in datasets.items():
        folders[name] = f"{root.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(folders[name])
    return folders
