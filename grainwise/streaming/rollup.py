"""Structured Streaming forms of the batch roll-ups and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from grainwise.operators.transforms import with_waste_flags
from grainwise.plans.scratch import scratch_path
from grainwise.sources.mldata import with_violations


def event_time(stream: DataFrame, time_col: str) -> DataFrame:
    """A watermark needs a zoned timestamp; zone-less ones are read in the session zone."""
    if isinstance(stream.schema[time_col].dataType, T.TimestampNTZType):
        return stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return stream


def stream_roll_up(
    stream: DataFrame,
    grain: Sequence[str],
    time_col: str,
    metric_col: str,
    every: str = "1 day",
    late_by: str = "1 day",
) -> DataFrame:
    """Metric sum by grain and period; a period is final once the watermark has passed it."""
    windowed = (
        event_time(stream, time_col)
        .withWatermark(time_col, late_by)
        .groupBy(F.window(time_col, every).alias("w"), *grain)
        .agg(F.sum(metric_col).alias(metric_col), F.count(F.lit(1)).alias("records"))
    )
    return windowed.select(F.col("w.start").alias("period_start"), *grain, metric_col, "records")


def stream_flags(stream: DataFrame) -> DataFrame:
    """Idle, over-provisioned and waste columns plus a range check; stateless."""
    valid = (
        F.col("cpu_utilization").between(0, 100)
        & F.col("memory_utilization").between(0, 100)
        & (F.col("hourly_cost") >= 0)
    )
    return stream.transform(with_waste_flags()).withColumn("is_valid", F.coalesce(valid, F.lit(False)))


def stream_violations(
    stream: DataFrame, bounds: DataFrame, keys: Sequence[str], value_col: str, lower_col: str = "lower", upper_col: str = "upper"
) -> DataFrame:
    """Rows outside the interval of their key, from a static table of bounds."""
    joined = stream.join(bounds, list(keys), "inner")
    value = F.col(value_col)
    return joined.where((value < F.col(lower_col)) | (value > F.col(upper_col)))


def read_stream(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there into a parquet table in the shared scratch folder and read it."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def quarantine_stream(stream: DataFrame, out: str, state: str, with_labels: bool = False) -> DataStreamWriter:
    """Write a stream's rows to ``out``, the valid ones apart from those that break a rule, with the rules' names.

    Each micro-batch is one scan into a folder of its own number, which a replay of the batch
    overwrites: after a restart no row is there twice. Read the two sides by ``accepted`` and ``quarantined``.
    """

    def sink(batch: DataFrame, number: int) -> None:
        checked = with_violations(batch, with_labels)
        marked = checked.withColumn("accepted", F.size("violations") == 0)
        marked.write.mode("overwrite").partitionBy("accepted").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True)


def _checked(spark: SparkSession, out: str, schema: T.StructType, accepted: bool) -> DataFrame:
    fields = [*schema.fields, T.StructField("violations", T.ArrayType(T.StringType())), T.StructField("batch", T.LongType()), T.StructField("accepted", T.BooleanType())]
    return spark.read.schema(T.StructType(fields)).parquet(out).where(F.col("accepted") == accepted)


def accepted(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The valid rows of ``quarantine_stream`` with their batch."""
    return _checked(spark, out, schema, True).drop("accepted", "violations")


def quarantined(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The other rows, with the names of the rules that each breaks and their batch."""
    return _checked(spark, out, schema, False).drop("accepted")
