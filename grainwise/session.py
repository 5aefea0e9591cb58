"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark_session(app_name: str = "grainwise", local_mode: bool = True) -> SparkSession:
    """Return the active session or build one.

    Local mode uses every core and a small number of shuffle partitions. On a cluster
    nothing but the application name and adaptive execution is set here, so that memory,
    partition counts and ``spark.checkpoint.dir`` stay with whoever submits the job.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if local_mode:
        builder = (
            builder.master("local[*]")
            .config("spark.driver.memory", "4g")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.session.timeZone", "UTC")
        )
    return builder.getOrCreate()
