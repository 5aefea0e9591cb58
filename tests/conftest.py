from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield session


@pytest.fixture(params=["one_task", "distributed"])
def either_path(request, spark):
    """Run a test with plain windows and again with the distributed forms forced."""
    spread = request.param == "distributed"
    spark.conf.set("spark.grainwise.maxGroupRows", "0" if spread else "1000000")
    # Without this the small inputs would be coalesced into one partition again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not spread).lower())
    yield request.param
    spark.conf.set("spark.grainwise.maxGroupRows", "1000000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
