from __future__ import annotations

import time

from support import rows
from pyspark.sql import functions as F

from grainwise.streaming import rollup as R

SCHEMA = "ts timestamp_ntz, k string, v double"


def write(spark, folder, data):
    df = spark.createDataFrame(data, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.mode("append").parquet(str(folder))
    return df


def test_roll_up_emits_closed_days_only(spark, tmp_path):
    df = write(spark, tmp_path / "in", [("2025-01-01 01:00", "a", 1.0), ("2025-01-01 23:00", "a", 2.0), ("2025-01-04 00:30", "b", 9.0)])
    stream = R.read_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema)
    out = R.run_available(R.stream_roll_up(stream, ["k"], "ts", "v", late_by="1 day"), "test")
    assert rows(out.select("k", "v", "records")) == [("a", 3.0, 2)]


def test_late_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    df = write(spark, folder, [("2025-01-01 01:00", "a", 1.0), ("2025-01-10 00:00", "a", 5.0)])
    # A batch judges lateness by the watermark its predecessor started with.
    for late in ([("2025-01-11 00:00", "a", 6.0)], [("2025-01-01 02:00", "a", 100.0), ("2025-01-20 00:00", "a", 7.0)]):
        time.sleep(1.1)
        write(spark, folder, late)
    stream = R.read_stream(spark, str(folder), "*.parquet", df.schema, files_per_batch=1)
    out = R.run_available(R.stream_roll_up(stream, ["k"], "ts", "v", late_by="1 day"), "test")
    assert rows(out.select("v")) == [(1.0,), (5.0,), (6.0,)]


def test_violations_join_static_bounds(spark, tmp_path):
    df = write(spark, tmp_path / "in", [("2025-01-01", "a", 1.0), ("2025-01-01", "a", 50.0), ("2025-01-01", "zz", 50.0)])
    bounds = spark.createDataFrame([("a", 0.0, 10.0)], "k string, lower double, upper double")
    stream = R.read_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema)
    out = R.run_available(R.stream_violations(stream, bounds, ["k"], "v").select("k", "v"), "test")
    assert rows(out) == [("a", 50.0)]


def test_flags_need_no_state(spark, tmp_path):
    data = spark.createDataFrame([(1.0, 1.0, 1.0), (150.0, 1.0, 1.0)], "cpu_utilization double, memory_utilization double, hourly_cost double")
    data.write.parquet(str(tmp_path / "in"))
    stream = R.read_stream(spark, str(tmp_path / "in"), "*.parquet", data.schema)
    out = R.run_available(R.stream_flags(stream), "test")
    assert rows(out.select("cpu_utilization", "is_idle", "is_valid")) == [(1.0, True, True), (150.0, False, False)]


def test_replayed_batches_write_nothing_twice(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "id int, cpu_utilization double, memory_utilization double, hourly_cost double"
    add = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
    add([(1, 10.0, 10.0, 1.0), (2, 110.0, -1.0, 1.0)])
    run = lambda: R.quarantine_stream(R.read_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema), out, state).start().awaitTermination()
    run()
    add([(3, None, 10.0, -2.0), (4, 5.0, 5.0, 5.0)])
    run()
    # the commit of the last batch is lost: the restart replays it
    lost = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (lost, lost.with_name(f".{lost.name}.crc")):
        file.unlink(missing_ok=True)
    run()
    kinds = spark.read.parquet(folder).schema
    assert rows(R.accepted(spark, out, kinds).select("id", "batch")) == [(1, 0), (4, 1)]
    assert rows(R.quarantined(spark, out, kinds).select("id", "violations")) == [
        (2, ["cpu_utilization out of valid range [0, 100]", "memory_utilization out of valid range [0, 100]"]),
        (3, ["hourly_cost cannot be negative"]),
    ]
