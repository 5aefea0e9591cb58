from __future__ import annotations

import datetime as dt

import pytest
from support import rows
from pyspark.sql import functions as F

from grainwise import BillingLoader, GrainError, GrainFrame, LoaderSpec, get_spark_session

SCHEMA = "date string, provider string, account string, region string, cost double"
DATA = [
    ("2025-01-01", "AWS", "a1", "east", 100.0),
    ("2025-01-01", "AWS", "a1", "west", 200.0),
    ("2025-01-02", "AWS", "a1", "east", 150.0),
]
KEYS = ["provider", "account", "region"]


@pytest.fixture
def frame(spark):
    return GrainFrame.from_dataframe(spark.createDataFrame(DATA, SCHEMA), KEYS)


def test_session_is_a_singleton(spark):
    assert get_spark_session() is spark


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    for args in ({"hierarchy": ["nope"]}, {"hierarchy": KEYS, "metric_col": "nope"}, {"hierarchy": KEYS, "time_col": "nope"}):
        with pytest.raises(GrainError, match="nope"):
            GrainFrame.from_dataframe(df, **args)


def test_grain_follows_hierarchy_order(frame):
    assert frame.resolve_grain(["region", "provider"]) == ["provider", "region"]
    with pytest.raises(GrainError, match="Invalid grain"):
        frame.resolve_grain(["zone"])


def test_building_a_frame_runs_no_job(spark):
    spark.sparkContext.setJobGroup("lazy", "lazy")
    df = spark.createDataFrame(DATA, SCHEMA)
    GrainFrame.from_dataframe(df, KEYS).filter(region="east").aggregate(["account"]).summary_stats()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_roll_up(frame):
    up = frame.aggregate(["account"])
    assert up.hierarchy == ("account",)
    assert rows(up.df) == [("a1", "2025-01-01", 300.0), ("a1", "2025-01-02", 150.0)]


def test_roll_up_at_own_grain_sums_duplicates(spark):
    df = spark.createDataFrame(DATA + DATA[:1], SCHEMA)
    frame = GrainFrame.from_dataframe(df, KEYS)
    assert frame.aggregate(KEYS).df.count() == 3
    assert frame.aggregate(KEYS, assume_unique=True).df.count() == 4


def test_many_roll_ups_in_one_pass(frame):
    many = frame.aggregate_many([["provider"], ["provider", "region"]])
    got = rows(many.select("grain", "region", "date", "cost"))
    assert ("provider", None, "2025-01-01", 300.0) in got
    assert ("provider > region", "west", "2025-01-01", 200.0) in got
    assert len(got) == 5


def test_filter(frame):
    assert frame.filter(region="east").df.count() == 2
    assert frame.filter(region="mars").is_empty()
    assert frame.filter().df.count() == 3
    with pytest.raises(GrainError):
        frame.filter(zone="x")


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz"])
def test_time_range_is_half_open(spark, kind):
    days = ["2025-01-01", "2025-01-05", "2025-01-10", "2025-01-15"]
    df = spark.createDataFrame([(d, "p", 1.0) for d in days], "date string, k string, cost double")
    frame = GrainFrame.from_dataframe(df.withColumn("date", F.col("date").cast(kind)), ["k"])
    assert frame.filter_time(start="2025-01-05", end="2025-01-15").df.count() == 2
    assert frame.filter_time(after="2025-01-05").df.count() == 3
    assert frame.filter_time(before="2025-01-05").df.count() == 1
    assert frame.filter_time().df.count() == 4
    pre, post = frame.split_at("2025-01-10")
    assert (pre.df.count(), post.df.count()) == (2, 2)


def test_bad_time_literal_fails_before_any_job(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 1), "p", 1.0)], "date date, k string, cost double")
    with pytest.raises(GrainError, match="ISO"):
        GrainFrame.from_dataframe(df, ["k"]).filter_time(start="soon")


def test_time_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2025, 1, 1), "p", 1.0)], "date date, k string, cost double")
    df.write.parquet(str(tmp_path / "t"))
    frame = GrainFrame.from_dataframe(spark.read.parquet(str(tmp_path / "t")), ["k"]).filter_time(start="2025-01-01")
    plan = frame.filter(k="p").df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2025-01-01)" in plan and "EqualTo(k,p)" in plan


def test_sample_keeps_whole_series_and_null_keys(spark):
    data = [(f"2025-01-0{d}", k, 1.0) for d in range(1, 4) for k in ("a", "b", None)]
    frame = GrainFrame.from_dataframe(spark.createDataFrame(data, "date string, k string, cost double"), ["k"])
    for n in (1, 2):
        assert frame.sample(["k"], n).df.count() == 3 * n
    assert frame.sample(["k"], 99).df.count() == 9
    assert rows(frame.sample(["k"], 1, seed=7).df) == rows(frame.sample(["k"], 1, seed=7).df)


def test_summary_stats(spark):
    data = [("2025-01-01", "p", 100.0), ("2025-01-02", "p", 200.0), ("2025-01-03", "p", 150.0), ("2025-01-04", "p", None)]
    frame = GrainFrame.from_dataframe(spark.createDataFrame(data, "date string, k string, cost double"), ["k"])
    assert rows(frame.summary_stats()) == [("p", 3, 150.0, 50.0, 100.0, 200.0)]


def test_single_row_has_no_deviation(spark):
    frame = GrainFrame.from_dataframe(spark.createDataFrame([("d", "p", 5.0)], "date string, k string, cost double"), ["k"])
    summary = frame.cost_summary_by_grain(["k"]).first()
    assert summary.std_cost is None and summary.total_cost == 5.0 and summary.days == 1


def test_cost_summary_sort_and_unknown_key(spark):
    data = [("1", "a", 1.0), ("2", "a", 9.0), ("1", "b", 6.0), ("2", "b", 6.0)]
    frame = GrainFrame.from_dataframe(spark.createDataFrame(data, "date string, k string, cost double"), ["k"])
    first = {by: frame.cost_summary_by_grain(["k"], by).first().k for by in ("total", "volatility", "median", "other")}
    assert first == {"total": "b", "volatility": "a", "median": "b", "other": "b"}


def test_empty_frame_gives_empty_results(spark):
    frame = GrainFrame.from_dataframe(spark.createDataFrame([], SCHEMA), KEYS)
    assert frame.is_empty()
    assert frame.cost_summary_by_grain(["region"]).count() == 0
    assert frame.treemap(["provider", "region"]).where("region is not null").count() == 0
    assert frame.sample(["region"], 2).is_empty()


def test_box_stats_whiskers_and_outliers(spark):
    values = [10.0, 11.0, 12.0, 13.0, 14.0, 100.0, 1.0]
    data = [(f"2025-01-{i + 1:02d}", "p", v) for i, v in enumerate(values)]
    frame = GrainFrame.from_dataframe(spark.createDataFrame(data, "date string, k string, cost double"), ["k"])
    box = frame.daily_box_stats(["k"], min_cost=5.0).first()
    assert (box.median, box.whisker_low, box.whisker_high, box.outliers, box.days) == (12.5, 10.0, 14.0, 1, 6)


def test_treemap_shares(frame):
    nodes = {(r.provider, r.region): r for r in frame.treemap(["provider", "region"]).collect()}
    assert nodes[(None, None)].total_cost == 450.0
    assert nodes[("AWS", "east")].pct_of_parent == pytest.approx(250 / 450 * 100)


def test_loader_renames_and_drops(spark):
    raw = spark.createDataFrame(
        [("2025-01-01", "AWS", "e", 1.0, 0.9, 0.8, 0.7, 0.6)],
        "usage_date string, cloud_provider string, billing_event_id string, materialized_cost double, "
        "materialized_discounted_cost double, materialized_amortized_cost double, materialized_invoiced_cost double, "
        "materialized_public_cost double",
    )
    frame = BillingLoader.load(raw, hierarchy=["cloud_provider"])
    assert frame.df.columns == ["date", "cloud_provider", "cost"]
    kept = BillingLoader.load(raw, hierarchy=["cloud_provider"], drop_cols=[])
    assert "materialized_public_cost" in kept.df.columns


def test_loader_default_hierarchy_and_validation(spark):
    keys = ["cloud_provider", "cloud_account_id", "region", "product_family", "usage_type"]
    raw = spark.createDataFrame([("d", *"abcde", 1.0)], ", ".join(f"{c} string" for c in ["usage_date", *keys]) + ", materialized_cost double")
    assert BillingLoader.load(raw).hierarchy == tuple(keys)
    with pytest.raises(GrainError):
        LoaderSpec(hierarchy=("usage_date",)).load(raw)
