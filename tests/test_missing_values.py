"""Missing values, short series and other edges: one rule for NULL and NaN everywhere."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from support import rows
from grainwise.operators import anomaly as A
from grainwise.operators import cost as C
from grainwise.operators import profile as P
from grainwise.operators import signals as G
from grainwise.operators import windows as V
from grainwise.plans.ordering import exact_percentiles
from grainwise.plans.scratch import join_measured

NAN = float("nan")


@pytest.mark.parametrize("columns", [4, 5])
def test_nan_counts_as_missing_in_either_correlation_plan(spark, columns):
    data = [(1.0, 2.0, 1.0, 5.0, 1.0), (2.0, 4.0, 0.0, 3.0, 2.0), (3.0, 6.0, 4.0, 1.0, 0.0), (NAN, 9.0, 2.0, 7.0, 3.0), (None, 1.0, 2.0, 2.0, 2.0)]
    names = ["a", "b", "c", "d", "e"][:columns]
    df = spark.createDataFrame([r[:columns] for r in data], ", ".join(f"{n} double" for n in names))
    got = {(r.col1, r.col2): r.correlation for r in P.pairwise_correlations(df).collect()}
    assert len(got) == columns * (columns - 1) // 2
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "d"] == pytest.approx(-1.0)
    assert all(v is not None and not math.isnan(v) for v in got.values())


def test_nan_moves_no_quartile_and_is_no_outlier(spark, either_path):
    data = [("k", i, float(i % 10)) for i in range(40)] + [("k", 40, 500.0), ("k", 41, NAN), ("k", 42, None)]
    df = spark.createDataFrame(data, "k string, id int, v double")
    quartile = exact_percentiles(df, ["k"], "v", {"q": 0.5}).first().q
    assert quartile == exact_percentiles(df.where("id < 41"), ["k"], "v", {"q": 0.5}).first().q
    for flagged in (A.outliers_iqr(df, "v", ["k"]), A.outliers_iqr(df, "v"), A.outliers_zscore(df, "v", ["k"]), A.outliers_zscore(df, "v")):
        assert flagged.count() == len(data)
        assert [r.id for r in flagged.where("is_outlier").collect()] == [40]


def test_forest_keeps_rows_with_missing_features(spark):
    data = [(i, float(i % 7), float(i % 5)) for i in range(60)] + [(60, None, 1.0), (61, NAN, 1.0), (62, 90.0, 90.0)]
    scored = A.isolation_forest(spark.createDataFrame(data, "id int, x double, y double"), ["x", "y"], ["id"], contamination=0.02, trees=20, exact_cut=True)
    got = {r.id: r for r in scored.collect()}
    assert len(got) == len(data)
    assert got[60].anomaly_score is None and got[61].anomaly_score is None and not got[60].is_outlier and not got[61].is_outlier
    assert got[62].is_outlier


def test_large_whole_numbers_stay_apart(spark):
    df = spark.createDataFrame([((1 << 60) + i, float(i % 3)) for i in range(10)], "id long, x double")
    got = {r.column: r for r in P.numeric_column_summary(df).collect()}
    assert got["id"].unique == 10 and got["x"].unique == 3 and got["x"].min == 0.0 and got["x"].median == 1.0


def test_top_values_are_whole_texts(spark):
    texts = [f"{'same beginning ' * 6}{tail}" for tail in "abc"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts * 2 + texts[:1] + [None, "short"])], "t string, i int")
    got = P.top_value_frequencies(df, ["t", "i"], 4).where("column = 't'").orderBy("rank").collect()
    assert got[0].value == texts[0] and {r.value for r in got} == {*texts, "short"}


def test_gap_keeps_its_place(spark, either_path):
    wave = [math.sin(i * math.pi / 4) for i in range(64)]
    data = [("whole", i, v) for i, v in enumerate(wave)] + [("gap", i, None if i == 20 else NAN if i == 41 else v) for i, v in enumerate(wave)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    got = {(r.k, r.lag): r.acf for r in G.autocorrelation(df, ["k"], ["t"], "v", max_lag=10).collect()}
    assert got["gap", 8] == pytest.approx(got["whole", 8], abs=0.05) and got["gap", 8] > 0.75


def test_unit_root_of_short_series_has_no_verdict(spark, either_path):
    data = [("one", 0, 1.0), ("two", 0, 1.0), ("two", 1, 2.0), ("three", 0, 1.0), ("three", 1, 3.0), ("three", 2, 2.0)]
    data += [("long", i, float((i * 7919) % 13)) for i in range(60)]
    got = {r.k: r for r in G.adf_test(spark.createDataFrame(data, "k string, t int, v double"), ["k"], ["t"], "v").collect()}
    assert set(got) == {"one", "two", "three", "long"}
    assert all(got[k].adf_statistic is None and got[k].p_value is None and got[k].stationary is None for k in ("one", "two", "three"))
    assert got["long"].stationary


@pytest.mark.parametrize(
    ("every", "rounding", "want"),
    [
        ("1 week", "floor", dt.datetime(2025, 10, 6)),
        ("1 weeks", "round", dt.datetime(2025, 10, 6)),
        ("1 month", "floor", dt.datetime(2025, 10, 1)),
        ("1 month", "round", dt.datetime(2025, 10, 1)),
        ("2 months", "floor", dt.datetime(2025, 9, 1)),
        ("1 quarter", "floor", dt.datetime(2025, 10, 1)),
        ("1 year", "round", dt.datetime(2026, 1, 1)),
        ("4 hours", "floor", dt.datetime(2025, 10, 6)),
    ],
)
def test_periods_of_the_calendar(spark, every, rounding, want):
    df = spark.createDataFrame([(dt.datetime(2025, 10, 6, 1),)], "t timestamp_ntz")
    got = df.select(C.period_bucket("t", every, rounding).alias("p")).collect()
    assert [r.p for r in got] == [want]


def test_series_on_instants_needs_no_single_task(spark, either_path):
    start = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(minutes=i), float(i % 50)) for i in range(300)], "ts timestamp_ntz, v double")
    assert rows(C.temporal_quality_metrics(df, "ts", "v"))[0][2] == 300


def test_many_copies_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(V, "COPIES_AT_ONCE", 7)
    data = [("r", 0, i) for i in range(500)] + [("r", 1, 500), ("r", 1, 501), ("r", 1, 502)]
    df = spark.createDataFrame(data, "resource_id string, label int, window int")
    after = V.oversample_anomalies(df, contamination=0.1).where("label = 1")
    got = sorted(tuple(r) for r in after.groupBy("window").agg(F.count("*"), F.max("replica"), F.countDistinct("replica")).collect())
    assert sum(n for _, n, _, _ in got) == 50 and all(n == top + 1 == distinct for _, n, top, distinct in got)


def test_wide_rows_are_not_broadcast(spark):
    left = spark.createDataFrame([(i,) for i in range(5)], "k int")
    right = spark.createDataFrame([(i, "x" * 1000) for i in range(5)], "k int, v string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(join_measured(left, right, ["k"]))
    spark.conf.set("spark.grainwise.broadcastBytes", "1000")
    try:
        assert "broadcast" not in plan(join_measured(left, right, ["k"]))
    finally:
        spark.conf.unset("spark.grainwise.broadcastBytes")
