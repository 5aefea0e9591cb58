"""Operators on small frames with known answers, edge cases included."""

from __future__ import annotations

import math

import numpy as np
import pytest
from support import rows
from pyspark.sql import functions as F

from grainwise.functions import stats as S
from grainwise.functions import utilisation as U
from grainwise.functions.semantics import column_semantics
from grainwise.operators import anomaly as A
from grainwise.operators import cost as C
from grainwise.operators import distribution as D
from grainwise.operators import fleet as L
from grainwise.operators import forecast as FC
from grainwise.operators import grain as G
from grainwise.operators import profile as P
from grainwise.operators import transforms as X
from grainwise.operators import windows as V
from grainwise.plans.frame import GrainFrame
from grainwise.sources import mldata as M
from grainwise.sources.tables import read_labelled_signal, write_parquet


# -- transforms ---------------------------------------------------------------------


@pytest.mark.parametrize("calendar", [True, False])
def test_pct_change_by_group(spark, either_path, calendar):
    data = [("A", "3", 99.0), ("A", "1", 100.0), ("A", "2", 110.0), ("B", "1", 50.0), ("B", "2", 25.0)]
    df = spark.createDataFrame(data, "g string, d string, v double")
    got = {(r.g, r.d): r.pct_change for r in df.transform(X.pct_change("v", "d", "g", calendar=calendar)).collect()}
    assert got[("A", "1")] is None and got[("B", "1")] is None
    assert got[("A", "2")] == pytest.approx(0.1) and got[("A", "3")] == pytest.approx(-0.1)
    assert got[("B", "2")] == pytest.approx(-0.5)


def test_pct_change_null_and_zero(spark):
    df = spark.createDataFrame([("1", 1.0), ("2", None), ("3", 0.0), ("4", 5.0)], "d string, v double")
    assert [r.c for r in df.transform(X.pct_change("v", "d", output_col="c")).orderBy("d").collect()] == [None] * 4


def test_summary_stats_custom_names(spark):
    df = spark.createDataFrame([("A", 100.0), ("A", 200.0), ("A", None), ("B", 50.0)], "g string, v double")
    out = df.transform(X.summary_stats("v", "g", {"mean": "avg_v"}))
    assert out.columns == ["g", "count", "avg_v", "stddev", "min", "max"]
    got = {r.g: (r["count"], r.avg_v, r.stddev) for r in out.collect()}
    assert got["A"][:2] == (2, 150.0) and got["A"][2] == pytest.approx(70.710678)
    assert got["B"] == (1, 50.0, None)


def test_rolling_flag_matches_convolution(spark, either_path):
    rng = np.random.default_rng(1)
    cpu, mem = rng.uniform(0, 40, 60), rng.uniform(0, 60, 60)
    df = spark.createDataFrame(
        [("r", i, float(c), float(m)) for i, (c, m) in enumerate(zip(cpu, mem))],
        "resource_id string, timestamp int, cpu_utilization double, memory_utilization double",
    )
    out = df.transform(X.rolling_overprovisioned()).orderBy("timestamp").collect()
    smooth = np.convolve(cpu, np.ones(20) / 20, mode="same")
    assert [r.cpu_smooth for r in out] == pytest.approx(list(smooth))


def test_cutoff_without_a_drop_keeps_everything(spark):
    daily = spark.createDataFrame([("1", None), ("2", 0.1)], "d string, change double")
    facts = spark.createDataFrame([("1",), ("2",)], "d string")
    assert facts.transform(X.before_cutoff(daily, "d", "change")).count() == 2


def test_minmax_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert {r.v_norm for r in df.transform(X.minmax_scaled(df, ["v"])).collect()} == {None}


def test_utilisation_expressions(spark):
    df = spark.createDataFrame([(4.0, 9.0), (70.0, 80.0), (100.0, 100.0)], "cpu_utilization double, memory_utilization double")
    got = df.select(U.is_idle().alias("i"), U.waste_with_headroom().alias("w"), U.efficiency_score(F.lit(0.1)).alias("e")).collect()
    assert [r.i for r in got] == [True, False, False]
    assert got[0].w == pytest.approx((0.7 + 0.6) / 2 * 100) and got[2].w == 0.0
    assert got[1].e == pytest.approx(90.0)


# -- semantics and profile ----------------------------------------------------------


@pytest.mark.parametrize(
    "name, category, subcategory",
    [
        ("materialized_discounted_cost", "financial", "cost_discounted"),
        ("on_demand_PRICE", "financial", "cost_list_price"),
        ("cost", "financial", "cost_unknown"),
        ("usage_date", "consumption", "usage_metric"),
        ("provider", "identifier", "reference_key"),
        ("row_uuid", "identifier", "unique_key"),
        ("date", "temporal", "date"),
        ("_k8s_pod", "kubernetes", "container_metadata"),
        ("account", "cloud_hierarchy", "account_identifier"),
        ("service", "cloud_hierarchy", "product_taxonomy"),
        ("cloud", "cloud_hierarchy", "provider"),
        ("zone", "cloud_hierarchy", "geographic"),
        ("label", "metadata", "descriptive"),
        ("row_count", "aggregation", "record_count"),
        ("xyz", "unknown", "unclassified"),
    ],
)
def test_semantics(spark, name, category, subcategory):
    s = spark.range(1).select(column_semantics(F.lit(name)).alias("s")).first().s
    assert (s.category, s.subcategory) == (category, subcategory)


def test_profile_of_mixed_types(spark):
    data = [(1, 0.0, "a", None, [1]), (2, -0.0, "a", None, [1]), (3, 2.5, None, None, [2]), (4, None, "b", None, None)]
    df = spark.createDataFrame(data, "i int, d double, s string, n decimal(9,2), l array<int>")
    got = {r.column: r for r in P.attribute_analysis(df).collect()}
    assert got["i"].cardinality_ratio == 1.0 and got["i"].entropy == pytest.approx(math.log(4), abs=1e-4)
    assert got["d"].nonzero_density == 0.5 and got["d"].value_density == 0.75
    assert got["s"].cardinality_ratio == 0.75 and got["s"].sample_value == "a"
    assert got["n"].value_density == 0.0 and got["n"].sample_value == "<null>"
    assert got["l"].cardinality_ratio == 0.75


def test_long_texts_count_by_content(spark):
    base = "x" * 500
    df = spark.createDataFrame([(base + "1",), (base + "2",), (base + "1",)], "t string")
    counts = P.value_counts(df).collect()
    assert sorted(r.n for r in counts) == [1, 2] and all(r["sample"] == "x" * 50 for r in counts)


def test_profile_of_an_empty_table_has_no_rows(spark):
    assert P.attribute_analysis(spark.createDataFrame([], "a int, b string")).count() == 0


def test_profile_runs_few_jobs(spark):
    df = spark.range(100).select(*((F.col("id") % (i + 2)).alias(f"c{i}") for i in range(12)))
    spark.sparkContext.setJobGroup("profile", "profile")
    P.attribute_analysis(df).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("profile")) <= 6
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_entropy_null_policy(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "s string")
    with_null = P.shannon_entropy(df).first().entropy
    without = P.shannon_entropy(df, null_as_value=False).first().entropy
    assert with_null == pytest.approx(1.5 * math.log(2)) and without == pytest.approx(math.log(2))


@pytest.mark.parametrize("columns", [["a", "b", "c"], ["a", "b", "c", "k", "n"]])
def test_correlations_with_constants_and_nulls(spark, columns):
    rng = np.random.default_rng(0)
    a = rng.normal(size=50)
    n = [None if i % 5 == 0 else float(v) for i, v in enumerate(rng.normal(size=50) + a)]
    df = spark.createDataFrame([(float(x), float(2 * x), float(-x), 7.3, y) for x, y in zip(a, n)], "a double, b double, c double, k double, n double")
    got = {(r.col1, r.col2): r.correlation for r in P.pairwise_correlations(df, columns).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("b", "c")] == pytest.approx(-1.0)
    if "k" in columns:
        assert got[("a", "k")] is None
        known = [i for i in range(50) if n[i] is not None]
        want = np.corrcoef(a[known], [n[i] for i in known])[0, 1]
        assert got[("a", "n")] == pytest.approx(want)


def test_redundant_choice_drops_the_first_on_a_tie(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("a", "x", 1.0)], "col1 string, col2 string, correlation double")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.9), ("d", 0.1)], "column string, information_score double")
    assert rows(P.redundant_columns(pairs, scores)) == [("a",), ("d",), ("x",)]


# -- cost and grain -----------------------------------------------------------------


def test_temporal_quality_of_a_gap(spark):
    df = spark.sql("SELECT date'2025-01-01' AS d, 1.0 AS v UNION ALL SELECT date'2025-01-04', 3.0")
    q = C.temporal_quality_metrics(df, "d", "v").first()
    assert (q.coverage_days, q.expected_days, q.completeness_pct, q.stability_class) == (2, 4, 50.0, "volatile")


def test_temporal_quality_of_one_day(spark):
    q = C.temporal_quality_metrics(spark.sql("SELECT date'2025-01-01' AS d, 1.0 AS v"), "d", "v").first()
    assert q.record_volume_cv is None and q.metric_lag1_autocorr == 0.0 and q.stability_class == "volatile"


def test_distribution_of_a_constant(spark, either_path):
    m = C.cost_distribution_metrics(spark.createDataFrame([(2.0,)] * 5, "c double"), "c").first()
    assert (m.p50, m.skewness, m.outlier_count_iqr, m.modeling_rec) == (2.0, 0.0, 0, "linear")


def test_alignment_stays_in_the_active_span(spark, either_path):
    data = [("A", "2025-01-02", 1.0), ("A", "2025-01-04", 2.0), ("B", "2025-01-01", 5.0), ("B", "2025-01-03", 5.0), ("B", "2025-01-05", 5.0)]
    df = spark.createDataFrame(data, "e string, d string, c double").withColumn("d", F.col("d").cast("date"))
    aligned = C.align_entities(df, ["e"], "d", "c", "cost")
    assert [(str(r.d), r.cost) for r in aligned.where("e = 'A'").orderBy("d").collect()] == [
        ("2025-01-02", 1.0), ("2025-01-03", 0.0), ("2025-01-04", 2.0),
    ]
    assert aligned.where("e = 'B'").count() == 5
    assert C.align_entities(df, ["e"], "d", "c", entity_filter={"e": "none"}).count() == 0


def test_shares_sum_to_one_and_zero_total_is_null(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('a', timestamp_ntz'2025-01-01 05:00', 1.0D), ('b', timestamp_ntz'2025-01-01 20:00', 3.0D), "
        "('a', timestamp_ntz'2025-01-03 00:00', 0.0D) AS t(e, t, v)"
    )
    got = {(r.e, r.time.day): r.metric_normalized for r in C.normalize_by_period(df, ["e"], "v", "t").collect()}
    assert got == {("a", 1): 0.25, ("b", 1): 0.75, ("a", 3): None}
    nearest = {(r.e, r.time.day) for r in C.normalize_by_period(df, ["e"], "v", "t", rounding="round").collect()}
    assert nearest == {("a", 1), ("b", 2), ("a", 3)}
    with pytest.raises(ValueError):
        C.normalize_by_period(df, ["e"], "v", "t", rounding="up")


def test_observation_counts_need_a_date(spark):
    with pytest.raises(ValueError):
        C.daily_observation_counts(spark.range(3))


def test_dependencies_and_their_reduction(spark):
    data = [("c1", "r1", "p1"), ("c2", "r1", "p1"), ("c3", "r2", "p1"), (None, "r2", "p1")]
    table = G.functional_dependencies(spark.createDataFrame(data, "city string, region string, planet string"), ["city", "region", "planet"])
    holds = {(r.determinant, r.dependent) for r in table.where("holds").collect()}
    assert holds == {("city", "region"), ("city", "planet"), ("region", "planet")}
    assert G.minimal_dependencies(table) == [("city", "region"), ("region", "planet")]


def test_grain_discovery_falls_back_to_the_most_stable(spark):
    data = [(f"2025-01-{d:02d}", "p", f"a{d}", 1.0) for d in range(1, 11)]
    frame = GrainFrame.from_dataframe(spark.createDataFrame(data, "date string, p string, a string, cost double"), ["p", "a"])
    best = {r.grain: r for r in G.grain_discovery(frame, min_days=5).collect()}
    assert best["p"].optimal and best["p"].stable_pct == 100.0 and best["a"].stable_pct == 0.0
    none = [r for r in G.grain_discovery(frame, min_days=50).collect() if r.optimal]
    assert len(none) == 1 and not none[0].viable
    assert G.grain_discovery(frame.with_df(frame.df.limit(0))).count() == 0


def test_pareto_curve_ends_at_one(spark, either_path):
    data = [("d", f"k{i}", float(i)) for i in range(1, 30)]
    frame = GrainFrame.from_dataframe(spark.createDataFrame(data, "date string, k string, cost double"), ["k"])
    curve = G.pareto_curve(frame, ["k"]).orderBy("rank").collect()
    assert curve[0].k == "k29" and curve[-1].cumulative_share == pytest.approx(1.0)
    assert [r["rank"] for r in curve] == list(range(1, 30))


# -- fleet and dataset contract -----------------------------------------------------


def test_unit_economics_tables_follow_the_tags(spark):
    df = spark.createDataFrame(
        [("r1", "t", 10.0, 10.0, 2.0, "x", "team_a"), ("r2", "t", 50.0, 50.0, 3.0, "x", None)],
        "resource_id string, timestamp string, cpu_utilization double, memory_utilization double, hourly_cost double, resource_type string, tag_team string",
    )
    tables = L.unit_economics(df)
    assert set(tables) == {"cost_per_team", "waste_analysis"}
    assert rows(tables["cost_per_team"].select("tag_team", "total_cost")) == [("team_a", 2.0), (None, 3.0)]
    assert rows(tables["waste_analysis"]) == [("x", 2.0, 1)]


def test_recommendations(spark):
    df = spark.createDataFrame(
        [("idle", 1.0, 1.0, 0.0, 80.0, 10.0, True), ("fine", 70.0, 80.0, 1.0, 0.0, 95.0, False)],
        "resource_id string, cpu_utilization double, memory_utilization double, hourly_cost double, waste_percentage double, efficiency_score double, is_idle boolean",
    )
    got = {r.resource_id: r for r in L.cost_optimization(df).collect()}
    assert got["idle"].recommendations == ["shutdown_when_idle", "rightsize_instance", "optimize_workload"]
    assert got["fine"].recommendations == [] and got["fine"].potential_savings == 0.0


def metrics_frame(spark, **changes):
    base = {"resource_id": "r", "timestamp": "2025-01-01", "cpu_utilization": 50.0, "memory_utilization": 50.0, "hourly_cost": 1.0}
    return spark.createDataFrame([tuple({**base, **changes}.values())], list({**base, **changes}))


def test_validation_names_the_bad_columns(spark):
    assert M.validate(metrics_frame(spark)) == (True, [])
    ok, errors = M.validate(metrics_frame(spark, cpu_utilization=150.0, hourly_cost=-5.0))
    assert not ok and len(errors) == 2 and "cpu_utilization" in errors[0] and "hourly_cost" in errors[1]
    assert not M.validate(metrics_frame(spark, cpu_utilization="high"))[0]
    assert "memory_utilization" in M.validate(metrics_frame(spark).drop("memory_utilization"))[1][0]
    assert M.quarantine(metrics_frame(spark, workload_type="odd"), with_labels=True).count() == 1


def test_normalise_defaults_and_requirements(spark):
    row = M.normalise(metrics_frame(spark)).first()
    assert (row.workload_type, row.cloud_provider, row.is_anomaly) == ("web_application", "AWS", False)
    with pytest.raises(ValueError, match="hourly_cost"):
        M.normalise(metrics_frame(spark).drop("hourly_cost"))


def test_csv_signal_keeps_line_order(spark, tmp_path, either_path):
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_text("".join(f"{part * 10 + i}.5,{i % 2}\n" for i in range(10)))
    got = read_labelled_signal(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [r.value for r in got] == [i + 0.5 for i in range(30)] and [r.timestamp for r in got] == list(range(30))


def test_partitioned_sink_prunes(spark, tmp_path):
    write_parquet(spark.range(20).withColumn("p", F.col("id") % 4), str(tmp_path / "t"), ["p"])
    plan = spark.read.parquet(str(tmp_path / "t")).where("p = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


# -- windows ------------------------------------------------------------------------


def hours(spark, n, resources=3):
    data = [(f"r{k}", t, float(t % 100), float(t), 1.0 * t if t % 7 else None, t % 10 == 0) for k in range(resources) for t in range(n)]
    return spark.createDataFrame(data, "resource_id string, timestamp int, cpu_utilization double, memory_utilization double, hourly_cost double, is_anomaly boolean")


def test_sequences_match_a_loop(spark, either_path):
    out = V.forecast_sequences(hours(spark, 50), length=10, stride=5).where("resource_id = 'r1'").orderBy("start_time").collect()
    value = [1.0 * t if t % 7 else None for t in range(50)]
    starts = list(range(0, 40, 5))
    assert [r.start_time for r in out] == starts
    assert [r.input_sequence for r in out] == [value[s : s + 10] for s in starts]
    assert [(r.target, r.end_time) for r in out] == [(value[s + 10], s + 9) for s in starts]


def test_too_short_series_give_no_windows(spark, either_path):
    assert V.forecast_sequences(hours(spark, 10), length=10, stride=1).count() == 0
    assert V.forecast_sequences(hours(spark, 11), length=10, stride=1).count() == 3
    assert V.sliding_windows(hours(spark, 11), 10, 1).columns == ["context", "target", "timestamp", "resource_id"]


def test_oversampling_reaches_the_rate(spark, either_path):
    windows = V.anomaly_windows(hours(spark, 60), window_size=5)
    sizes = {r.label: r["count"] for r in windows.groupBy("label").count().collect()}
    assert sizes == {0: 3 * 50, 1: 3 * 2}
    after = V.oversample_anomalies(windows, contamination=0.5)
    assert after.where("label = 1").count() == 75 and after.where("label = 0").count() == 150
    calm = V.anomaly_windows(hours(spark, 60).withColumn("is_anomaly", F.lit(False)), 5)
    assert V.oversample_anomalies(calm).count() == calm.count()


def test_chronological_split_sizes(spark, either_path):
    split = V.chronological_split(hours(spark, 100, 1), 0.2, 0.1)
    got = {r.split: (r.n, r.lo, r.hi) for r in split.groupBy("split").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).collect()}
    assert got == {"train": (70, 0, 69), "validation": (10, 70, 79), "test": (20, 80, 99)}


@pytest.mark.parametrize("n, m", [(100, 7), (10, 10), (5, 9), (1, 3), (50, 1), (97, 96)])
def test_evenly_spaced_matches_linspace(spark, either_path, n, m):
    picked = sorted(r.id for r in V.evenly_spaced_rows(spark.range(n), m, ["id"]).collect())
    want = sorted({k * (n - 1) // (m - 1) for k in range(m)}) if m > 1 else [0]
    assert picked == want
    with pytest.raises(NotImplementedError):
        V.evenly_spaced_rows(spark.range(3), 1, ["id"], "kmeans")
    with pytest.raises(ValueError):
        V.evenly_spaced_rows(spark.range(3), 1, ["id"], "other")


def test_nyquist_factor():
    assert [V.nyquist_factor(f) for f in (None, 0.5, 0.01, 0.0001)] == [30, 10, 25, 30]


def test_stratified_sample_is_proportional(spark, either_path):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 900, "big").otherwise("small"))
    got = {r.s: r["count"] for r in V.sample_rows(df, 100, ["id"], "s").groupBy("s").count().collect()}
    assert got == {"big": 90, "small": 10}
    assert V.sample_rows(df, 100, ["id"]).count() == 100


# -- distributions and anomalies ----------------------------------------------------


def test_ks_of_shifted_samples(spark, either_path):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 400), 2), np.round(rng.normal(0.5, 1, 300), 2)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "segment string, value double")
    got = {r.name: r for r in D.ks_tests(df, {"diff": ("a", "b"), "same": ("a", "a")}).collect()}
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs(np.mean(a <= x) - np.mean(b <= x)) for x in grid)
    assert got["diff"].ks_statistic == pytest.approx(want) and got["diff"].significant
    assert got["same"].ks_statistic == 0.0 and got["same"].p_value == 1.0 and not got["same"].significant


def test_kl_matches_histograms_and_is_asymmetric(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, 500), rng.normal(1, 2, 500)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "segment string, value double")
    got = {r.name: r.kl_divergence for r in D.kl_divergences(df, {"a vs b": ("a", "b")}, bins=20).collect()}
    edges = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 21)
    p, q = (np.histogram(x, edges)[0] / 500 + 1e-10 for x in (a, b))
    assert got["a vs b"] == pytest.approx(np.sum(p * np.log(p / q)))
    assert got["b ↔ a"] == pytest.approx(np.sum(q * np.log(q / p)))


def test_histogram_has_unit_area(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(100)] + [("one", 3.0)], "segment string, value double")
    area = {r.segment: r.s for r in D.density_histogram(df, 10).groupBy("segment").agg(F.sum("density").alias("s")).collect()}
    assert area["a"] * 9.9 == pytest.approx(1.0) and area["one"] * 0.1 == pytest.approx(1.0)


def test_outliers(spark, either_path):
    df = spark.createDataFrame([("a", float(v)) for v in range(20)] + [("a", 500.0), ("a", None), ("c", 1.0), ("c", 1.0)], "k string, v double")
    assert rows(A.outliers_iqr(df, "v", ["k"]).where("is_outlier")) == [("a", 500.0, True)]
    assert rows(A.outliers_zscore(df, "v", ["k"]).where("is_outlier")) == [("a", 500.0, True)]
    assert A.outliers_zscore(df, "v", ["k"]).count() == 24


def test_isolation_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(0, 1, (2000, 2)), [[9.0, -9.0], [-10.0, 8.0], [12.0, 12.0]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, x double, y double")
    scored = A.isolation_forest(df, ["x", "y"], ["id"], contamination=0.01, exact_cut=True)
    top = {r.id for r in scored.orderBy(F.desc("anomaly_score")).limit(3).collect()}
    assert top == {2000, 2001, 2002}
    assert scored.where("is_outlier").count() == pytest.approx(20, abs=2)
    again = A.isolation_forest(df.repartition(7), ["x", "y"], ["id"], contamination=0.01)
    assert rows(scored.select("id", F.round("anomaly_score", 9))) == rows(again.select("id", F.round("anomaly_score", 9)))


def test_quantile_functions():
    assert S.normal_quantile(0.975) == pytest.approx(1.959963985)
    for nu, want in ((4.0, 2.776445105), (1.0, 12.70620474), (30.0, 2.042272456)):
        assert S.student_t_quantile(0.975, nu) == pytest.approx(want, rel=1e-6)


def test_student_intervals_are_wider(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "y_pred double, std double")
    g, t = (df.transform(A.prediction_intervals(distribution=d)).first() for d in ("gaussian", "student_t"))
    assert t.upper_95 > g.upper_95 and g.upper_99 > g.upper_95 and g.lower_95 == -g.upper_95
    with pytest.raises(ValueError):
        A.prediction_intervals(distribution="cauchy")


def test_forecast_metrics_of_perfect_predictions(spark):
    df = spark.createDataFrame([("m", float(i), float(i), 1.0) for i in range(5)], "model string, y_true double, y_pred double, std double")
    m = A.forecast_metrics(df.transform(A.prediction_intervals())).first()
    assert (m.rmse, m.mae, m.r2, m.coverage_95) == (0.0, 0.0, 1.0, 1.0)


@pytest.mark.parametrize(
    "actual, flagged, want",
    [([1, 0], [1, 0], (1.0, 1.0, 1.0)), ([1, 0], [0, 0], (0.0, 0.0, 0.0)), ([1, 0], [1, 1], (0.5, 1.0, 2 / 3)), ([0, 0], [0, 0], (0, 0, 0))],
)
def test_anomaly_metrics(spark, actual, flagged, want):
    df = spark.createDataFrame([("m", a, f) for a, f in zip(actual, flagged)], "model string, y int, f int")
    got = A.anomaly_metrics(df, "y", ["f"]).first()
    assert (got.precision, got.recall, got.f1) == pytest.approx(want)


def test_auc_matches_rank_form(spark, either_path):
    rng = np.random.default_rng(8)
    score, label = rng.integers(0, 20, 200), rng.random(200) < 0.4
    df = spark.createDataFrame([("m", float(s), bool(y)) for s, y in zip(score, label)], "model string, s double, y boolean")
    pos, neg = score[label], score[~label]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert A.roc_auc(df, "s", "y").first().auc == pytest.approx(want)


# -- forecasts ----------------------------------------------------------------------


def test_seasonal_naive_is_exact_on_a_cycle(spark, either_path):
    df = spark.createDataFrame([("s", t, float(t % 4)) for t in range(40)], "k string, t int, v double")
    table = {r.model: r for r in FC.compare_baselines(df, ["k"], ["t"], "v", 8, periods=[3, 4], windows=[2]).collect()}
    assert table["seasonal_naive_4"].mae == 0.0 and table["seasonal_naive_4"].best
    assert table["naive"].mase > 0 and set(table) == {"naive", "seasonal_naive_3", "seasonal_naive_4", "moving_average_2"}
    best = FC.best_period(FC.compare_baselines(df, ["k"], ["t"], "v", 8, periods=[3, 4])).first()
    assert best.best_period == 4


def test_backtest_needs_room_for_the_horizon(spark):
    df = spark.createDataFrame([("s", t, float(t)) for t in range(20)], "k string, t int, v double")
    with pytest.raises(ValueError):
        FC.backtest(df, ["k"], ["t"], "v", 5, [3])
    got = {(r.cutoff, r.model): r.mae for r in FC.backtest(df, ["k"], ["t"], "v", 2, [2, 4], window=2).collect()}
    assert got[(2, "naive")] == pytest.approx(1.5) and got[(4, "moving_average")] == pytest.approx(2.0)


def test_density_by_reach_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    values = {"a": [*rng.normal(0, 1, 300), 40.0], "b": list(rng.uniform(90, 100, 50)), "same": [5.0] * 4, "one": [7.0]}
    data = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    got = {(r.segment, r.point): (r.x, r.pdf) for r in D.gaussian_kde(spark.createDataFrame(data, "segment string, value double"), 80).collect()}
    grid = np.linspace(min(min(v) for v in values.values()), max(max(v) for v in values.values()), 80)
    assert set(got) == {(k, i) for k in "ab" for i in range(80)}
    for k in "ab":
        v = np.array(values[k])
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert [got[k, i][0] for i in range(80)] == pytest.approx(list(grid))
        assert [got[k, i][1] for i in range(80)] == pytest.approx(list(want), rel=1e-9, abs=1e-17)
    assert min(pdf for _, pdf in got.values()) == 0



def test_binned_density_is_close_to_the_exact_one(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([("a", float(v)) for v in rng.normal(size=400)], "segment string, value double")
    exact = {r.point: r.pdf for r in D.gaussian_kde(df, 50).collect()}
    binned = {r.point: r.pdf for r in D.gaussian_kde(df, 50, bins=500).collect()}
    assert max(abs(exact[p] - binned[p]) for p in range(50)) < 0.01


def test_measured_join_broadcasts_only_small_sides(spark):
    from grainwise.plans.scratch import join_measured

    facts = spark.range(1000).withColumn("k", F.col("id") % 10)
    per_key = facts.groupBy("k").agg(F.count("*").alias("n"))
    plans = {}
    for limit in ("500000", "3"):
        spark.conf.set("spark.grainwise.broadcastRows", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = join_measured(facts, per_key, ["k"])
        plans[limit] = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("n = 100").count() == 1000
    spark.conf.unset("spark.grainwise.broadcastRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans["500000"] and "BroadcastHashJoin" not in plans["3"]


@pytest.mark.parametrize("length,stride,beyond", [(5, 1, 0), (7, 3, 1), (30, 4, 2), (64, 64, 0)])
def test_windows_are_slices_across_blocks(spark, monkeypatch, either_path, length, stride, beyond):
    monkeypatch.setattr(V, "WINDOW_BLOCK", 16)
    data = [(k, i, None if i % 9 == 4 else float(i)) for k, n in (("a", 150), ("b", 33), (None, 64), ("c", 4)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, t int, v double").repartition(4)
    got = {(r.k, r["__at"]): [(x.t, x.v) for x in r["__window"]] for r in V._cut_windows(df, ["k"], ["t"], length, stride, beyond).collect()}
    series = {}
    for k, t, v in data:
        series.setdefault(k, []).append((t, v))
    assert got == {(k, s): own[s : s + length + beyond] for k, own in series.items() for s in range(0, len(own) - length - beyond + 1, stride)}


def test_training_set_has_exact_shares(spark):
    made = V.anomaly_training_set(hours(spark, 60), 5, 0.5).select("shuffled_at", "split", "resource_id", "label", "window", "replica").collect()
    n = len(made)
    assert sorted(r.shuffled_at for r in made) == list(range(n)) and {r.shuffled_at for r in made if r.split == "train"} == set(range(int(n * 0.8)))
    assert len({(r.resource_id, r.label, r.window, r.replica) for r in made}) == n


def test_backtest_with_seasons_by_hand(spark):
    df = spark.createDataFrame([("a", i, float(i % 3) + i // 12) for i in range(24)] + [("b", i, float(i)) for i in range(7)], "k string, t int, v double")
    got = {(r.cutoff, r.model): r for r in FC.backtest(df, ["k"], ["t"], "v", 6, [6, 12], window=2, periods=[3]).collect()}
    assert got[12, "seasonal_naive_3"].mae == pytest.approx(1.0)
    steps = [abs((i % 3 + i // 12) - ((i - 1) % 3 + (i - 1) // 12)) for i in range(1, 12)]
    assert got[12, "seasonal_naive_3"].mase == pytest.approx(1.0 / (sum(steps) / len(steps)))
    assert got[6, "seasonal_naive_3"].mae == pytest.approx(0.0) and got[6, "naive"].mae > 0


def test_dependency_edges_equal_the_list(spark):
    pairs = [("id", "city"), ("id", "land"), ("city", "land"), ("id", "code"), ("code", "id"), ("code", "city"), ("code", "land"), ("x", "y"), ("y", "x")]
    table = spark.createDataFrame([(a, b, True) for a, b in pairs] + [("land", "id", False)], "determinant string, dependent string, holds boolean")
    assert sorted(tuple(r) for r in G.dependency_edges(table).collect()) == G.minimal_dependencies(table)
