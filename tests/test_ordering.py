"""The ordered primitives against brute force, on both of their paths."""

from __future__ import annotations

import random

import numpy as np
import pytest
from support import rows
from pyspark.sql import functions as F

from grainwise.plans import ordering as O
from grainwise.plans import ranks as R


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows belong to one key; ties, NULL keys and unsorted input."""
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        data.append((key, rng.randrange(500), i, float(rng.randrange(50))))
    rng.shuffle(data)
    return data


@pytest.fixture
def table(spark, skewed):
    return spark.createDataFrame(skewed, "k string, t int, id int, v double").repartition(5)


def by_key(data):
    out = {}
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


def test_positions_and_lengths(table, skewed, either_path):
    placed = O.with_position(table, ["k"], ["t", "id"], length="n")
    got = {r.id: (r.pos, r.n) for r in placed.collect()}
    want = {r[2]: (i, len(rs)) for rs in by_key(skewed).values() for i, r in enumerate(rs)}
    assert got == want


def test_global_position(table, skewed, either_path):
    got = {r.id: r.pos for r in O.with_position(table, [], ["t", "id"]).collect()}
    assert got == {r[2]: i for i, r in enumerate(sorted(skewed, key=lambda r: (r[1], r[2])))}


def test_prefix_sums(table, skewed, either_path):
    summed = O.prefix_sums(table, ["k"], ["t", "id"], {"upto": "v"}, {"whole": "v"})
    got = {r.id: (r.upto, r.whole) for r in summed.collect()}
    want = {}
    for rs in by_key(skewed).values():
        total = np.cumsum([r[3] for r in rs])
        want |= {r[2]: (total[i], total[-1]) for i, r in enumerate(rs)}
    assert got == want


@pytest.mark.parametrize("size", [16, 65536])
def test_windows_with_halo(table, skewed, either_path, size):
    def columns(spec):
        return {
            "before": F.lag("v", 3).over(spec),
            "moving": F.sum("v").over(spec.rowsBetween(-10, 9)),
            "after": F.lead("v", 2).over(spec),
        }

    out = O.ordered_windows(table, ["k"], ["t", "id"], columns, before=10, after=9, size=size)
    got = {r.id: (r.before, r.moving, r.after) for r in out.collect()}
    assert len(got) == len(skewed) and out.columns == ["k", "t", "id", "v", "before", "moving", "after"]
    for rs in by_key(skewed).values():
        v = [r[3] for r in rs]
        for i, r in enumerate(rs):
            want = (v[i - 3] if i >= 3 else None, sum(v[max(0, i - 10) : i + 10]), v[i + 2] if i + 2 < len(v) else None)
            assert got[r[2]] == want


def test_percentiles_match_numpy(table, skewed, either_path):
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = {r.k: r for r in O.exact_percentiles(table, ["k"], "v", probs, distinct="d").collect()}
    for key, rs in by_key(skewed).items():
        v = np.array([r[3] for r in rs])
        for name, p in probs.items():
            assert found[key][name] == pytest.approx(np.percentile(v, p * 100))
        assert found[key].d == len(set(v))


def test_percentiles_of_nothing(spark, either_path):
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    assert O.exact_percentiles(empty, ["k"], "v", {"m": 0.5}).count() == 0


def test_hot_key_is_spread_over_partitions(spark, table):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    laid = O._laid_out(table, ["k"], ["t", "id"])
    parts = laid.where("k = 'hot'").select("__part").distinct().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 3


def test_blocks_reject_a_halo_beyond_their_size(table):
    with pytest.raises(ValueError):
        O.with_blocks(table.withColumn("pos", F.lit(0)), before=10, after=0, size=5)


def test_pieces_arrive_whole(spark, table, skewed):
    blocks = O.with_blocks(O.with_position(table, ["k"], ["t", "id"]), before=2, after=0, size=64)

    def describe(piece):
        assert (np.diff(piece["pos"]) == 1).all()
        return {"own": [int(piece["__home"].sum())], "all": [len(piece)]}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    out = O.map_pieces(blocks.select("k", "pos", "__block", "__home"), ["k"], describe, "own int, all int")
    totals = out.groupBy("k").agg(F.sum("own").alias("own"), F.max("all").alias("largest")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.k: r.own for r in totals} == {k: len(rs) for k, rs in by_key(skewed).items()}
    assert max(r.largest for r in totals) == 66


def test_hash_order_is_repeatable(table):
    once = rows(table.select("id", O.hash_order(["id"], 1).alias("h")))
    assert once == rows(table.select("id", O.hash_order(["id"], 1).alias("h")))
    assert once != rows(table.select("id", O.hash_order(["id"], 2).alias("h")))


@pytest.fixture(scope="module")
def long_groups(spark):
    rng = np.random.RandomState(3)
    n = 40_000
    v = np.where(rng.rand(n) < 0.3, rng.randint(0, 5, n), rng.lognormal(3, 2, n))
    rows = [("hot" if i < 30_000 else ["mid", "low", None][i % 3] if i < n - 50 else "tiny", float(x), int(x * 100)) for i, x in enumerate(v)]
    rows += [("hot", float("inf"), 2**60), ("hot", float("-inf"), -(2**60)), ("hot", float("nan"), 0), ("hot", None, None)]
    return rows, spark.createDataFrame(rows, "k string, v double, w bigint").repartition(6)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("value", ["v", "w"])
def test_sketched_ranks_are_exact(spark, long_groups, either_path, keys, value):
    rows, df = long_groups
    probs = {f"p{i}": p for i, p in enumerate([0.0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0])}
    spark.conf.set("spark.grainwise.sketchRows", "9000")
    try:
        found = {r["k"] if keys else 0: r for r in O.exact_percentiles(df, keys, value, probs, distinct="d").collect()}
    finally:
        spark.conf.unset("spark.grainwise.sketchRows")
    at = 1 if value == "v" else 2
    groups = {}
    for r in rows:
        if r[at] is not None and r[at] == r[at]:
            groups.setdefault(r[0] if keys else 0, []).append(r[at])
    assert set(found) == set(groups)
    for key, own in groups.items():
        own = sorted(map(float, own))
        for name, p in probs.items():
            a = own[int(np.floor((len(own) - 1) * p))]
            b = own[int(np.ceil((len(own) - 1) * p))]
            want = a if a == b else a + ((len(own) - 1) * p) % 1 * (b - a)
            assert found[key][name] == pytest.approx(want) or (np.isinf(a) or np.isinf(b))
        assert found[key].d == len(set(own))


def test_few_values_leave_the_scan_of_sketched_ranks(spark):
    df = spark.range(400_000).selectExpr("cast(hash(id) as double) as v")
    counted = R.sketched_counts(df, [], "v", [0.25, 0.5, 0.75])
    assert counted.count() < 400_000 * 3 * 2.5 * R.REACH + 20 and counted.agg({"__c": "sum"}).first()[0] == 400_000
    assert R.missed(spark.createDataFrame([(1.0, None)], "a double, b double"), ["a", "b"])


def test_ranks_outside_their_brackets_are_found_by_merging(spark, long_groups, monkeypatch):
    _, df = long_groups
    want = O.exact_percentiles(df, ["k"], "w", {"m": 0.5}).collect()
    spark.conf.set("spark.grainwise.sketchRows", "9000")
    monkeypatch.setattr(O, "missed", lambda picked, names: True)
    try:
        assert sorted(map(str, O.exact_percentiles(df, ["k"], "w", {"m": 0.5}).collect())) == sorted(map(str, want))
    finally:
        spark.conf.unset("spark.grainwise.sketchRows")


@pytest.mark.parametrize("n", [0, 5, 700, 1999, 2600, 9999])
def test_large_picks_equal_small_ones(spark, monkeypatch, n):
    df = spark.range(2000).selectExpr("id % 1500 as a", "if(id < 600, 7, id) as b").unionAll(spark.range(500).selectExpr("9 as a", "9 as b")).repartition(5)
    want = rows(df.orderBy(O.hash_order(["a", "b"], 3), "a", "b").limit(n))
    monkeypatch.setattr(O, "TOP_ROWS", 4)
    monkeypatch.setattr(O, "CELL_DIGITS", 1)
    assert rows(O.pick_by_hash(df, ["a", "b"], n, 3)) == want
