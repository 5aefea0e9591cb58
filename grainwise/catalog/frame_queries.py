"""Hierarchical frame: filters, roll-ups, summaries and the tables behind cost figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.catalog.registry import query, r, rounded
from grainwise.operators import grain as G
from grainwise.sources.views import BILLING_SQL, billing_frame, table

WITH = f"WITH {BILLING_SQL}"
SUMMARY = f"""{r('sum(cost)', 'total_cost', 2)}, {r('avg(cost)', 'mean_cost', 4)},
  {r('quantile_disc(cost, 0.5)', 'median_cost', 2)}, {r('stddev_samp(cost)', 'std_cost', 4)},
  {r('min(cost)', 'min_cost', 2)}, {r('max(cost)', 'max_cost', 2)}, count(cost) AS days"""
TOP5 = """top5 AS (SELECT r_name, n_name FROM billing GROUP BY r_name, n_name
  ORDER BY sum(cost) DESC, r_name, n_name LIMIT 5)"""


@query(
    "cost_summary_by_grain",
    f"""{WITH}, daily AS (SELECT r_name, n_name, date, sum(cost) AS cost FROM billing
        WHERE date >= DATE '1996-01-01' AND date < DATE '2000-01-01' GROUP BY ALL)
    SELECT r_name, n_name, {SUMMARY} FROM daily GROUP BY r_name, n_name""",
)
def cost_summary_by_grain(spark, sf_dir):
    frame = billing_frame(spark, sf_dir).filter_time(start="1996-01-01", end="2000-01-01")
    return rounded(frame.cost_summary_by_grain(["r_name", "n_name"]), 2, mean_cost=4, std_cost=4)


@query(
    "cost_summary_exact_median",
    f"""{WITH}, daily AS (SELECT c_mktsegment, date, sum(cost) AS cost FROM billing GROUP BY ALL)
    SELECT c_mktsegment, {SUMMARY.replace('quantile_disc', 'quantile_cont')} FROM daily GROUP BY c_mktsegment""",
)
def cost_summary_exact_median(spark, sf_dir):
    table = billing_frame(spark, sf_dir).cost_summary_by_grain(["c_mktsegment"], "volatility", exact=True)
    return rounded(table, 2, mean_cost=4, std_cost=4)


@query(
    "entity_filter",
    f"""{WITH} SELECT date, r_name, n_name, c_mktsegment, o_orderpriority, cost FROM billing
    WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING'""",
)
def entity_filter(spark, sf_dir):
    return billing_frame(spark, sf_dir).filter(r_name="ASIA", c_mktsegment="BUILDING").df


@query(
    "time_range_filter",
    f"""{WITH} SELECT date, n_name, cost FROM billing
    WHERE date >= DATE '1997-03-01' AND date < DATE '1997-06-01'""",
)
def time_range_filter(spark, sf_dir):
    frame = billing_frame(spark, sf_dir)
    return frame.filter_time(after="1997-03-01", before="1997-06-01").df.select("date", "n_name", "cost")


@query(
    "split_at_date",
    f"""{WITH} SELECT CASE WHEN date < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS part,
    count(*) AS n, {r('sum(cost)', 'cost', 2)} FROM billing GROUP BY 1""",
)
def split_at_date(spark, sf_dir):
    pre, post = billing_frame(spark, sf_dir).split_at("1998-01-01")
    parts = pre.df.withColumn("part", F.lit("pre")).unionByName(post.df.withColumn("part", F.lit("post")))
    return rounded(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")), 2)


@query(
    "with_df_keeps_metadata",
    f"""{WITH} SELECT r_name, count(cost) AS count, {r('avg(cost)', 'mean', 4)},
    {r('stddev_samp(cost)', 'std', 4)}, {r('min(cost)', 'min', 2)}, {r('max(cost)', 'max', 2)}
    FROM (SELECT r_name, date, sum(cost) AS cost FROM billing WHERE cost > 100000 GROUP BY ALL) GROUP BY r_name""",
)
def with_df_keeps_metadata(spark, sf_dir):
    frame = billing_frame(spark, sf_dir)
    large = frame.with_df(frame.df.where("cost > 100000"))
    return rounded(large.summary_stats(["r_name"]), 4, min=2, max=2)


@query(
    "entity_sample",
    f"""{WITH}, picked AS (SELECT DISTINCT r_name, n_name FROM billing
      ORDER BY md5(concat_ws('|', r_name, n_name, '42')), r_name, n_name LIMIT 6)
    SELECT n_name, count(*) AS n, {r('sum(cost)', 'cost', 2)}
    FROM billing SEMI JOIN picked USING (r_name, n_name) GROUP BY n_name""",
)
def entity_sample(spark, sf_dir):
    sampled = billing_frame(spark, sf_dir).sample(["r_name", "n_name"], n=6, seed=42)
    return rounded(sampled.df.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")), 2)


@query(
    "top_entity_restriction",
    f"""{WITH}, {TOP5} SELECT date, r_name, n_name, cost FROM billing SEMI JOIN top5 USING (r_name, n_name)""",
)
def top_entity_restriction(spark, sf_dir):
    frame = billing_frame(spark, sf_dir)
    return frame.restrict_to(frame.top_entities(["r_name", "n_name"], 5)).df.select("date", "r_name", "n_name", "cost")


@query(
    "grain_roll_up",
    f"{WITH} SELECT r_name, c_mktsegment, date, {r('sum(cost)', 'cost', 2)} FROM billing GROUP BY ALL",
)
def grain_roll_up(spark, sf_dir):
    return rounded(billing_frame(spark, sf_dir).aggregate(["c_mktsegment", "r_name"]).df, 2)


@query(
    "multi_grain_roll_up",
    f"""{WITH} SELECT CASE WHEN grouping(n_name) = 0 THEN 'r_name > n_name'
      WHEN grouping(c_mktsegment) = 0 THEN 'c_mktsegment' ELSE 'r_name' END AS grain,
      r_name, n_name, c_mktsegment, date, {r('sum(cost)', 'cost', 2)} FROM billing
    GROUP BY GROUPING SETS ((r_name, date), (r_name, n_name, date), (c_mktsegment, date))""",
)
def multi_grain_roll_up(spark, sf_dir):
    frame = billing_frame(spark, sf_dir)
    return rounded(frame.aggregate_many([["r_name"], ["r_name", "n_name"], ["c_mktsegment"]]), 2)


@query(
    "entity_summary_stats",
    f"""{WITH} SELECT n_name, o_orderpriority, count(cost) AS count, {r('avg(cost)', 'mean', 4)},
    {r('stddev_samp(cost)', 'std', 4)}, {r('min(cost)', 'min', 2)}, {r('max(cost)', 'max', 2)}
    FROM (SELECT n_name, o_orderpriority, date, sum(cost) AS cost FROM billing GROUP BY ALL)
    GROUP BY n_name, o_orderpriority""",
)
def entity_summary_stats(spark, sf_dir):
    return rounded(billing_frame(spark, sf_dir).summary_stats(["n_name", "o_orderpriority"]), 4, min=2, max=2)


@query(
    "daily_box_stats",
    f"""{WITH}, daily AS (SELECT c_mktsegment, o_orderpriority, date, sum(cost) AS cost FROM billing GROUP BY ALL),
    top AS (SELECT c_mktsegment, o_orderpriority FROM daily GROUP BY ALL
      ORDER BY sum(cost) DESC, c_mktsegment, o_orderpriority LIMIT 8),
    kept AS (SELECT * FROM daily SEMI JOIN top USING (c_mktsegment, o_orderpriority) WHERE cost >= 50000),
    q AS (SELECT c_mktsegment, o_orderpriority, quantile_cont(cost, 0.25) AS q1, quantile_cont(cost, 0.5) AS m,
      quantile_cont(cost, 0.75) AS q3 FROM kept GROUP BY ALL)
    SELECT c_mktsegment, o_orderpriority, {r('any_value(q1)', 'q1', 4)}, {r('any_value(m)', 'median', 4)},
      {r('any_value(q3)', 'q3', 4)},
      {r('min(CASE WHEN cost BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN cost END)', 'whisker_low', 2)},
      {r('max(CASE WHEN cost BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN cost END)', 'whisker_high', 2)},
      count(CASE WHEN NOT cost BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers,
      count(cost) AS days
    FROM kept JOIN q USING (c_mktsegment, o_orderpriority) GROUP BY c_mktsegment, o_orderpriority""",
)
def daily_box_stats(spark, sf_dir):
    frame = billing_frame(spark, sf_dir)
    table = frame.daily_box_stats(["c_mktsegment", "o_orderpriority"], top_n=8, min_cost=50000.0)
    return rounded(table, 4, whisker_low=2, whisker_high=2)


@query(
    "cost_trend_lines",
    f"""{WITH}, {TOP5}
    SELECT r_name, n_name, date, {r('sum(cost)', 'cost', 2)}, false AS is_total
    FROM billing SEMI JOIN top5 USING (r_name, n_name) GROUP BY r_name, n_name, date
    UNION ALL SELECT NULL, NULL, date, {r('sum(cost)', 'cost', 2)}, true FROM billing GROUP BY date""",
)
def cost_trend_lines(spark, sf_dir):
    return rounded(billing_frame(spark, sf_dir).cost_trends(["r_name", "n_name"], top_n=5), 2)


@query(
    "cost_treemap",
    f"""{WITH}, leaves AS (SELECT r_name, n_name, c_mktsegment, sum(cost) AS leaf FROM billing GROUP BY ALL
      ORDER BY leaf DESC, r_name, n_name, c_mktsegment LIMIT 40),
    nodes AS (SELECT r_name, n_name, c_mktsegment, sum(leaf) AS total,
      3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS depth
      FROM leaves GROUP BY ROLLUP (r_name, n_name, c_mktsegment))
    SELECT r_name, n_name, c_mktsegment, {r('total', 'total_cost', 2)}, CAST(depth AS INTEGER) AS depth,
      {r('''total / sum(total) OVER (PARTITION BY depth, CASE WHEN depth > 1 THEN r_name END,
          CASE WHEN depth > 2 THEN n_name END) * 100''', 'pct_of_parent', 6)} FROM nodes""",
)
def cost_treemap(spark, sf_dir):
    return rounded(billing_frame(spark, sf_dir).treemap(["r_name", "n_name", "c_mktsegment"], 40), 6, total_cost=2)


@query(
    "density_by_grain",
    f"""{WITH}, active AS (
      SELECT DISTINCT 'region' AS grain, date, r_name AS a, '' AS b FROM billing
      UNION SELECT DISTINCT 'nation', date, r_name, n_name FROM billing
      UNION SELECT DISTINCT 'segment', date, c_mktsegment, '' FROM billing),
    counts AS (SELECT grain, date, count(*) AS entities FROM active GROUP BY ALL)
    SELECT grain, date, entities, {r('''(entities - lag(entities) OVER w) * 1.0 /
      nullif(lag(entities) OVER w, 0)''', 'change')} FROM counts WINDOW w AS (PARTITION BY grain ORDER BY date)""",
)
def density_by_grain(spark, sf_dir):
    grains = {"region": ["r_name"], "nation": ["r_name", "n_name"], "segment": ["c_mktsegment"]}
    return rounded(billing_frame(spark, sf_dir).density_by_grain(grains))


# -- grain discovery ----------------------------------------------------------------

CANDIDATES = {
    "region": ["r_name"],
    "nation": ["r_name", "n_name"],
    "nation+segment": ["r_name", "n_name", "c_mktsegment"],
    "nation+segment+priority": ["r_name", "n_name", "c_mktsegment", "o_orderpriority"],
}


def _persistence_sql(min_days: int) -> str:
    parts = [
        f"SELECT '{name}' AS grain, count(DISTINCT date) AS d FROM billing GROUP BY {', '.join(cols)}"
        for name, cols in CANDIDATES.items()
    ]
    return f"""e AS ({' UNION ALL '.join(parts)}),
    p AS (SELECT grain, count(*) AS entities, count(*) FILTER (d >= {min_days}) AS stable_count,
      round(100.0 * count(*) FILTER (d >= {min_days}) / count(*), 1) AS stable_pct,
      quantile_disc(d, 0.5) AS median_days, round(avg(d), 1) AS mean_days FROM e GROUP BY grain)"""


@query("grain_persistence", f"{WITH}, {_persistence_sql(30)} SELECT * FROM p")
def grain_persistence(spark, sf_dir):
    return G.grain_persistence_stats(billing_frame(spark, sf_dir), CANDIDATES, min_days=30)


@query(
    "grain_discovery",
    f"""{WITH}, {_persistence_sql(300)}, v AS (SELECT *, stable_pct >= 70.0 AS viable FROM p)
    SELECT *, CAST(rk AS INTEGER) AS rank, rk = 1 AS optimal FROM (SELECT *, row_number() OVER (
      ORDER BY viable DESC, CASE WHEN viable THEN entities ELSE stable_pct END DESC, grain) AS rk FROM v)
    """.replace("SELECT *, CAST", "SELECT * EXCLUDE (rk), CAST"),
)
def grain_discovery(spark, sf_dir):
    return G.grain_discovery(billing_frame(spark, sf_dir), CANDIDATES, min_days=300)


@query(
    "top_cost_drivers",
    f"""{WITH} SELECT n_name, c_mktsegment, count(DISTINCT date) AS days_present,
      {r('sum(cost)', 'total_cost', 2)}, {r('sum(cost) / (SELECT sum(cost) FROM billing)', 'cost_share')}
    FROM billing GROUP BY n_name, c_mktsegment HAVING count(DISTINCT date) >= 30
    ORDER BY sum(cost) DESC, n_name, c_mktsegment LIMIT 10""",
)
def top_cost_drivers(spark, sf_dir):
    table = G.top_cost_drivers(billing_frame(spark, sf_dir), ["n_name", "c_mktsegment"], min_days=30, top_n=10)
    return rounded(table, 6, total_cost=2)


@query(
    "pareto_curve",
    f"""{WITH}, t AS (SELECT n_name, c_mktsegment, o_orderpriority, sum(cost) AS c FROM billing GROUP BY ALL)
    SELECT n_name, c_mktsegment, o_orderpriority, {r('c', 'total_cost', 2)},
      CAST(row_number() OVER w AS BIGINT) AS rank,
      {r('row_number() OVER w * 1.0 / count(*) OVER ()', 'entity_share')},
      {r('sum(c) OVER w / sum(c) OVER ()', 'cumulative_share')}
    FROM t WINDOW w AS (ORDER BY c DESC, n_name, c_mktsegment, o_orderpriority
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def pareto_curve(spark, sf_dir):
    table = G.pareto_curve(billing_frame(spark, sf_dir), ["n_name", "c_mktsegment", "o_orderpriority"])
    return rounded(table, 6, total_cost=2)


@query(
    "compound_key_analysis",
    f"""{WITH}, k AS (SELECT 'r_name' AS key, count(*) AS c FROM billing GROUP BY r_name
      UNION ALL SELECT 'r_name > n_name', count(*) FROM billing GROUP BY r_name, n_name
      UNION ALL SELECT 'r_name > n_name > c_mktsegment', count(*) FROM billing GROUP BY r_name, n_name, c_mktsegment
      UNION ALL SELECT 'r_name > n_name > c_mktsegment > o_orderpriority', count(*) FROM billing
        GROUP BY r_name, n_name, c_mktsegment, o_orderpriority)
    SELECT key, count(*) AS unique_entities, {r('avg(c)', 'mean_records_per_entity')} FROM k GROUP BY key""",
)
def compound_key_analysis(spark, sf_dir):
    return rounded(G.compound_key_analysis(billing_frame(spark, sf_dir)))


FD_COLUMNS = ["r_name", "n_name", "c_mktsegment", "o_orderpriority"]


@query(
    "functional_dependencies",
    f"{WITH} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS determinant, '{b}' AS dependent, count(DISTINCT {a}) AS distinct_determinant,
        count(DISTINCT {a} || '|' || {b}) AS distinct_pairs,
        count(DISTINCT {a}) = count(DISTINCT {a} || '|' || {b}) AS holds FROM billing"""
        for a in FD_COLUMNS
        for b in FD_COLUMNS
        if a != b
    ),
)
def functional_dependencies(spark, sf_dir):
    return G.functional_dependencies(billing_frame(spark, sf_dir).df, FD_COLUMNS)


CHAIN = ["c_custkey", "c_name", "n_name", "r_name"]
CHAIN_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b FROM chain HAVING count(DISTINCT {a}::VARCHAR) = count(DISTINCT {a}::VARCHAR || '|' || {b}::VARCHAR)"
    for a in CHAIN
    for b in CHAIN
    if a != b
)


@query(
    "dependency_edges",
    f"""WITH RECURSIVE chain AS (SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey),
    e AS ({CHAIN_SQL}),
    walk(a, b, len) AS (SELECT a, b, 1 FROM e WHERE (b, a) NOT IN (SELECT a, b FROM e)
      UNION SELECT w.a, e.b, len + 1 FROM walk w JOIN e ON w.b = e.a WHERE (e.b, e.a) NOT IN (SELECT a, b FROM e) AND len < 9)
    SELECT a AS determinant, b AS dependent FROM e WHERE (a, b) NOT IN (SELECT a, b FROM walk WHERE len > 1)""",
)
def dependency_edges(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return G.dependency_edges(G.functional_dependencies(customers.select(*CHAIN), CHAIN))
