"""Comparisons of value distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.catalog.registry import query, r, rounded
from grainwise.operators import distribution as D
from grainwise.sources.views import table

SEGMENTS = """seg AS (
  SELECT 'error' AS segment, value FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'normal', value FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'early', value FROM events WHERE ts < TIMESTAMP '2024-01-16'
  UNION ALL SELECT 'late', value FROM events WHERE ts >= TIMESTAMP '2024-01-16')"""
PAIRS = {"error vs normal": ("error", "normal"), "early vs late": ("early", "late"), "drift": ("error", "late")}
PAIRS_SQL = "pairs(name, l, r) AS (VALUES " + ", ".join(f"('{n}', '{a}', '{b}')" for n, (a, b) in PAIRS.items()) + ")"
W = f"WITH {SEGMENTS}, {PAIRS_SQL}"


def segments(spark, sf_dir):
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    conditions = {
        "error": F.col("event_type") == "error",
        "normal": F.col("event_type") != "error",
        "early": F.col("ts") < cut,
        "late": F.col("ts") >= cut,
    }
    return D.with_segments(table(spark, sf_dir, "events"), conditions)


KS = """m AS (SELECT name, value, count(*) FILTER (segment = l) AS a, count(*) FILTER (segment = r) AS b
    FROM seg JOIN pairs ON segment = l OR segment = r GROUP BY name, value),
  c AS (SELECT name, sum(a) OVER w * 1.0 / sum(a) OVER p AS fa, sum(b) OVER w * 1.0 / sum(b) OVER p AS fb,
    sum(a) OVER p AS n1, sum(b) OVER p AS n2 FROM m
    WINDOW w AS (PARTITION BY name ORDER BY value), p AS (PARTITION BY name)),
  k AS (SELECT name, max(abs(fa - fb)) AS d, CAST(max(n1) AS DOUBLE) AS n1, CAST(max(n2) AS DOUBLE) AS n2
    FROM c GROUP BY name),
  x AS (SELECT *, d * sqrt(n1 * n2 / (n1 + n2)) AS x FROM k),
  t AS (SELECT name, d, CASE WHEN any_value(x.x) < 0.3 THEN 1.0 ELSE least(greatest(2 * sum(
      CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * x.x * x.x)), 0), 1) END AS p
    FROM x, range(1, 101) g(j) GROUP BY name, d)"""


@query(
    "ks_tests",
    f"""{W}, {KS} SELECT name, {r('d', 'ks_statistic')}, {r('p', 'p_value')}, p < 0.05 AS significant,
    CASE WHEN p < 0.05 THEN 'Different distributions' ELSE 'Similar distributions' END AS interpretation FROM t""",
)
def ks_tests(spark, sf_dir):
    return rounded(D.ks_tests(segments(spark, sf_dir), PAIRS))


KL = """b AS (SELECT name, segment, l, r, value, min(value) OVER (PARTITION BY name) AS lo,
    max(value) OVER (PARTITION BY name) AS hi FROM seg JOIN pairs ON segment = l OR segment = r),
  h AS (SELECT name, least(floor((value - lo) / (hi - lo) * 100), 99) AS bin, count(*) FILTER (segment = l) AS a,
    count(*) FILTER (segment = r) AS b FROM b GROUP BY ALL),
  q AS (SELECT name, a / sum(a) OVER (PARTITION BY name) + 1e-10 AS p, b / sum(b) OVER (PARTITION BY name) + 1e-10 AS q
    FROM h),
  d AS (SELECT name, sum(p * ln(p / q)) AS f, sum(q * ln(q / p)) AS g FROM q GROUP BY name),
  kl AS (SELECT name, f AS v FROM d UNION ALL SELECT CASE WHEN contains(name, ' vs ')
    THEN split_part(name, ' vs ', 2) || ' ↔ ' || split_part(name, ' vs ', 1) ELSE name || ' (reversed)' END, g FROM d)"""


@query(
    "kl_divergences",
    f"""{W}, {KL} SELECT name, {r('v', 'kl_divergence')}, CASE WHEN v > 1 THEN 'Very different'
    WHEN v > 0.1 THEN 'Moderately different' ELSE 'Similar' END AS interpretation FROM kl""",
)
def kl_divergences(spark, sf_dir):
    return rounded(D.kl_divergences(segments(spark, sf_dir), PAIRS))


@query(
    "empirical_cdf",
    f"""WITH {SEGMENTS}, c AS (SELECT segment, value, count(*) AS n FROM seg GROUP BY ALL)
    SELECT segment, {r('value', 'value')}, {r('''sum(n) OVER (PARTITION BY segment ORDER BY value) * 1.0
      / sum(n) OVER (PARTITION BY segment)''', 'cdf')} FROM c""",
)
def empirical_cdf(spark, sf_dir):
    return rounded(D.empirical_cdf(segments(spark, sf_dir)))


@query(
    "gaussian_kde",
    f"""WITH {SEGMENTS}, s AS (SELECT segment, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h
      FROM seg GROUP BY segment),
    g AS (SELECT k AS point, lo + k * ((hi - lo) / 199) AS x
      FROM (SELECT min(value) AS lo, max(value) AS hi FROM seg), range(200) t(k)),
    c AS (SELECT segment, value, count(*) AS m FROM seg GROUP BY ALL)
    SELECT segment, CAST(point AS INTEGER) AS point, {r('x', 'x')},
      {r('sum(m * exp(-0.5 * ((x - value) / h) ** 2) / (h * sqrt(2 * pi()))) / any_value(n)', 'pdf', 8)}
    FROM c JOIN s USING (segment), g GROUP BY segment, point, x""",
)
def gaussian_kde(spark, sf_dir):
    return rounded(D.gaussian_kde(segments(spark, sf_dir)), 6, pdf=8)


@query(
    "density_histogram",
    f"""WITH {SEGMENTS}, s AS (SELECT segment, min(value) AS lo, max(value) AS hi, count(*) AS n FROM seg GROUP BY segment),
    c AS (SELECT segment, least(floor((value - lo) / (hi - lo) * 40), 39) AS bin, count(*) AS c
      FROM seg JOIN s USING (segment) GROUP BY ALL)
    SELECT s.segment, CAST(k AS INTEGER) AS bin, {r('lo + k * ((hi - lo) / 40)', 'bin_start')},
      coalesce(c, 0) AS count, {r('coalesce(c, 0) / (n * ((hi - lo) / 40))', 'density', 8)}
    FROM s CROSS JOIN range(40) t(k) LEFT JOIN c ON c.segment = s.segment AND c.bin = k""",
)
def density_histogram(spark, sf_dir):
    return rounded(D.density_histogram(segments(spark, sf_dir), 40), 6, density=8)


@query(
    "distribution_report",
    f"""{W}, {KS}, {KL} SELECT t.name, {r('d', 'ks_statistic')}, {r('p', 'p_value')}, p < 0.05 AS significant,
    CASE WHEN p < 0.05 THEN 'Different distributions' ELSE 'Similar distributions' END AS interpretation,
    {r('v', 'kl_divergence')}, d = (SELECT max(d) FROM t) AS largest_difference FROM t JOIN kl ON t.name = kl.name""",
)
def distribution_report(spark, sf_dir):
    return rounded(D.distribution_report(segments(spark, sf_dir), PAIRS))


@query(
    "segment_statistics",
    f"""WITH {SEGMENTS} SELECT segment, count(value) AS count, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')},
    {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('quantile_cont(value, 0.25)', 'q25')},
    {r('median(value)', 'median')}, {r('quantile_cont(value, 0.75)', 'q75')} FROM seg GROUP BY segment""",
)
def segment_statistics(spark, sf_dir):
    return rounded(D.segment_statistics(segments(spark, sf_dir)))
