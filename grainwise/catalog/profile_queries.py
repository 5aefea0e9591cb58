"""Column profiling, selection and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.catalog.registry import query, r, rounded
from grainwise.functions.semantics import RULES, UNKNOWN
from grainwise.operators import profile as P
from grainwise.sources.views import table

LINE_COLUMNS = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
}
NUMERIC = [c for c, t in LINE_COLUMNS.items() if t != "string"]
DOC_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
DOC_NUMERIC = ["doc_id", "n_chars"]


def _counts(source: str, columns: dict[str, str]) -> str:
    """Value counts per column; numeric zeros are marked, values are compared natively."""
    parts = []
    for name, kind in columns.items():
        zero = f"coalesce({name} = 0, false)" if kind != "string" else "false"
        parts.append(
            f"""SELECT '{name}' AS "column", '{kind}' AS dtype, CAST({name} AS VARCHAR) AS value, {zero} AS is_zero,
            count(*) AS n FROM {source} GROUP BY {name}"""
        )
    return f"vc AS ({' UNION ALL '.join(parts)})"


PROFILE = """p AS (SELECT "column", dtype, sum(n) AS rows,
    sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) * 1.0 / sum(n) AS d,
    sum(CASE WHEN NOT is_zero THEN n ELSE 0 END) * 1.0 / sum(n) AS z,
    count(*) * 1.0 / sum(n) AS c, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM vc GROUP BY ALL),
  s AS (SELECT *, 4.0 / (1 / (d + 1e-10) + 1 / (z + 1e-10) + 1 / (c + 1e-10) + 1 / (greatest(h, 0) + 1e-10)) AS score
    FROM p)"""
# These columns are rounded by the operator itself, hence no tie shift here.
PROFILE_OUT = """"column", dtype, round(d, 6) AS value_density, round(z, 6) AS nonzero_density,
  round(c, 6) AS cardinality_ratio, round(greatest(h, 0), 4) AS entropy, round(score, 6) AS information_score"""


@query("attribute_profile_lineitem", f"WITH {_counts('lineitem', LINE_COLUMNS)}, {PROFILE} SELECT {PROFILE_OUT} FROM s")
def attribute_profile_lineitem(spark, sf_dir):
    return P.attribute_analysis(table(spark, sf_dir, "lineitem"), list(LINE_COLUMNS)).drop("sample_value")


@query("attribute_profile_documents", f"WITH {_counts('documents', DOC_COLUMNS)}, {PROFILE} SELECT {PROFILE_OUT} FROM s")
def attribute_profile_documents(spark, sf_dir):
    return P.attribute_analysis(table(spark, sf_dir, "documents")).drop("sample_value")


@query(
    "attribute_scores",
    f"""WITH {_counts('lineitem', LINE_COLUMNS)}, a AS (SELECT "column", dtype,
      sum(n) FILTER (value IS NOT NULL) * 1.0 / sum(n) AS d, count(value) * 1.0 / sum(n) AS c,
      ln(sum(n) FILTER (value IS NOT NULL)) - (sum(n * ln(n)) FILTER (value IS NOT NULL))
        / (sum(n) FILTER (value IS NOT NULL)) AS h FROM vc GROUP BY ALL),
    b AS (SELECT *, 3.0 / (1 / (d + 1e-10) + 1 / (c + 1e-10) + 1 / (greatest(h, 0) + 1e-10)) AS score FROM a)
    SELECT "column", dtype, {r('d', 'value_density')}, {r('c', 'cardinality_ratio')}, {r('greatest(h, 0)', 'entropy')},
      CASE WHEN c > 0.01 THEN 'High' WHEN c > 0.0001 THEN 'Medium' ELSE 'Low' END AS cardinality_class,
      {r('score', 'attribute_score', 7)}, {r('(SELECT median(score) FROM b WHERE score > 1e-9)', 'median_score', 7)}
    FROM b WHERE score > 1e-9""",
)
def attribute_scores(spark, sf_dir):
    scores = P.calculate_attribute_scores(table(spark, sf_dir, "lineitem"), list(LINE_COLUMNS))
    return rounded(P.ranked_scores(scores), 6, attribute_score=7, median_score=7)


@query(
    "shannon_entropy",
    f"""WITH {_counts('orders', {'o_orderstatus': 'string', 'o_orderpriority': 'string', 'o_custkey': 'bigint'})}
    SELECT "column", {r('greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0)', 'entropy')} FROM vc GROUP BY ALL""",
)
def shannon_entropy(spark, sf_dir):
    columns = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    return rounded(P.shannon_entropy(table(spark, sf_dir, "orders"), columns))


@query(
    "stratified_column_filter",
    f"""WITH {_counts('lineitem', LINE_COLUMNS)}, {PROFILE}, o AS (SELECT {PROFILE_OUT} FROM s),
    f AS (SELECT "column", concat_ws(',', CASE WHEN cardinality_ratio > 0.9 THEN 'primary_key' END,
        CASE WHEN value_density < 0.6 THEN 'sparse' END) AS drop_reason,
      concat_ws(',', CASE WHEN cardinality_ratio <= 0.1 AND value_density > 0.95 THEN 'grouping' END,
        CASE WHEN cardinality_ratio > 0.5 AND cardinality_ratio <= 0.9 AND value_density > 0.95 THEN 'resource_id' END,
        CASE WHEN cardinality_ratio > 0.1 AND cardinality_ratio <= 0.5 AND information_score > 0.3
          THEN 'composite' END) AS keep_reason FROM o)
    SELECT *, drop_reason <> '' AS drop_flag, keep_reason <> '' AS keep_flag FROM f""",
)
def stratified_column_filter(spark, sf_dir):
    profile = P.attribute_analysis(table(spark, sf_dir, "lineitem"), list(LINE_COLUMNS))
    return P.stratified_column_filter(profile).select("column", "drop_reason", "keep_reason", "drop_flag", "keep_flag")


def _semantics_sql() -> str:
    """The same ordered name rules as a CASE per output column."""
    fields = ("semantic_category", "semantic_subcategory", "expected_characteristics", "unit", "quality_checks")
    cases = []
    for i, field in enumerate(fields):
        whens = " ".join(
            f"WHEN regexp_matches(lower(name), '{pattern}') THEN '{values[i]}'" for pattern, *values in RULES
        )
        cases.append(f"CASE {whens} ELSE '{UNKNOWN[i]}' END AS {field}")
    return ", ".join(cases)


@query(
    "column_name_semantics",
    f"""SELECT name AS "column", n, {_semantics_sql()} FROM (
      SELECT name, count(*) AS n FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_type FROM part
        UNION ALL SELECT c_name FROM customer UNION ALL SELECT p_brand || '_cost_' || p_type FROM part
        UNION ALL SELECT event_type || '_timestamp' FROM events) GROUP BY name)""",
)
def column_name_semantics(spark, sf_dir):
    part, customer, events = (table(spark, sf_dir, t) for t in ("part", "customer", "events"))
    names = (
        part.select(F.col("p_name").alias("name"))
        .unionByName(part.select(F.col("p_type").alias("name")))
        .unionByName(customer.select(F.col("c_name").alias("name")))
        .unionByName(part.select(F.concat("p_brand", F.lit("_cost_"), "p_type").alias("name")))
        .unionByName(events.select(F.concat("event_type", F.lit("_timestamp")).alias("name")))
    )
    listed = names.groupBy(F.col("name").alias("column")).agg(F.count(F.lit(1)).alias("n"))
    return P.catalog_semantics(listed)


PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
CORR_SQL = "c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS correlation FROM lineitem" for a, b in PAIRS
) + ")"


@query("pairwise_correlations", f"WITH {CORR_SQL} SELECT col1, col2, {r('correlation', 'correlation')} FROM c")
def pairwise_correlations(spark, sf_dir):
    return rounded(P.pairwise_correlations(table(spark, sf_dir, "lineitem"), NUMERIC))


@query(
    "correlated_pair_selection",
    f"WITH {CORR_SQL} SELECT col1, col2, {r('abs(correlation)', 'correlation')} FROM c WHERE abs(correlation) > 0.005",
)
def correlated_pair_selection(spark, sf_dir):
    pairs = P.pairwise_correlations(table(spark, sf_dir, "lineitem"), NUMERIC)
    return rounded(P.correlated_pairs(pairs, 0.005))


@query(
    "redundant_column_choice",
    f"""WITH {CORR_SQL}, {_counts('lineitem', LINE_COLUMNS)}, {PROFILE},
    k AS (SELECT "column", round(score, 6) AS score FROM s)
    SELECT DISTINCT CASE WHEN coalesce(a.score, 0) > coalesce(b.score, 0) THEN col2 ELSE col1 END AS "column"
    FROM c LEFT JOIN k a ON col1 = a."column" LEFT JOIN k b ON col2 = b."column" WHERE abs(correlation) > 0.005""",
)
def redundant_column_choice(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    pairs = P.correlated_pairs(P.pairwise_correlations(lineitem, NUMERIC), 0.005)
    return P.redundant_columns(pairs, P.attribute_analysis(lineitem, list(LINE_COLUMNS)))


@query(
    "correlation_summary",
    f"""WITH {CORR_SQL} SELECT count(correlation) AS pairs, {r('min(abs(correlation))', 'min_abs')},
    {r('max(abs(correlation))', 'max_abs')}, {r('avg(abs(correlation))', 'mean_abs')},
    min(abs(correlation)) > 0.95 AS all_redundant FROM c""",
)
def correlation_summary(spark, sf_dir):
    return rounded(P.correlation_summary(P.pairwise_correlations(table(spark, sf_dir, "lineitem"), NUMERIC)))


WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS "column", """
        + ", ".join(f"1.0::DOUBLE AS {b}" if a == b else r(f"corr({a}, {b})", b) for b in WIDE)
        + " FROM lineitem"
        for a in WIDE
    ),
)
def correlation_matrix(spark, sf_dir):
    pairs = P.pairwise_correlations(table(spark, sf_dir, "lineitem"), WIDE)
    return rounded(P.correlation_matrix(pairs, WIDE))


@query(
    "correlation_by_group",
    f"""SELECT l_returnflag, 'l_quantity' AS col1, 'l_extendedprice' AS col2,
      {r('corr(l_quantity, l_extendedprice)', 'correlation')} FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT l_returnflag, 'l_quantity', 'l_discount', {r('corr(l_quantity, l_discount)', 'correlation')}
    FROM lineitem GROUP BY l_returnflag""",
)
def correlation_by_group(spark, sf_dir):
    pairs = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount")]
    return rounded(P.correlations_of(table(spark, sf_dir, "lineitem"), pairs, ["l_returnflag"]))


@query(
    "numeric_column_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct,
        count(DISTINCT {c}) AS "unique", {r(f'min({c})', 'min', 4)}, {r(f'max({c})', 'max', 4)},
        {r(f'avg({c})', 'mean', 4)}, {r(f'stddev_samp({c})', 'std', 4)}, {r(f'quantile_cont({c}, 0.25)', 'q25', 4)},
        {r(f'quantile_cont({c}, 0.5)', 'median', 4)}, {r(f'quantile_cont({c}, 0.75)', 'q75', 4)} FROM lineitem"""
        for c in NUMERIC
    ),
)
def numeric_column_summary(spark, sf_dir):
    return rounded(P.numeric_column_summary(table(spark, sf_dir, "lineitem")), 4)


DOC_TEXT = ["text", "lang", "source"]


@query(
    "categorical_column_summary",
    f"""WITH {_counts('documents', {c: 'string' for c in DOC_TEXT})},
    t AS (SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value[1:50]) AS rn
      FROM vc WHERE value IS NOT NULL),
    a AS (SELECT "column", dtype, sum(n) AS rows, coalesce(sum(n) FILTER (value IS NULL), 0) * 100.0 / sum(n) AS p,
      count(value) AS u, ln(sum(n) FILTER (value IS NOT NULL)) - (sum(n * ln(n)) FILTER (value IS NOT NULL))
        / (sum(n) FILTER (value IS NOT NULL)) AS h FROM vc GROUP BY ALL)
    SELECT a."column", dtype, round(p, 2) AS null_pct, u AS "unique", round(u * 1.0 / rows, 6) AS cardinality_ratio,
      CASE WHEN u * 1.0 / rows > 0.01 THEN 'High' WHEN u * 1.0 / rows > 0.0001 THEN 'Medium' ELSE 'Low' END AS card_class,
      round(h, 4) AS entropy, value[1:30] AS top_value, round(n * 100.0 / rows, 2) AS top_value_pct
    FROM a JOIN t ON a."column" = t."column" AND rn = 1""",
)
def categorical_column_summary(spark, sf_dir):
    return P.categorical_column_summary(table(spark, sf_dir, "documents"))


@query(
    "top_value_frequencies",
    f"""WITH {_counts('lineitem', {'l_returnflag': 'string', 'l_linestatus': 'string', 'l_suppkey': 'bigint'})},
    t AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk FROM vc)
    SELECT "column", CAST(rk AS INTEGER) AS rank, value, n AS count,
      {r('n * 1.0 / sum(n) OVER (PARTITION BY "column")', 'share')} FROM t WHERE rk <= 10""",
)
def top_value_frequencies(spark, sf_dir):
    columns = ["l_returnflag", "l_linestatus", "l_suppkey"]
    return rounded(P.top_value_frequencies(table(spark, sf_dir, "lineitem"), columns, 10))


@query(
    "top_texts",
    f"""WITH t AS (SELECT text, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC,
      CASE WHEN length(text) > 64 THEN md5(text) ELSE text END) AS rk FROM documents WHERE text IS NOT NULL GROUP BY text)
    SELECT 'text' AS "column", CAST(rk AS INTEGER) AS rank, text AS value, n AS count,
      {r('n * 1.0 / sum(n) OVER ()', 'share')} FROM t WHERE rk <= 10""",
)
def top_texts(spark, sf_dir):
    return rounded(P.top_value_frequencies(table(spark, sf_dir, "documents"), ["text"], 10))


@query(
    "dimension_cost_summary",
    f"""WITH d AS (
      SELECT 'l_returnflag' AS dimension, l_returnflag AS value, sum(l_extendedprice) AS c FROM lineitem GROUP BY ALL
      UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), sum(l_extendedprice) FROM lineitem GROUP BY ALL
      UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), sum(l_extendedprice) FROM lineitem GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY c DESC, value) AS rk FROM d)
    SELECT dimension, value, {r('c', 'total_cost', 2)}, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= 5""",
)
def dimension_cost_summary(spark, sf_dir):
    dimensions = ["l_returnflag", "l_suppkey", "l_linenumber"]
    return rounded(P.dimension_cost_summary(table(spark, sf_dir, "lineitem"), dimensions, "l_extendedprice", 5), 2)


DIMENSIONS = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"]


@query(
    "dimensional_cardinalities",
    " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in DIMENSIONS
    ),
)
def dimensional_cardinalities(spark, sf_dir):
    return P.dimension_cardinalities(table(spark, sf_dir, "lineitem"), DIMENSIONS)


@query(
    "grouped_quartiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", l_returnflag AS "group", count({c}) AS n, {r(f'quantile_cont({c}, 0.25)', 'q1', 4)},
        {r(f'quantile_cont({c}, 0.5)', 'median', 4)}, {r(f'quantile_cont({c}, 0.75)', 'q3', 4)}
        FROM lineitem GROUP BY l_returnflag"""
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def grouped_quartiles(spark, sf_dir):
    quartiles = P.grouped_quartiles(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag")
    return rounded(quartiles, 4)
