"""Queries without a full SQL form; each is tested against a brute-force version."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.llm import language_id, latent_decontamination, maxent_lm, partenum_join, sos_packing, toxicity, va_search
from grainwise.llm.registry import query, table
from grainwise.llm.tables import fold


@query("op1_ordinal_toxicity")
def ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_maxent_lm")
def maxent_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


@query("op6_latent_decontamination")
def latent_semantic_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_partenum_jaccard")
def partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


@query("op8_language_id")
def language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    layout, weights = language_id.fit(docs.where(~held))
    return language_id.predict(docs, layout, weights, kept={"held_out": F.coalesce(held, F.lit(False))})


VECTORS_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op9_va_file_search", VECTORS_SQL)
def va_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_sum_of_squares_packing")
def sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sos_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
