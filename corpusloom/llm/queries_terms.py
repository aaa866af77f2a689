"""Queries on terms: distinctiveness (problem 5) and frequency (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import distinctive, frequency
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()

TERMS = r"""
WITH recs AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id),
occ AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM recs),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM occ GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM recs),
freq AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term)
"""


@REGISTRY.query(
    "p5_method",
    TERMS
    + """, s AS (SELECT chunk_id, term, round(tf * (log2(n / df) + log2(1 - exp(-cf / n))), 6) AS score
  FROM tf JOIN freq USING (term), n WHERE df >= 3)
SELECT chunk_id, term, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, term) AS r FROM s) WHERE r = 1""",
)
def p5_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named method over the whole table: each record's term of highest residual idf."""
    top = distinctive.top_residual_terms(table(spark, sf_dir, "chunks"))
    return top.select(F.col("key").alias("chunk_id"), "term", "score")


@REGISTRY.query(
    "p5_found",
    TERMS
    + """, s AS (SELECT chunk_id, term, round((1 + ln(tf)) * ln(1 + n / df), 6) AS score FROM tf JOIN freq USING (term), n WHERE df >= 3)
SELECT chunk_id, term FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, term) AS r FROM s) WHERE r = 1""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.top_terms(table(spark, sf_dir, "chunks")).select(F.col("key").alias("chunk_id"), "term")


@REGISTRY.query(
    "p6_found",
    TERMS + "SELECT term, CASE WHEN df < 3 THEN 'rare' ELSE 'common' END AS mark FROM freq, n WHERE df < 3 OR df > n / 4",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.term_marks(table(spark, sf_dir, "chunks"))


@REGISTRY.query(
    "p6_term_frequencies",
    TERMS + "SELECT term, cf AS occurrences, df, CASE WHEN df < 3 THEN 'rare' WHEN df > n / 4 THEN 'common' END AS mark FROM freq, n",
)
def p6_term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, sf_dir, "chunks"))
