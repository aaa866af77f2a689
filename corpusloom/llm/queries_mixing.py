"""Queries on mixing sources to target weights (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()

SIZED = r"""
WITH rows AS (SELECT doc_id, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source,
    greatest(1, ceil(strlen(text) / 3.2))::BIGINT AS size FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL),
sized AS (SELECT doc_id, max(struct_pack(source := source, size := size)) AS x FROM rows WHERE source <> '' GROUP BY doc_id),
totals AS (SELECT x.source AS source, sum(x.size) AS size FROM sized GROUP BY 1),
everything AS (SELECT sum(size) AS total FROM totals)
"""


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sized_documents(table(spark, sf_dir, "documents"))


@REGISTRY.query("p9_method")
def p9_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named method over the whole table: one exponent, bisected to the targets' entropy."""
    return mixing.temperature_report(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@REGISTRY.query(
    "p9_found",
    SIZED
    + """SELECT DISTINCT m.source FROM mix_targets m LEFT JOIN totals t ON t.source = lower(trim(m.source)), everything
WHERE m.max_repeats * coalesce(t.size, 0) < m.target_share * total""",
)
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.target_plan(mixing.source_totals(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))
    return plan.where("short").select("source")


@REGISTRY.query("p9_mixture")
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@REGISTRY.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_shares(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@REGISTRY.query(
    "p9_source_totals",
    SIZED + "SELECT source, size::BIGINT AS size, docs FROM (SELECT x.source AS source, sum(x.size) AS size, count(*) AS docs FROM sized GROUP BY 1)",
)
def p9_source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_totals(_sized(spark, sf_dir))
