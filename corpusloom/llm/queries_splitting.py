"""Queries on splitting oversized chunks (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import splitting
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "catalog_meta"))


@REGISTRY.query(
    "p2_found",
    """SELECT DISTINCT chunk_id FROM chunks JOIN (SELECT catalog_id, max(max_chunk_bytes) AS cap FROM catalog_meta GROUP BY 1) USING (catalog_id)
WHERE text IS NOT NULL AND strlen(text) > cap""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 0").select("chunk_id")


@REGISTRY.query("p2_pieces")
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 32))
