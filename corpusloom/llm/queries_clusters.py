"""Queries on similarity clusters (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import clusters, similar
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return clusters.density_clusters(similar.usable_vectors(table(spark, sf_dir, "chunk_vectors"), table(spark, sf_dir, "catalog_meta")))


@REGISTRY.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = _clusters(spark, sf_dir)
    return clusters.same_cluster(members, table(spark, sf_dir, "cluster_probes"))


@REGISTRY.query("p3_clusters")
def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described(*_clusters(spark, sf_dir))
