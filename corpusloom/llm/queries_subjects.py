"""Queries on subject areas (problem 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import subjects
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()


@REGISTRY.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(*(table(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_labels", "benchmark")))


@REGISTRY.query("p10_area_counts")
def p10_area_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each area; areas without documents count 0."""
    areas = table(spark, sf_dir, "subject_areas").select("area").dropna().distinct()
    found = p10_found(spark, sf_dir).groupBy("area").agg(F.count(F.lit(1)).alias("docs"))
    return areas.join(found, "area", "left").fillna(0, ["docs"])
