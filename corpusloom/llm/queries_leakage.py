"""Queries on evaluation texts in training text (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import leakage
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@REGISTRY.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.copied(_pairs(spark, sf_dir))


@REGISTRY.query("p8_paraphrases")
def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.paraphrased(_pairs(spark, sf_dir))
