"""Queries on credentials in code (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import credentials
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.code_records(table(spark, sf_dir, "code_patches"), table(spark, sf_dir, "chunks"))


@REGISTRY.query("p4_method")
def p4_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named method over both tables: literals that decode, layer by layer, and what they hold."""
    return credentials.decoded_layers(_records(spark, sf_dir))


@REGISTRY.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(_records(spark, sf_dir))


@REGISTRY.query("p4_redacted")
def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redact(_records(spark, sf_dir))
