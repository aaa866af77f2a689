"""Queries on most similar vectors (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import similar
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()

#: The exhaustive product, which SQL can afford on a small table.
PRODUCT = """WITH cur AS (SELECT chunk_id, arg_max(struct_pack(c := catalog_id, v := vector), struct_pack(a := coalesce(embedded_at, TIMESTAMP '0001-01-01'), v := vector)) AS x FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
dims AS (SELECT catalog_id, max(dim) AS dim FROM catalog_meta GROUP BY catalog_id),
u AS MATERIALIZED (SELECT chunk_id AS id, x.v::DOUBLE[] AS v FROM cur JOIN dims ON dims.catalog_id = x.c
  WHERE x.v IS NOT NULL AND len(x.v) = dim AND len(list_filter(x.v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x.v, lambda e: e <> 0)) > 0),
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.current_vectors(table(spark, sf_dir, "chunk_vectors"), table(spark, sf_dir, "catalog_meta"))


@REGISTRY.query(
    "p1_found",
    PRODUCT
    + """c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cosine FROM u a JOIN u b ON len(a.v) = len(b.v) AND a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 6) DESC, b) AS r FROM c QUALIFY r <= 5)
SELECT x.a AS chunk_id_a, x.b AS chunk_id_b FROM t x JOIN t y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b AND x.cosine >= 0.93""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar.mutual_neighbours(_vectors(spark, sf_dir))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@REGISTRY.query(
    "p1_nearest",
    PRODUCT
    + """c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cosine FROM u a JOIN u b ON len(a.v) = len(b.v) AND a.id <> b.id WHERE a.id % 50 = 0)
SELECT a AS chunk_id, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 6) DESC, b)::INT AS rank, b AS neighbour_id, round(cosine, 4) AS cosine FROM c QUALIFY rank <= 5""",
)
def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most similar chunks of every chunk whose id is divisible by 50, among all chunks. Vectors are
    held in single precision, so cosines are shown to four decimals."""
    rows = similar.nearest(_vectors(spark, sf_dir))
    return rows.select(F.col("id").alias("chunk_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("cosine", 4).alias("cosine"))
