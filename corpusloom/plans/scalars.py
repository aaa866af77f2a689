"""Queries on small scalar functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.functions import text as T
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()
_U = "18446744073709551616::UHUGEINT"


@REGISTRY.query(
    "folded_addresses",
    f"""WITH b AS (SELECT event_id, (event_id * 2654435761 + 97)::UHUGEINT * 6700417 % {_U} AS a, (user_id * 40503 + 11)::UHUGEINT * 2147483659 % {_U} AS c FROM events),
h AS (SELECT event_id, a // 4294967296 AS ah, a % 4294967296 AS al, c // 4294967296 AS ch, c % 4294967296 AS cl FROM b),
m AS (SELECT event_id, al * cl AS z0, al * ch + ah * cl AS z1, ah * ch AS z2 FROM h),
z AS (SELECT event_id, (z0 + (z1 % 4294967296) * 4294967296) AS low, z2 + z1 // 4294967296 AS high FROM m),
f AS (SELECT event_id, low % {_U} AS lo, (high + low // {_U}) % {_U} AS hi FROM z)
SELECT event_id, CASE WHEN xor(lo, hi) >= 9223372036854775808 THEN (xor(lo, hi)::HUGEINT - 18446744073709551616)::BIGINT ELSE xor(lo, hi)::BIGINT END AS folded FROM f""",
)
def folded_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128-bit products of unsigned longs, folded."""
    wrap = lambda c: (c % F.lit(Decimal(1 << 64))).cast("decimal(38,0)")
    signed = lambda c: F.when(c >= F.lit(Decimal(1 << 63)), c - F.lit(Decimal(1 << 64))).otherwise(c).cast("long")
    d = lambda c: c.cast("decimal(19,0)")
    a = wrap(d(F.col("event_id") * 2654435761 + 97) * F.lit(6700417).cast("decimal(18,0)"))
    c = wrap(d(F.col("user_id") * 40503 + 11) * F.lit(2147483659).cast("decimal(18,0)"))
    return table(spark, sf_dir, "events").select("event_id", S.folded_address(signed(a), signed(c)).alias("folded"))


@REGISTRY.query(
    "device_sizing",
    "SELECT DISTINCT catalog_id, dim * (catalog_id % 8 + 1) AS memory, floor((dim::BIGINT * (catalog_id % 8 + 1) * 1073741824) / (4 * bit_width))::BIGINT AS context FROM catalog_meta WHERE bit_width > 0",
)
def device_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory of a set of devices and the longest context of a model on them."""
    m = table(spark, sf_dir, "catalog_meta").where("bit_width > 0")
    n = F.col("catalog_id") % 8 + 1
    return m.select("catalog_id", S.total_memory(F.col("dim"), n).alias("memory"), S.longest_context(F.col("dim"), n, F.col("bit_width")).alias("context")).distinct()


@REGISTRY.query("progress_bars", "SELECT event_id, repeat('█', least((event_id % 130) * 20 // 100, 20)::INT) || repeat('░', 20 - least((event_id % 130) * 20 // 100, 20)::INT) AS bar FROM events")
def progress_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.progress_bar(F.col("event_id") % 130, 20).alias("bar"))


@REGISTRY.query(
    "recommendations",
    """WITH e AS (SELECT DISTINCT event_type, user_id % 3 AS b FROM events), m AS (SELECT event_type, b, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN b = 1 ELSE false END AS cloud FROM e)
SELECT event_type, b AS burst, CASE WHEN cloud THEN 'cloud_192gb' ELSE 'local_8gb' END AS mode, CASE WHEN cloud THEN 8 ELSE 1 END::INT AS batch, CASE WHEN cloud THEN 32768 ELSE 4096 END::INT AS context FROM m""",
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode, batch and context by a setting: clicks name the cloud, views nothing, others a local device."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("burst")).distinct()
    name = F.when(F.col("event_type") == "click", "Cloud").when(F.col("event_type") == "view", F.lit(None)).otherwise("rx580")
    mode = S.adaptive_mode(name, F.col("burst").cast("string"))
    return e.select("event_type", "burst", mode.alias("mode"), S.recommended(mode)["batch"].alias("batch"), S.recommended(mode)["context"].alias("context"))


@REGISTRY.query("prefixed_texts", "SELECT DISTINCT chunk_id, md5(coalesce(path, '') || chr(10) || text) AS digest FROM chunks WHERE text IS NOT NULL")
def prefixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_id", F.md5(S.prefixed_text(F.col("path"), F.col("text"))).alias("digest")).distinct()


@REGISTRY.query("packed_sizes", "SELECT DISTINCT catalog_id, (coalesce(chunk_count, 0) * ((dim + 63) // 64) * 16)::BIGINT AS bytes, 'hash-v1-d' || dim AS own_id, 'tag:model-d' || dim AS server_id FROM catalog_meta WHERE dim IS NOT NULL")
def packed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each catalog as a packed ternary matrix, and the ids of embedders of its dimension."""
    m = table(spark, sf_dir, "catalog_meta").where("dim IS NOT NULL")
    ids = [S.embedder_id(F.col("dim")).alias("own_id"), S.embedder_id(F.col("dim"), F.lit("tag"), F.lit("model")).alias("server_id")]
    return m.select("catalog_id", S.packed_bytes(F.coalesce("chunk_count", F.lit(0)), F.col("dim")).alias("bytes"), *ids).distinct()


@REGISTRY.query("sha3_digests")
def sha3_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", S.sha3(F.col("text")).alias("sha3"), S.shake(F.col("text"), 16).alias("shake"), T.content_hash("text").alias("content_hash"))
