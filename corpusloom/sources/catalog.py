"""A catalog on disk: chunks, vectors, slot weights, partitions and a row of metadata, as Parquet.

A build writes a new version folder, numbered after the last one, and its metadata last. Readers take
the greatest version whose metadata is complete, so they see the old or the new version, never a
mixture or nothing. Collections of MIN_PARTITIONED chunks and more are stored by partition.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import dense
from corpusloom.operators.chunking import catalog_chunks
from corpusloom.operators.retrieval import unit_gist
from corpusloom.session import cut, remove_path

TABLES = ("chunks", "vectors", "weights", "centroids", "meta")
KEEP = 2


class CatalogError(ValueError):
    """A catalog that is missing, damaged or made by another embedder."""


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def body_digest(chunks: DataFrame) -> tuple[int, int]:
    """Number of chunks and an order-independent digest of their contents."""
    n, digest = chunks.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("chunk_id", "path", "line_start", "line_end", "content_hash"))).first()
    return n, digest or 0


def _versions(spark: SparkSession, path: str, complete: bool = True) -> list[str]:
    """Version folders, the newest last; with complete, those whose metadata was written."""
    fs, target = _fs(spark, f"{path.rstrip('/')}/v-*" + ("/meta/_SUCCESS" if complete else ""))
    found = [f.getPath() for f in fs.globStatus(target) or []]
    return sorted(str((p.getParent().getParent() if complete else p).toString()) for p in found)


def checked(vectors: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """The vectors, with an error in the job where one does not have `dim` elements."""
    wrong = F.raise_error(F.format_string(f"a vector has %d elements, the catalog {dim}", F.size(vector)))
    return vectors.where(F.when(F.size(vector) == dim, True).otherwise(wrong.cast("boolean")))


def build(files: DataFrame, path: str, dim: int = 256, **limits: int) -> str:
    """Build a catalog of (path, text) at `path` and return the version's folder. Nothing to index is
    an error. The two newest complete versions stay, for readers of the one before."""
    spark, root = files.sparkSession, path.rstrip("/")
    numbers = [int(v.rsplit("-", 1)[1]) for v in _versions(spark, root, complete=False)]
    version = f"{root}/v-{max(numbers, default=0) + 1:08d}"
    catalog_chunks(files, **limits).write.option("compression", "zstd").parquet(f"{version}/chunks")
    chunks = spark.read.parquet(f"{version}/chunks")
    n, digest = body_digest(chunks)
    if n == 0:
        raise CatalogError("nothing to index")
    raw = cut(dense.raw_features(chunks, dim, "chunk_id", "text", "path"), "features")
    _, df, weight = dense.slot_weights(raw, dim)
    vectors = checked(dense.weighted(raw, weight), dim).select(F.col("key").alias("id"), "vector")
    dense.partitioned(vectors, version, max(2, int(np.sqrt(n))) if n >= dense.MIN_PARTITIONED else 1)
    rows = [(i, int(d), float(w)) for i, (d, w) in enumerate(zip(df, weight, strict=True))]
    spark.createDataFrame(rows, "slot int, df long, weight double").coalesce(1).write.parquet(f"{version}/weights")
    _, gist = unit_gist(spark.read.parquet(f"{version}/vectors"))
    total = chunks.agg(F.count_distinct("path"), F.sum(F.octet_length("text"))).first()
    row = [(f"hash-v1-d{dim}", dim, n, total[0], total[1], digest, int(time.time()), gist.tolist())]
    spark.createDataFrame(row, "embedder_id string, dim int, chunk_count long, file_count long, source_bytes long, digest long, built long, gist array<double>").coalesce(1).write.parquet(f"{version}/meta")
    for old in _versions(spark, root)[:-KEEP]:
        remove_path(spark, old)
    return version


def open_catalog(spark: SparkSession, path: str, embedder_id: str | None = None, verify: bool = False) -> dict[str, DataFrame]:
    """The tables of the newest version. Raises CatalogError if there is none, it was made by another
    embedder, its parts do not fit each other, or (with verify) its chunks do not have the digest
    they were written with."""
    known = _versions(spark, path)
    if not known:
        raise CatalogError(f"no catalog at {path}")
    tables = {t: spark.read.parquet(f"{known[-1]}/{t}") for t in TABLES}
    meta = tables["meta"].first()
    if embedder_id is not None and meta["embedder_id"] != embedder_id:
        raise CatalogError(f"catalog was made by {meta['embedder_id']}, not {embedder_id}")
    if meta["dim"] <= 0 or len(meta["gist"]) != meta["dim"] or tables["weights"].count() != meta["dim"]:
        raise CatalogError("gist or slot weights do not have the catalog's dimension")
    if verify and body_digest(tables["chunks"]) != (meta["chunk_count"], meta["digest"]):
        raise CatalogError("catalog contents do not match their digest")
    return tables


def query_vectors(catalog: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(q, vector) of (q, text), embedded with the catalog's own slot weights."""
    weights = np.array([r["weight"] for r in catalog["weights"].orderBy("slot").collect()])  # a row a dimension
    return dense.weighted(dense.raw_features(queries, len(weights), "q", "text"), weights).select(F.col("key").alias("q"), "vector")


def search(catalog: dict[str, DataFrame], queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(q, id, score, rank): the k best chunks of each query (q, text). With probes, in that many of the
    catalog's partitions; only their folders are read."""
    asked = cut(query_vectors(catalog, queries), "asked")
    if probes is None:
        return dense.dense_top(catalog["vectors"], asked, k)
    return dense.probe(catalog["vectors"], catalog["centroids"], asked, probes, k)
