"""Files of a workspace as a DataFrame, and other file sources."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import IGNORED_DIRS, is_indexable

MAX_BYTES = 2 << 20


def workspace_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, text, modified): indexable files under a mounted root, with relative paths. Ignored
    and dotted directories, links, unknown extensions, files over max_bytes, unreadable files
    and files that are not valid UTF-8 are left out; nothing is decoded lossily.

    Only names are listed on the driver; the files are read by the tasks. Spark's own file
    listing would skip names that begin with a dot or an underscore, such as __init__.py."""
    base = os.path.abspath(root)
    found = []
    for folder, dirs, names in os.walk(base):
        dirs[:] = sorted(d for d in dirs if d not in IGNORED_DIRS and not d.startswith("."))
        for name in names:
            full = os.path.join(folder, name)
            if not os.path.islink(full):
                found.append((os.path.relpath(full, base).replace(os.sep, "/"),))
    listed = spark.createDataFrame(found, "path string").where(is_indexable("path"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                full = os.path.join(base, path)
                try:
                    if os.path.getsize(full) <= max_bytes:
                        with open(full, "rb") as f:
                            rows.append((path, f.read().decode("utf-8"), int(os.path.getmtime(full))))
                except (OSError, UnicodeDecodeError):
                    continue
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "text", "modified"])

    return listed.repartition(max(1, min(1000, len(found) // 200))).mapInArrow(read, "path string, text string, modified long")


def stored_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, text, modified) of an object store, by the same rules, through Spark's binaryFile
    source; it lists in the cluster but skips names that begin with a dot or an underscore."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = literal_pattern(root.rstrip("/"))
    name = F.regexp_replace("path", "^.*?" + base + "/", "")
    rows = raw.where(F.col("length") <= max_bytes).select(name.alias("path"), F.col("content").cast("string").alias("text"), F.unix_timestamp("modificationTime").alias("modified"))
    return rows.where(is_indexable("path") & F.is_valid_utf8("text"))


def literal_pattern(text: str) -> str:
    """A Java regular expression that matches the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def legacy_tensor(spark: SparkSession, path: str, dim: int = 1536) -> DataFrame:
    """(path, vector): files that hold a magic, a JSON header and `dim` little-endian floats after the
    header's first closing brace; shorter files have a null vector."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def read(blobs: pd.Series) -> pd.Series:
        out = []
        for b in blobs:
            at = b.find(b"}") + 1
            out.append(np.frombuffer(b, "<f4", dim, at) if at and len(b) >= at + 4 * dim else None)
        return pd.Series(out)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", read("content").alias("vector"))


def embedding_replies(replies: DataFrame, column: str = "body") -> DataFrame:
    """(…, index, vector): vectors of embedding-server replies in their three shapes, in the order of
    `index` where it is given: data[].embedding, embedding, embeddings[]. Errors give no rows."""
    data = F.from_json(F.col(column), "data array<struct<index:int,embedding:array<float>>>")["data"]
    single = F.from_json(F.col(column), "embedding array<float>")["embedding"]
    many = F.from_json(F.col(column), "embeddings array<array<float>>")["embeddings"]
    plain = F.transform(F.coalesce(many, F.when(single.isNotNull(), F.array(single))), lambda v, i: F.struct(i.alias("index"), v.alias("embedding")))
    items = F.coalesce(F.array_sort(data), plain)
    keep = [c for c in replies.columns if c != column]
    return replies.select(*keep, F.explode(items).alias("x")).select(*keep, "x.index", F.col("x.embedding").alias("vector"))


def find_catalog(start: str, name: str = ".catalog", env: str = "LOOM_CATALOG") -> str | None:
    """The catalog folder: that of the environment variable, else the nearest above `start`."""
    if os.environ.get(env):
        return os.environ[env]
    here = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(here, name)):
            return os.path.join(here, name)
        up = os.path.dirname(here)
        if up == here:
            return None
        here = up


#: Bytes of the seal at the end of a sealed file: a SHA3-256 digest, then a signature's place.
SEAL_BYTES = 2452


def sealed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sealed, intact) of files whose last SEAL_BYTES bytes are a seal: whether the file is long
    enough to hold one, and whether the seal's digest is that of what stands before it."""
    @F.pandas_udf("boolean")
    def intact(blobs: pd.Series) -> pd.Series:
        return pd.Series([len(b) >= SEAL_BYTES and hashlib.sha3_256(b[:-SEAL_BYTES]).digest() == b[-SEAL_BYTES:][:32] for b in blobs])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", (F.col("length") >= SEAL_BYTES).alias("sealed"), intact("content").alias("intact"))


def sealed(content: bytes) -> bytes:
    """A file's bytes with their seal; the signature's place is zeros."""
    return content + hashlib.sha3_256(content).digest() + bytes(SEAL_BYTES - 32)
