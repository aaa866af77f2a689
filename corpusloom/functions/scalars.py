"""Small scalar functions: sizing, status text, packing, wide products."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Recommended batch and context size by mode, and the spellings of the modes.
MODES = {"local_8gb": (1, 4096), "cloud_192gb": (8, 32768)}
CLOUD_NAMES = ("cloud", "mi300x", "192gb")


def wide_product(a: Column, b: Column) -> Column:
    """struct(high, low): the 128-bit product of two unsigned 64-bit numbers, kept in signed longs; the
    halves are signed longs too. Null if one is null."""

    @F.pandas_udf("high long, low long")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(x, y, strict=True):
            if p is None or q is None:
                out.append((None, None))
                continue
            z = (int(p) % (1 << 64)) * (int(q) % (1 << 64))
            out.append(tuple(v - (1 << 64) if v >> 63 else v for v in (z >> 64, z & (1 << 64) - 1)))
        return pd.DataFrame({name: pd.array([z[i] for z in out], dtype="Int64") for i, name in enumerate(("high", "low"))})

    # As text, since longs next to nulls would come as floats.
    return run(a.cast("string"), b.cast("string"))


def folded_address(base: Column, offset: Column) -> Column:
    """The halves of the wide product, xored."""
    z = wide_product(base, offset)
    return z["high"].bitwiseXOR(z["low"])


def total_memory(gigabytes: Column, devices: Column) -> Column:
    """Memory of all devices; also their total throughput."""
    return gigabytes * devices


def longest_context(gigabytes: Column, devices: Column, billions: Column) -> Column:
    """Total memory in bytes over four times the model's size in billions of parameters; null for a model of 0."""
    size = (billions * 4).cast("long")
    return F.when(size > 0, F.floor(total_memory(gigabytes, devices).cast("long") * F.lit(1 << 30) / size)).cast("long")


def progress_bar(percent: Column, width: int) -> Column:
    """`width` cells, the part that percent fills in front; over 100 the bar is full."""
    filled = F.least(F.floor(percent * width / 100), F.lit(width)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def adaptive_mode(name: Column, burst: Column) -> Column:
    """Mode by its name, whose case does not count; without a name, by the burst flag."""
    cloud = F.when(name.isNotNull(), F.lower(name).isin(*CLOUD_NAMES)).otherwise(F.coalesce((burst == "1") | (F.lower(burst) == "true"), F.lit(False)))
    return F.when(cloud, "cloud_192gb").otherwise("local_8gb")


def recommended(mode: Column) -> Column:
    """struct(batch, context) of a mode; null for others."""
    out = F.lit(None).cast("struct<batch:int,context:int>")
    for name, (batch, context) in MODES.items():
        out = F.when(mode == name, F.struct(F.lit(batch).alias("batch"), F.lit(context).alias("context"))).otherwise(out)
    return out


def prefixed_text(path: Column, text: Column) -> Column:
    """What an embedder without a path of its own is given: the path, a line feed, the text."""
    return F.concat(F.coalesce(path, F.lit("")), F.lit("\n"), text)


def packed_bytes(rows: Column, columns: Column) -> Column:
    """Bytes of a packed ternary matrix: two bits an element, in 64-bit words of each sign and row."""
    return (rows * F.ceil(columns / 64) * 16).cast("long")


def embedder_id(dim: Column, server: Column | None = None, model: Column | None = None) -> Column:
    """hash-v1-dN of the built-in embedder, tag:model-dN of a server's."""
    tail = F.concat(F.lit("-d"), dim.cast("string"))
    own = F.concat(F.lit("hash-v1"), tail)
    return own if server is None or model is None else F.when(server.isNull(), own).otherwise(F.concat(server, F.lit(":"), model, tail))


def sha3(text: Column) -> Column:
    """SHA3-256 of the UTF-8 bytes, in hex."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hashlib.sha3_256(t.encode()).hexdigest() for t in texts])

    return run(text)


def shake(text: Column, size: int) -> Column:
    """The first `size` bytes of SHAKE-256 of the UTF-8 bytes, in hex."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hashlib.shake_256(t.encode()).hexdigest(size) for t in texts])

    return run(text)
