"""Holographic vectors: binding by circular convolution, recall, and gists that drift.

Arrow batches with numpy's real FFT; a bind of n elements costs n log n instead of n squared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLES = T.ArrayType(T.DoubleType())


def path_key(path: str, dim: int) -> np.ndarray:
    """Unit vector whose spectrum has magnitude one everywhere, from a seed of the path's SHA3-256:
    binding with it can be undone exactly."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha3_256(path.encode()).digest()[:8], "big"))
    phase = rng.uniform(-np.pi, np.pi, dim // 2 + 1)
    phase[0] = 0
    if dim % 2 == 0:
        phase[-1] = 0
    x = np.fft.irfft(np.exp(1j * phase), dim)
    return x / np.linalg.norm(x)


def convolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Circular convolution along the last axis."""
    return np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), a.shape[-1])


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Circular correlation: sum over j of a[j] * b[(i + j) mod n]."""
    return np.fft.irfft(np.conj(np.fft.rfft(a)) * np.fft.rfft(b), a.shape[-1])


def _pairwise(op):
    @F.pandas_udf(_DOUBLES)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or len(x) != len(y) else op(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b, strict=True)])

    return run


def bind(a: Column, b: Column) -> Column:
    """Circular convolution of two array columns; null if one is null or the lengths differ."""
    return _pairwise(convolve)(a, b)


def unbind(a: Column, b: Column) -> Column:
    """Circular correlation of two array columns, which undoes a bind with a."""
    return _pairwise(correlate)(a, b)


def keys_for(paths: Column, dim: int) -> Column:
    """path_key of a column of paths."""

    @F.pandas_udf(_DOUBLES)
    def run(p: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else path_key(x, dim) for x in p])

    return run(paths)


def superposition_recall(items: DataFrame, sizes: list[int], dim: int) -> DataFrame:
    """(k, mean_cosine, accuracy): for each size k all items (n, path, vector) in groups of k, floor(n / k),
    each bound to its path's key, added up within its group and recalled from the sum: mean cosine with the
    stored vectors, and the share above 0.85, over all items. The last group, and groups with gaps in n, hold
    fewer. Sums are formed by position in the cluster."""
    bound = items.select("n", "path", "vector", bind(keys_for(F.col("path"), dim), F.col("vector")).alias("bound"))
    sized = bound.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes]))).withColumn("g", F.floor(F.col("n") / F.col("k")))
    traces = sized.groupBy("k", "g").agg(F.array(*[F.sum(F.col("bound")[i]) for i in range(dim)]).alias("trace"))
    recalled = sized.join(traces, ["k", "g"]).select("k", "vector", unbind(keys_for(F.col("path"), dim), F.col("trace")).alias("got"))
    from corpusloom.functions.vectors import true_cosine

    cos = recalled.select("k", true_cosine(F.col("vector"), F.col("got")).alias("c"))
    return cos.groupBy("k").agg(F.avg("c").alias("mean_cosine"), F.avg((F.col("c") > 0.85).cast("double")).alias("accuracy"))


def gist_fold(rows: DataFrame, key: str, order: str, old: float = 0.9, new: float = 0.1, surprise: float = 0.05, bind_weight: float = 0.0) -> DataFrame:
    """(key, gist, kept): an ordered blend gist = old * gist + new * x + bind_weight * bind(key, x) over
    (key, order, vector, path); x nearer than `surprise` to the gist is skipped. The first
    vector starts from zeros. One session's rows make one group."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        gist, kept = None, 0
        for r in part.sort_values(order).itertuples():
            x = np.asarray(r.vector, float)
            gist = np.zeros(len(x)) if gist is None else gist
            if np.linalg.norm(gist - x) < surprise:
                continue
            gist = old * gist + new * x
            if bind_weight:
                gist = gist + bind_weight * convolve(path_key(r.path, len(x)), x)
            kept += 1
        return pd.DataFrame([(part[key].iloc[0], gist.tolist() if gist is not None else [], kept)], columns=["key", "gist", "kept"])

    return rows.select(key, order, "vector", "path").groupBy(key).applyInPandas(fold, "key long, gist array<double>, kept long")


def tuned(rows: DataFrame, key: str, order: str, alpha: float) -> DataFrame:
    """(key, vector): each key's (order, vector) rows blended in order, alpha of the new one, from the
    first; alpha is held within 0 and 1. The closed form of the fold: weights alpha * (1 - alpha)^k,
    k counted from the last row, and the rest for the first row."""
    from pyspark.sql import Window as W

    a = min(max(alpha, 0.0), 1.0)
    w = W.partitionBy(key)
    placed = rows.withColumns({"__k": F.row_number().over(w.orderBy(F.col(order).desc())) - 1, "__n": F.count(F.lit(1)).over(w)})
    first = F.col("__k") == F.col("__n") - 1
    weight = F.when(first, F.pow(F.lit(1 - a), F.col("__k"))).otherwise(F.lit(a) * F.pow(F.lit(1 - a), F.col("__k")))
    parts = placed.select(key, weight.alias("w"), F.posexplode("vector").alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))


def workspace_vector(files: DataFrame, dim: int, embed, per_file: int = 3, entries: int = 100, least: int = 50) -> DataFrame:
    """(vector): one unit vector of a workspace (path, text): of the first `entries` blocks by path and
    place, blocks between blank lines of more than `least` characters and `per_file` of a file at
    most, g = 0.85 g + 0.15 c + 0.1 bind(key(path), c) over their vectors c, which
    embed(blocks) -> (path, no, vector) gives. At most `entries` rows meet in the one task."""
    blocks = files.select("path", F.posexplode(F.split("text", "\n\n")).alias("no", "text")).where(F.length(F.trim("text")) > least)
    from pyspark.sql import Window as W

    ranked = blocks.withColumn("rn", F.row_number().over(W.partitionBy("path").orderBy("no"))).where(F.col("rn") <= per_file)
    first = ranked.orderBy("path", "no").limit(entries).select("path", "no", "text")
    rows = embed(first).withColumn("one", F.lit(1).cast("long"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros(dim)
        for r in part.sort_values(["path", "no"]).itertuples():
            c = np.asarray(r.vector, float)
            g = 0.85 * g + 0.15 * c + 0.10 * convolve(path_key(r.path, dim), c)
        length = np.linalg.norm(g)
        return pd.DataFrame({"vector": [(g / length if length else g).tolist()]})

    return rows.groupBy("one").applyInPandas(fold, "vector array<double>")


def watermark_bias(vector: Column, seed: str, bytes_: int = 2420) -> Column:
    """Vector plus byte * 1e-6 at index 17 * i mod n for every byte i of a SHAKE-256 stream."""
    stream = np.frombuffer(hashlib.shake_256(seed.encode()).digest(bytes_), np.uint8).astype(float)

    @F.pandas_udf(_DOUBLES)
    def run(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            if x is None:
                out.append(None)
                continue
            y = np.asarray(x, float).copy()
            np.add.at(y, (17 * np.arange(len(stream))) % len(y), stream * 1e-6)
            out.append(y)
        return pd.Series(out)

    return run(vector)


def path_direction(path: Column, dim: int) -> Column:
    """Unit vector of a path: pseudo-random branch vectors of its prefixes, weighted by depth ** -2."""

    @F.pandas_udf(_DOUBLES)
    def run(p: pd.Series) -> pd.Series:
        out = []
        for x in p:
            if x is None:
                out.append(None)
                continue
            v, parts = np.zeros(dim), [c for c in x.split("/") if c]
            for depth in range(1, len(parts) + 1):
                seed = int.from_bytes(hashlib.sha3_256("/".join(parts[:depth]).encode()).digest()[:8], "big")
                v += np.random.default_rng(seed).standard_normal(dim) / depth**2
            norm = np.linalg.norm(v)
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return run(path)
