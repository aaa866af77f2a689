"""Vector collections: weights, centroids, partitioned search, ternary codes, hybrid ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.functions.text import subwords
from corpusloom.functions.vectors import dot, normalized, ternary, ternary_dot
from corpusloom.operators.search import dense_top, in_parts, small_side, top_per
from corpusloom.session import cut, numbered

#: Collections under this size are searched in full: partitions would not pay.
MIN_PARTITIONED = 4096
#: Most centroids of a collection; they are shipped to the workers.
MAX_PARTS = 10_000


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; rows of no or no finite length are all zeros."""
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    good = np.isfinite(length) & (length > 0)
    return np.where(good, x / np.where(good, length, 1), 0.0)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(x: np.ndarray) -> pa.Array:
    """A matrix's rows as a list column."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def sum_of(vectors: DataFrame, vector: str = "vector") -> tuple[int, np.ndarray]:
    """(rows, sum) of a vector column. Each Arrow batch adds up its own rows, so a row a partition is
    what meets. Null vectors are left out; all others have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, acc = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0), len(batch.column(0)[0]))
                n, acc = n + len(x), x.sum(0) if acc is None else acc + x.sum(0)
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), _lists(acc[None])], ["n", "acc"])

    parts = vectors.where(F.col(vector).isNotNull()).select(vector).mapInArrow(run, "n long, acc array<double>")
    got = parts.select("n", F.posexplode("acc").alias("pos", "x")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # a row a dimension
    out = np.zeros(len(got))
    for r in got:
        out[r["pos"]] = r["x"]
    return (got[0]["n"] if got else 0), out


def centroid(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """(pos, value): the unit mean of all vectors, by position; a row a dimension."""
    _, total = sum_of(vectors, vector)
    return vectors.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(_unit(total))], "pos int, value double")


#: Longer words are hashed one by one.
LONG_WORD = 64


def fnv_many(words: list[bytes], seed: int = 0) -> np.ndarray:
    """FNV-1a of many byte strings, column by column of their padded matrix."""
    start = np.uint64(hashing.OFFSET ^ seed)
    out = np.full(len(words), start, np.uint64)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    short = np.flatnonzero(sizes <= LONG_WORD)
    prime = np.uint64((1 << 40) + 435)
    if len(short):
        width = int(sizes[short].max(initial=0))
        table = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in short), np.uint8).reshape(len(short), width) if width else None
        h = out[short]
        for c in range(width):
            inside = sizes[short] > c
            h[inside] = (h[inside] ^ table[inside, c]) * prime
        out[short] = h
    for i in np.flatnonzero(sizes > LONG_WORD):
        h = int(start)
        for byte in words[i]:
            h = (h ^ byte) * int(prime) & (1 << 64) - 1
        out[i] = h
    return out


def _hashed_rows(words: pa.Array, dim: int, weight: float) -> np.ndarray:
    """Signed sums of weight * (1 + ln tf) of the words (seed 0) and adjacent pairs of each row."""
    out = np.zeros((len(words), dim))
    coded = words.flatten().dictionary_encode()
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    if not names:
        return out
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    next_to = np.flatnonzero(row[:-1] == row[1:])
    pairs, pair = np.unique(code[next_to] * len(names) + code[next_to + 1], return_inverse=True)
    joined = [names[p // len(names)] + b" " + names[p % len(names)] for p in pairs.tolist()]
    h = np.concatenate([fnv_many(names), fnv_many(joined, hashing.PAIR_SEED)])
    slot, sign = (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)
    feature = np.concatenate([code, len(names) + pair])
    at, tf = np.unique(np.concatenate([row, row[next_to]]) * len(h) + feature, return_counts=True)
    feature = at % len(h)
    np.add.at(out, (at // len(h), slot[feature]), weight * sign[feature] * (1 + np.log(tf)))
    return out


def raw_features(docs: DataFrame, dim: int = 256, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, vector): hashed features of each text before any weighting. With `path`, the words of the
    path count double and form no pairs with the text. A narrow map: words come from the JVM,
    each distinct word or pair of a batch is hashed once. Null texts have no row; texts without
    words have zeros. Sums are rounded to 9 decimals, so that what cancels out is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _hashed_rows(batch.column(1), dim, 1.0)
                if path:
                    x += _hashed_rows(batch.column(2), dim, 2.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x.round(9))], ["key", "vector"])

    words = [subwords(text).alias("ws")] + ([F.coalesce(subwords(path), F.array().cast("array<string>")).alias("ps")] if path else [])
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), *words)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, vector array<double>")


def slot_weights(raw: DataFrame, dim: int = 256) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, df, weight) by slot: ln(1 + n / max(df, 1)) over the rows with a non-zero slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([_lists((_rows(batch.column(0), dim) != 0).astype(float))], ["vector"])

    n, df = sum_of(raw.select("vector").mapInArrow(run, "vector array<double>"))
    df = df if len(df) else np.zeros(dim)
    return n, df, np.log(1 + n / np.maximum(df, 1))


def weighted(raw: DataFrame, weights: np.ndarray) -> DataFrame:
    """(key, vector): raw features by their slots' weights, as unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_unit(_rows(batch.column(1), len(weights)) * weights))], ["key", "vector"])

    return raw.select("key", "vector").mapInArrow(run, raw.select("key", "vector").schema)


def hash_embeddings(docs: DataFrame, dim: int = 256, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, slot, value): weighted unit vectors in sparse form, weights from the same texts."""
    raw = cut(raw_features(docs, dim, key, text, path), "hash-features")
    vectors = weighted(raw, slot_weights(raw, dim)[2])
    return vectors.select("key", F.posexplode("vector").alias("slot", "value")).where("value <> 0")


def few_centroids(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(part numbers, unit-free matrix) of (part, centroid), of which there are at most MAX_PARTS."""
    got = centroids.orderBy("part").limit(MAX_PARTS + 1).collect()
    if len(got) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} centroids: partition the collection first")
    return np.array([r["part"] for r in got], np.int32), np.array([r["centroid"] for r in got], np.float64)


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, part): each vector's centroid (part, centroid) of the greatest inner product, the first of
    equals to 9 decimals; a matrix product an Arrow batch."""
    parts, c = few_centroids(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(parts):
                best = (_rows(batch.column(1), c.shape[1]) @ c.T).round(9).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts[best])], ["id", "part"])

    rows = vectors.select("id", "vector")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, part int")


def update(vectors: DataFrame, parts: DataFrame, dim: int) -> DataFrame:
    """(part, centroid): unit mean of each part's vectors, element by element and combined map-side."""
    sums = [F.avg(F.col("vector")[i].cast("double")).alias(f"m{i}") for i in range(dim)]
    means = vectors.join(parts, "id").groupBy("part").agg(*sums)
    return means.select("part", normalized(F.array(*[F.col(f"m{i}") for i in range(dim)])).alias("centroid"))


def strided(vectors: DataFrame, parts: int) -> DataFrame:
    """(part, centroid): vectors at equal strides of the order by id, as a start. Ranks come from range
    partitions and their offsets, not from one global sort."""
    ranked = numbered(vectors.select("id", "vector"), ["id"], "at")
    n = ranked.count()
    stride = max(1, n // parts)
    rows = ranked.where((F.col("at") % stride == 0) & (F.col("at") < stride * parts))
    return rows.select(F.floor(F.col("at") / stride).cast("int").alias("part"), F.col("vector").cast("array<double>").alias("centroid"))


def kmeans(vectors: DataFrame, parts: int, rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """(centroids, assignment) by spherical k-means: strided start, at most `rounds` rounds, stops
    when no centroid moves; empty parts keep their centroid. The assignment is the last one, as
    of before the last update. One Arrow pass a round forms partial sums; parts x dim numbers
    return to the driver."""
    spark = vectors.sparkSession
    ranked = cut(vectors.select("id", "vector"), "vectors")
    _, c = few_centroids(strided(ranked, parts))
    if not len(c):
        return spark.createDataFrame([], "part int, centroid array<double>"), spark.createDataFrame([], "id long, part int")
    c = _unit(c)
    dim = c.shape[1]

    def passes(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((len(c), dim + 1))
            for batch in batches:
                x = _rows(batch.column(0), dim)
                best = (x @ c.T).argmax(1)
                np.add.at(acc[:, :-1], best, x)
                acc[:, -1] += np.bincount(best, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), _lists(acc)], ["part", "acc"])

        return run

    used = c
    for _ in range(rounds):
        got = ranked.select("vector").mapInArrow(passes(c), "part int, acc array<double>")
        total = np.zeros((len(c), dim + 1))
        for r in got.groupBy("part").agg(F.array(*[F.sum(F.col("acc")[i]) for i in range(dim + 1)]).alias("acc")).collect():
            total[r["part"]] = r["acc"]
        moved = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), c)
        moved = _unit(moved)
        used, done = c, np.abs(moved - c).max() < 1e-9
        c = moved
        if done:
            break
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "part int, centroid array<double>")
    return frame(c), assign(ranked, frame(used))


def nearest_parts(queries: DataFrame, centroids: DataFrame, probes: int) -> DataFrame:
    """(q, part): the `probes` parts with the greatest inner product for each query."""
    named = centroids.select(F.col("part").cast("long").alias("id"), F.col("centroid").alias("vector"))
    return dense_top(named, queries, probes).select("q", F.col("id").cast("int").alias("part"))


def probe(vectors: DataFrame, centroids: DataFrame, queries: DataFrame, probes: int, k: int) -> DataFrame:
    """(q, id, score, rank): search in the `probes` partitions nearest to each query. vectors is
    (id, vector, part); of a table partitioned by part only the files of wanted parts are read,
    and each query is scored in its own parts."""
    picked = nearest_parts(queries, centroids, probes)
    wanted = sorted(r[0] for r in picked.select("part").distinct().collect())  # at most MAX_PARTS
    return dense_top(vectors.where(F.col("part").isin(wanted)), queries, k, "part", in_parts(picked))


def partitioned(vectors: DataFrame, path: str, parts: int, rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """(centroids, vectors): k-means partitions, written to `path` as a table with a folder a part.
    Large parts are spread over several files. Collections under MIN_PARTITIONED rows are one
    part, which is searched in full."""
    spark = vectors.sparkSession
    n = vectors.count()
    centroids, labels = kmeans(vectors, parts if n >= MIN_PARTITIONED else 1, rounds)
    spread = F.pmod(F.xxhash64("id"), F.lit(max(1, n // (max(parts, 1) * 1_000_000))))
    joined = vectors.join(labels, "id")
    joined.repartition("part", spread).write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{path}/vectors")
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/vectors")


def ternary_top(vectors: DataFrame, queries: DataFrame, k: int, alpha: float = 0.3) -> DataFrame:
    """(q, id, agreement, rank): nearest by agreements minus disagreements of ternary codes, which is
    the inner product of the codes."""
    code = ternary(F.col("vector"), alpha).cast("array<double>").alias("vector")
    top = dense_top(vectors.select("id", code), queries.select("q", code), k)
    return top.select("q", "id", F.col("score").cast("int").alias("agreement"), "rank")


def coarse_to_fine(vectors: DataFrame, queries: DataFrame, k: int, alpha: float = 0.3) -> DataFrame:
    """(q, id, score, rank): the max(8k, 64) best by ternary codes, ranked again exactly."""
    coarse = ternary_top(vectors, queries, max(8 * k, 64), alpha).select("q", "id")
    exact = small_side(coarse).join(small_side(queries.select("q", F.col("vector").alias("qv"))), "q").join(vectors, "id")
    return top_per(exact.select("q", "id", F.round(dot(F.col("qv"), F.col("vector")), 6).alias("score")), "q", "score", "id", k)
