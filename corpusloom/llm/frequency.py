"""Frequency of every distinct term, in vertical layout.

Each term has a compressed bitmap of the records that hold it: for every block of 65,536 record ids a
container, which is a sorted list of 16-bit ids, or from DENSE ids on a plain bitmap of 8 KiB. Beside
the ids stand their occurrence counters in the same order. A narrow pass builds containers for the
records of an Arrow batch; containers of a term and block are merged by union, where a counter that
both have takes the greater value, so a record that is delivered twice counts once. The document
frequency is the cardinality of the containers, the collection frequency the sum of their counters.
A term that is in every record has a container a block, so it never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.records import TERM
from corpusloom.session import cut

CONTAINER = "term string, block long, dense boolean, ids binary, counters binary"
#: Ids from which on a container is a bitmap.
DENSE = 4096
_NAMES = ["term", "block", "dense", "ids", "counters"]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of an array."""
    offsets = (np.concatenate(([0], ends)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _grouped(groups: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, ends, ids, counters): distinct ids of each group in order, each with its greatest counter."""
    order = np.lexsort((low, groups))
    g, i, c = groups[order], low[order], count[order]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
    c = np.maximum.reduceat(c, first) if len(first) else c
    g, i = g[first], i[first]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return g[starts], np.r_[starts[1:], len(g)] if len(starts) else starts, i.astype(np.uint16), c.astype(np.uint32)


def build_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, terms) to CONTAINER rows of lists; those without a term hold all records."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, terms = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        coded = terms.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(keys)), np.diff(terms.offsets.to_numpy()))
        # Occurrences within each row, and once for every record under the code -1.
        at, tf = np.unique(row * (len(coded.dictionary) + 1) + code, return_counts=True)
        row, code = at // (len(coded.dictionary) + 1), at % (len(coded.dictionary) + 1)
        key = np.concatenate([keys[row], keys])
        code = np.concatenate([code, np.full(len(keys), -1)])
        tf = np.concatenate([tf, np.ones(len(keys), np.int64)])
        blocks, block = np.unique(key >> 16, return_inverse=True)
        groups, ends, ids, counters = _grouped((code + 1) * len(blocks) + block, key & 0xFFFF, tf)
        names = coded.dictionary.take(pa.array(groups // len(blocks) - 1, mask=groups < len(blocks)))
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(blocks[groups % len(blocks)]), pa.array(np.zeros(len(groups), bool)), _binary(ids, ends), _binary(counters, ends)], _NAMES
        )


def unpacked(dense: bool, ids: bytes) -> np.ndarray:
    """The 16-bit ids of a container, in order."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(ids, np.uint8), bitorder="little")) if dense else np.frombuffer(ids, np.uint16).astype(np.int64)


def packed(ids: np.ndarray) -> tuple[bool, bytes]:
    """(dense, bytes) of the container of 16-bit ids in order."""
    if len(ids) < DENSE:
        return False, ids.astype(np.uint16).tobytes()
    bits = np.zeros(1 << 16, np.uint8)
    bits[ids] = 1
    return True, np.packbits(bits, bitorder="little").tobytes()


def merge_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CONTAINER rows sorted by term and block to one row for each term and block."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        name, block = coded.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        change = np.flatnonzero((name[1:] != name[:-1]) | (block[1:] != block[:-1])) + 1
        last = int(change[-1]) if len(change) else 0
        # The last group may go on in the next batch.
        held = batch.slice(last)
        if last:
            yield _merged(batch.slice(0, last), np.r_[0, change[:-1]])
    if held is not None:
        yield _merged(held, np.zeros(1, np.int64))


def _merged(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    parts = [unpacked(d, i) for d, i in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    sizes = np.array([len(p) for p in parts])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, batch.num_rows]))
    counts = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32)
    _, ends, ids, counters = _grouped(np.repeat(group, sizes), np.concatenate(parts), counts)
    pieces = [packed(x) for x in np.split(ids.astype(np.int64), ends[:-1])]
    first = batch.take(pa.array(starts))
    return pa.RecordBatch.from_arrays(
        [first.column(0), first.column(1), pa.array([p[0] for p in pieces]), pa.array([p[1] for p in pieces], pa.binary()), _binary(counters, ends)], _NAMES
    )


def term_bitmaps(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """CONTAINER rows of all terms, one for each term and block; those without a term hold the records
    themselves, with terms or not. A record's terms are those of all its deliveries, a term's
    occurrences the most that one of them has. Rows with a null key or text are left out."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0)).alias("terms")).dropna()
    parts = rows.mapInArrow(build_containers, CONTAINER)
    return parts.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(merge_containers, CONTAINER)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counters = batch.column(1).to_pylist()
        n = [len(c) // 4 for c in counters]
        total = [int(np.frombuffer(c, np.uint32).sum(dtype=np.int64)) for c in counters]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.int64())], ["term", "df", "occurrences"])


def cardinality(bitmaps: DataFrame) -> DataFrame:
    """(term, occurrences, df) of the containers; a counter stands for each id."""
    sums = bitmaps.select("term", "counters").mapInArrow(_sums, "term string, df long, occurrences long")
    return sums.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("df").alias("df"))


def term_frequencies(df: DataFrame, key: str = "chunk_id", text: str = "text", rare_below: int = 3, common_share: float = 0.25) -> DataFrame:
    """(term, occurrences, df, mark): every term with its occurrences, its number of records and
    the mark 'rare' (df < rare_below), 'common' (df > common_share of the records) or null.

    The number of records is counted over all records with a text, terms or not. An empty table,
    or one of null texts only, has no rows."""
    freq = cut(cardinality(term_bitmaps(df, key, text)), "term-frequencies")
    total = freq.where("term IS NULL").select(F.col("df").alias("n_records"))  # one row
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") > F.col("n_records") * common_share, "common")
    return freq.where("term IS NOT NULL").join(F.broadcast(total)).withColumn("mark", mark).drop("n_records")


def term_marks(df: DataFrame, key: str = "chunk_id", text: str = "text", rare_below: int = 3, common_share: float = 0.25) -> DataFrame:
    """(term, mark) of the terms that are too rare or too common, see term_frequencies."""
    return term_frequencies(df, key, text, rare_below, common_share).where("mark IS NOT NULL").select("term", "mark")
