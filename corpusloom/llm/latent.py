"""Distributed randomised truncated SVD of sparse rows, in groups.

Rows are (grp, idx, val): a sparse vector of features of its group. The range finder of Halko,
Martinsson and Tropp needs only products A'(A W) with a thin matrix W. Each partition adds up its
own product in dense blocks, the partial sums are added block by block, and only the features x
rank result reaches the driver. The number of features is bounded by the caller (a fixed
vocabulary, or words in at least a given share of the documents); the number of rows is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128
BATCH = 1024


def csr(idx: pa.Array, val: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of list columns."""
    lengths = np.diff(idx.offsets.to_numpy())
    return np.repeat(np.arange(len(idx)), lengths), idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)


#: Up to this many features a piece of rows is multiplied as a dense matrix, which is faster then.
DENSE_WIDTH = 4096


def times(row: np.ndarray, col: np.ndarray, val: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, product): the sparse rows times a matrix, for rows that have entries. Entries are in row
    order, one for each row and column."""
    starts = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros((0, m.shape[1]), m.dtype)
    if len(m) <= DENSE_WIDTH:
        dense = np.zeros((len(starts), len(m)), m.dtype)
        dense[np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)])), col] = val
        return row[starts], dense @ m
    return row[starts], by_column(m, col, val, starts)


def by_column(m: np.ndarray, col: np.ndarray, val: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows col of m, times val, over the runs that begin at starts: one column after the
    other, which is many times as fast as whole rows."""
    out = np.empty((len(starts), m.shape[1]), m.dtype)
    for j, column in enumerate(np.ascontiguousarray(m.T)):
        part = column[col]
        out[:, j] = np.add.reduceat(part if val is None else part * val, starts)
    return out


def pieces(row: np.ndarray, n: int) -> Iterator[slice]:
    """Slices of the entries of BATCH rows at a time."""
    bounds = np.searchsorted(row, np.arange(0, n + BATCH, BATCH))
    yield from (slice(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b > a)


def _partials(mats: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: np.zeros((m.shape[0], m.shape[1] + 1)) for g, m in mats.items()}
        counts = dict.fromkeys(mats, 0)
        for batch in batches:
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                if int(g) not in mats:
                    continue
                part = batch.filter(pa.array(groups == g))
                m, acc = mats[int(g)], sums[int(g)]
                row, col, val = csr(part.column("idx"), part.column("val"))
                for piece in pieces(row, part.num_rows):
                    r, c, v = row[piece], col[piece], val[piece]
                    rows, y = times(r, c, v, m)
                    at = np.searchsorted(rows, r)
                    if len(m) <= DENSE_WIDTH:
                        dense = np.zeros((len(rows), len(m)), np.float32)
                        dense[at, c] = v
                        acc[:, :-1] += dense.T @ y
                        continue
                    order = np.argsort(c, kind="stable")
                    starts = np.flatnonzero(np.diff(c[order], prepend=-1))
                    acc[c[order][starts], :-1] += by_column(y, at[order], v[order], starts)
                acc[:, -1] += np.bincount(col, val, minlength=len(acc))
                counts[int(g)] += part.num_rows
        rows = [(g, k // BLOCK, counts[g] if k == 0 else 0, acc[k : k + BLOCK].tobytes()) for g, acc in sums.items() if counts[g] for k in range(0, len(acc), BLOCK)]
        yield block_rows(rows)

    return run


def block_rows(rows: list[tuple]) -> pa.RecordBatch:
    """(grp, block, n, data) as Arrow."""
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["grp", "block", "n", "data"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the partial blocks of each (grp, block), one pass, one block in memory for each."""
    sums: dict[tuple[int, int], list] = {}
    for batch in batches:
        for g, k, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(data, np.float64)
            if (g, k) in sums:
                sums[g, k][0] += n
                sums[g, k][1] += part
            else:
                sums[g, k] = [n, part.copy()]
    yield block_rows([(g, k, n, a.tobytes()) for (g, k), (n, a) in sums.items()])


SCHEMA = "grp int, block int, n long, data binary"


def add_up(partials: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """group -> (rows, flat sum of its blocks in order) of SCHEMA rows, added in the cluster."""
    rows = partials.repartition(F.col("grp"), F.col("block")).mapInArrow(_add_blocks, SCHEMA).collect()
    out: dict[int, tuple[int, np.ndarray]] = {}
    for g in {r["grp"] for r in rows}:
        mine = sorted((r for r in rows if r["grp"] == g), key=lambda r: r["block"])
        out[g] = (sum(r["n"] for r in mine), np.concatenate([np.frombuffer(r["data"], np.float64) for r in mine]))
    return out


def product(rows: DataFrame, mats: dict[int, np.ndarray]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """group -> (n rows, A'(A W), column sums)."""
    small = {g: m.astype(np.float32) for g, m in mats.items()}
    sums = add_up(rows.select("grp", "idx", "val").mapInArrow(_partials(small), SCHEMA))
    out = {}
    for g, (n, flat) in sums.items():
        both = flat.reshape(-1, mats[g].shape[1] + 1)
        out[g] = (n, both[:, :-1], both[:, -1])
    return out


def truncated_svd(rows: DataFrame, widths: dict[int, int], rank: int, iterations: int = 3, centred: bool = False, seed: int = 7) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """group -> (right singular vectors as columns, singular values), `rank` of them at most.
    With centred, of the rows minus their mean, whose effect on the product is subtracted.
    Groups without rows are missing from the result."""
    rng = np.random.default_rng(seed)
    mats = {g: rng.standard_normal((w, min(w, rank + 8))) for g, w in widths.items() if w}
    got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for step in range(iterations + 1):
        mats = {g: np.linalg.qr(m)[0] for g, m in mats.items()}
        done = product(rows, mats)
        for g in list(mats):
            if g not in done:
                del mats[g]
                continue
            n, y, total = done[g]
            if centred and n:
                y = y - np.outer(total / n, total @ mats[g])
            if step == iterations:
                # Rayleigh-Ritz in the subspace: W'A'AW is small and symmetric.
                values, inner = np.linalg.eigh(mats[g].T @ y)
                order = np.argsort(-values)[:rank]
                got[g] = (mats[g] @ inner[:, order], np.sqrt(np.maximum(values[order], 0)))
            else:
                mats[g] = y
    return got
