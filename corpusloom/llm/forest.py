"""Hash-prefix forest over vectors.

Each tree hashes a vector to a long bit string: the signs of projections on random directions,
drawn with the covariance of the data so that bits tell apart what the data tells apart, and
thresholded at the sample median so that every bit halves the data. The sorted array of a tree's
strings is the tree: a row descends to the rows that share the longest prefix with it, and ascends
to shorter prefixes for more.

The trees are ascended in step: a row's `level` is the longest prefix at which all its trees
together offer enough candidates. Levels come from counts of short prefixes, a table of
trees x 2^DEPTH numbers whatever the number of rows; below DEPTH bits the order of the sorted array
itself goes by the longest prefix.

In Spark a tree's sorted array is cut into cells at (string, id) bounds, quantiles of the rows that
the forest was fitted on. So a dense region, even a run of equal strings, spreads over as many cells
as it needs, and cells depend neither on the number of partitions nor on Spark's own sampling; a
cell is read as a stream. Directions are fitted on at most FIT_ROWS vectors a dimension, chosen by
the hash of their id; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import latent

FIT_ROWS = 20_000
BITS = 62
ROWS = 16_384
#: Rows of a cell of a sorted array, while the fitted sample is large enough to cut so finely.
CELL_ROWS = 16_384
#: Bits of the prefixes that are counted.
DEPTH = 12
#: Bits of a cell number below the tree's number.
CELL_BITS = 20


def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, vector) to (id, dim, vec): unit vectors as float32 bytes. Vectors that are null,
    of another length, with null or non-finite elements, or all zero are left out."""
    for batch in batches:
        ids, dims, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2)
        out: tuple[list, list, list] = ([], [], [])
        for i, d in enumerate(dims):
            x = column[i].values
            if x is None or d is None or len(x) != d or x.null_count:
                continue
            v = x.to_numpy().astype(np.float64)
            top = np.abs(v).max(initial=0.0)
            if not np.isfinite(top) or top == 0:
                continue
            v = v / top
            for c, y in zip(out, (ids[i], d, (v / np.sqrt(v @ v)).astype(np.float32).tobytes()), strict=True):
                c.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["id", "dim", "vec"])


def usable_vectors(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """(id, dim, vec) of the current vector of each chunk: the row with the latest embedded_at, a
    null time before all others; of equal times the greater vector. Whether the vector is usable
    is asked of the current row alone. Chunks of catalogs without dim have no row."""
    dims = meta.groupBy("catalog_id").agg(F.max("dim").alias("dim"))
    rows = vectors.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max_by(F.struct("catalog_id", "vector"), F.struct("embedded_at", "vector")).alias("x"))
    rows = rows.select(F.col("chunk_id").alias("id"), "x.catalog_id", "x.vector").join(dims, "catalog_id").select("id", "dim", "vector")
    return rows.mapInArrow(usable, "id long, dim int, vec binary")


def matrix(column: pa.Array, dim: int, kind: type = np.float32) -> np.ndarray:
    """Rows of a binary column as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def code_matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long byte vectors as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1)


def to_codes(x: np.ndarray) -> np.ndarray:
    """Vectors as signed bytes, scaled to their greatest element."""
    return np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-12))).astype(np.int8)


def from_codes(c: np.ndarray) -> np.ndarray:
    """Unit vectors from bytes."""
    x = c.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def binary_column(rows: np.ndarray) -> pa.Array:
    """A matrix's rows as a binary column, without a Python object for each."""
    n, width = len(rows), rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


class Forest:
    """Directions, thresholds and cell bounds of the trees of one collection, by dimension."""

    def __init__(self, parts: dict[int, list[tuple]]) -> None:
        self.parts = parts

    @classmethod
    def fit(cls, vectors: DataFrame, trees: int, seed: int, column: str = "vec", kind: type = np.float32, counts: dict[int, int] | None = None, own: bool = False) -> Forest:
        """Fit on rows chosen by the hash of their id, at most about FIT_ROWS a dimension; with `own` on
        the last part of a code, else on the first. `counts` are the rows of each dimension, where
        they are known already."""
        counts = counts or rows_by_dim(vectors)
        keep = F.lit(False)
        for d, n in counts.items():
            step = max(1, -(-n // FIT_ROWS))
            keep = keep | ((F.col("dim") == d) & (F.pmod(F.xxhash64("id"), F.lit(step)) == 0))
        sample: dict[int, list[tuple]] = {}
        for r in vectors.where(keep).select("dim", "id", column).collect():
            sample.setdefault(r["dim"], []).append((r["id"], bytes(r[column])))
        rng, parts = np.random.default_rng(seed), {}
        for d in sorted(sample):
            rows = sorted(sample[d])
            ids = np.array([r[0] for r in rows])
            x = np.frombuffer(b"".join(r[1] for r in rows), kind).reshape(len(rows), -1)
            x = x[:, -d:] if own else x[:, :d]
            x = from_codes(x) if kind is np.int8 else x
            values, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(d))
            spread = axes * np.sqrt(np.maximum(values, 1e-9))
            cells = int(min(max(1, counts[d] // CELL_ROWS), max(1, len(x) // 20), 1 << CELL_BITS))
            parts[d] = []
            for _ in range(trees):
                planes = (spread @ rng.standard_normal((d, BITS))).astype(np.float32)
                limits = np.median(x @ planes, axis=0).astype(np.float32)
                key = strings(x, planes, limits)
                order = np.lexsort((ids, key))
                at = order[(np.arange(1, cells) * len(x)) // cells]
                parts[d].append((planes, limits, key[at], ids[at]))
        return cls(parts)

    def some(self, first: int, count: int) -> Forest:
        """A forest of `count` of the trees, from number `first`."""
        return Forest({d: trees[first : first + count] for d, trees in self.parts.items()})

    def keys(self, x: np.ndarray, dim: int) -> list[np.ndarray]:
        """For each tree the bit strings of the rows, as non-negative 64-bit integers."""
        return [strings(x, planes, limits) for planes, limits, *_ in self.parts[dim]]

    def cells(self, tree: int, dim: int, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Number of each row's cell in the sorted array of a tree."""
        _, _, bound, bound_id = self.parts[dim][tree]
        out = np.searchsorted(bound, key, "left")
        for k in np.unique(bound[np.isin(bound, key)]):
            mine, run = key == k, bound_id[bound == k]
            out[mine] += np.searchsorted(run, ids[mine], "right")
        return out


def strings(x: np.ndarray, planes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bit strings of rows as non-negative 64-bit integers."""
    return ((x @ planes) > limits).astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def rows_by_dim(vectors: DataFrame) -> dict[int, int]:
    """Number of rows of each dimension."""
    return {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}


TREE_ROWS = "cell long, key long, id long, level int, code binary"


def prefix_counts(vectors: DataFrame, forest: Forest) -> dict[int, np.ndarray]:
    """dim -> (trees, 2^DEPTH) numbers of rows with each prefix. Counts are added up in the cluster;
    what returns has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((len(t), 1 << DEPTH)) for d, t in forest.parts.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                x = from_codes(to_codes(matrix(batch.filter(pa.array(dims == d)).column("vec"), int(d))))
                for t, (planes, limits, *_) in enumerate(forest.parts[int(d)]):
                    short = ((x @ planes[:, :DEPTH]) > limits[:DEPTH]) @ (1 << np.arange(DEPTH - 1, -1, -1))
                    sums[int(d)][t] += np.bincount(short, minlength=1 << DEPTH)
        yield latent.block_rows([(d, t, 0, row.tobytes()) for d, a in sums.items() for t, row in enumerate(a) if row.any()])

    added = latent.add_up(vectors.select("id", "dim", "vec").mapInArrow(run, latent.SCHEMA))
    return {d: flat.reshape(-1, 1 << DEPTH) for d, (_, flat) in added.items()}


def levels_in_step(counts: np.ndarray, keys: list[np.ndarray], enough: float) -> np.ndarray:
    """For each row the longest prefix, of DEPTH bits at most, at which its trees together hold at
    least `enough` rows; 0 where the whole collection is smaller."""
    out = np.zeros(len(keys[0]), np.int32)
    done = np.zeros(len(keys[0]), bool)
    for level in range(DEPTH, 0, -1):
        at = counts.reshape(len(keys), 1 << level, -1).sum(2)
        total = sum(at[t][key >> (BITS - level)] for t, key in enumerate(keys))
        now = ~done & (total >= enough)
        out[now], done = level, done | now
    return out


def tree_rows(forest: Forest, codes: bool = False, own: bool = False, counts: dict[int, np.ndarray] | None = None, enough: float = 0.0):
    """Arrow map (id, dim, vec or code) to TREE_ROWS, one row a tree; cell = (dim * 64 + tree) <<
    CELL_BITS | number. A code may hold two vectors; the first is hashed, with `own` the last. The
    level is that of the ascent in step where counts are given, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                code = code_matrix(part.column(2)) if codes else to_codes(matrix(part.column(2), int(d)))
                ids = part.column("id").to_numpy(zero_copy_only=False)
                keys = forest.keys(from_codes(code[:, -d:] if own else code[:, :d]), int(d))
                level = levels_in_step(counts[int(d)], keys, enough) if counts else np.zeros(len(ids), np.int32)
                for t, key in enumerate(keys):
                    cell = ((int(d) * 64 + t) << CELL_BITS) + forest.cells(t, int(d), key, ids)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(key), part.column("id"), pa.array(level), binary_column(code)], ["cell", "key", "id", "level", "code"])

    return run


def sorted_trees(vectors: DataFrame, forest: Forest, **how) -> DataFrame:
    """The trees' sorted arrays, a cell after the other; see tree_rows for `how`."""
    rows = vectors.select("id", "dim", "code" if how.get("codes") else "vec").mapInArrow(tree_rows(forest, **how), TREE_ROWS)
    return rows.repartition("cell").sortWithinPartitions("cell", "key", "id")


def stretches(batches: Iterator[pa.RecordBatch], window: int, rows: int = ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(cell, keys, ids, levels, codes, lo, hi): consecutive rows of one cell. Rows lo..hi are the
    centres, the others their context, so that every centre has 2 * `window` rows about it unless
    the cell has fewer. Every row is a centre once."""
    cell, held, lo = -1, [], 0

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([h[i] for h in held]) for i in range(4))

    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        for c in np.unique(cells):
            part = batch.filter(pa.array(cells == c))
            if c != cell:
                if held:
                    rows_ = joined()
                    if lo < len(rows_[0]):
                        yield cell, *rows_, lo, len(rows_[0])
                cell, held, lo = int(c), [], 0
            held.append((part.column("key").to_numpy(), part.column("id").to_numpy(), part.column("level").to_numpy(), code_matrix(part.column("code"))))
            if sum(len(h[1]) for h in held) - lo >= rows + window:
                rows_ = joined()
                hi = len(rows_[0]) - window
                yield cell, *rows_, lo, hi
                start = max(0, hi - 2 * window)
                held, lo = [tuple(r[start:] for r in rows_)], hi - start
    if held:
        rows_ = joined()
        if lo < len(rows_[0]):
            yield cell, *rows_, lo, len(rows_[0])


def blocks(x: np.ndarray, lo: int, hi: int, window: int, size: int = 256, left: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first centre, last centre, columns, cosines) of the centres against the rows of their
    windows: `window` rows on either side, and at the end of a cell as many more on the other one.
    Cosines outside a centre's window, and of a row with itself, are -2. With `left`, the centres
    are its rows and the windows those of x."""
    first = np.clip(np.arange(lo, hi) - window, 0, max(0, len(x) - 1 - 2 * window))
    for s in range(lo, hi, size):
        e = min(hi, s + size)
        a = first[s - lo : e - lo, None]
        columns = np.arange(first[s - lo], min(len(x), first[e - 1 - lo] + 2 * window + 1))
        cos = (x if left is None else left)[s:e] @ x[columns].T
        cos[(columns < a) | (columns > a + 2 * window) | (columns == np.arange(s, e)[:, None])] = -2
        yield s, e, columns, cos


PAIRS = "a long, b long, border long, after boolean, key long, id long, level int, code binary"


def prefix_pairs(window: int, bar: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow map from sorted trees to PAIRS rows. A row with a and b, a < b, is a pair whose byte
    vectors have a cosine of at least `bar` and of which one is in the other's range: the rows that
    share at least `level` bits with it, of those the `window` on either side with the longest
    common prefixes. A row with a border is one of the last rows of a cell or of the first of the
    next (`after`), for `across_borders`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda n, kind: pa.nulls(n, kind)
        names = ["a", "b", "border", "after", "key", "id", "level", "code"]
        last: tuple | None = None

        def edge(rows: tuple, border: int, after: bool) -> pa.RecordBatch:
            k, i, v, c = rows
            n = len(k)
            cols = [none(n, pa.int64()), none(n, pa.int64()), pa.array(np.full(n, border)), pa.array(np.full(n, after)), pa.array(k), pa.array(i), pa.array(v), binary_column(c)]
            return pa.RecordBatch.from_arrays(cols, names)

        for cell, keys, ids, level, codes, lo, hi in stretches(batches, window):
            rows = (keys, ids, level, codes)
            if last is None or last[0] != cell:
                if last is not None:
                    yield edge(last[1], last[0], False)
                yield edge(tuple(r[:window] for r in rows), cell - 1, True)
            last = (cell, tuple(r[-window:] for r in rows))
            pairs = _near(keys, ids, level, from_codes(codes), lo, hi, window, bar)
            n = len(pairs)
            rest = [none(n, k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *rest], names)
        if last is not None:
            yield edge(last[1], last[0], False)

    return run


def _near(keys: np.ndarray, ids: np.ndarray, level: np.ndarray, x: np.ndarray, lo: int, hi: int, window: int, bar: float, side: np.ndarray | None = None) -> np.ndarray:
    """Distinct pairs of prefix ranges; with `side`, only of rows of different sides."""
    free = (BITS - level).astype(np.int64)
    low = (keys >> free) << free
    first, after = np.searchsorted(keys, low), np.searchsorted(keys, low + (np.int64(1) << free))
    out = [np.zeros((0, 2), np.int64)]
    for s in range(lo, hi, 256):
        e = min(hi, s + 256)
        columns = np.arange(s + 1, min(len(x), e + window))
        cos = x[s:e] @ x[columns].T
        i = np.arange(s, e)[:, None]
        met = (columns > i) & (columns - i <= window) & ((columns < after[s:e, None]) | (first[columns] <= i)) & (cos >= bar)
        if side is not None:
            met &= side[s:e, None] != side[columns]
        p, q = np.nonzero(met)
        p, q = ids[p + s], ids[columns[q]]
        out.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
    return np.unique(np.concatenate(out), axis=0)


def across_borders(window: int, bar: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow map from the border rows of prefix_pairs, in order, to pairs (a, b) over the border: at
    most 2 * window rows meet at each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            borders = batch.column("border").to_numpy(zero_copy_only=False)
            for b in np.unique(borders):
                for old in [o for o in held if o != b]:
                    yield met(old, held.pop(old))
                held.setdefault(int(b), []).append(batch.filter(pa.array(borders == b)))
        for old, parts in held.items():
            yield met(old, parts)

    def met(border: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        keys, ids, level = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "level"))
        side = t.column("after").to_numpy(zero_copy_only=False)
        pairs = _near(keys, ids, level, from_codes(code_matrix(t.column("code"))), 0, len(ids), window, bar, side)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


#: Candidates within a cell: rows of the collection and, with kind 0 and before them, its queries.
CELL_MEMBERS = "cell long, salt int, kind int, key long, id long, level int, code binary"


def cell_members(forest: Forest, counts: dict[int, np.ndarray], enough: dict[int, float], query: bool):
    """Arrow map (id, dim, vec) to CELL_MEMBERS. Cells are prefixes short enough to hold about
    CELL_ROWS rows, and a fuller one is spread over salts by the rows' ids. A row goes to its
    cell in every tree; a query to all cells and salts that its range of the ascent in step,
    until `enough` rows were offered, meets."""
    bits = {d: min(DEPTH, max(0, int(np.ceil(np.log2(max(1.0, c[0].sum() / CELL_ROWS)))))) for d, c in counts.items()}
    salts = {d: np.maximum(1, np.ceil(c.reshape(len(c), 1 << bits[d], -1).sum(2) / (2 * CELL_ROWS))).astype(np.int64) for d, c in counts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in (int(x) for x in np.unique(dims) if int(x) in counts):
                part = batch.filter(pa.array(dims == d))
                ids = part.column("id").to_numpy(zero_copy_only=False)
                code = to_codes(matrix(part.column("vec"), d))
                keys = forest.keys(from_codes(code), d)
                level = levels_in_step(counts[d], keys, enough[d]) if query else np.zeros(len(ids), np.int32)
                for t, key in enumerate(keys):
                    cell, at = key >> (BITS - bits[d]), np.arange(len(ids))
                    if query:
                        width = np.int64(1) << np.maximum(bits[d] - level, 0)
                        at = np.repeat(at, width)
                        step = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
                        cell = (cell // width * width)[at] + step
                        copies = salts[d][t][cell]
                        at, cell = np.repeat(at, copies), np.repeat(cell, copies)
                        salt = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                    else:
                        salt = ids % salts[d][t][cell]
                    number = ((d * 64 + t) << CELL_BITS) + cell
                    cols = [pa.array(number), pa.array(salt.astype(np.int32)), pa.array(np.full(len(at), 0 if query else 1, np.int32)), pa.array(key[at]), pa.array(ids[at]), pa.array(level[at]), binary_column(code[at])]
                    yield pa.RecordBatch.from_arrays(cols, ["cell", "salt", "kind", "key", "id", "level", "code"])

    return run


def range_candidates(keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow map from CELL_MEMBERS, queries first in each cell and salt, to (q, other): of the rows in
    the query's range the `keep` most similar by byte vectors, equal ones by the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if best is not None:
                qi, k = np.nonzero(best[1] > -2)
                yield pa.RecordBatch.from_arrays([pa.array(best[0][1][qi]), pa.array(best[2][qi, k])], ["q", "other"])

        for batch in batches:
            cells, salts, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "salt", "kind"))
            change = np.flatnonzero((np.diff(cells) != 0) | (np.diff(salts) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, len(cells)], strict=True):
                if a == b:
                    continue
                if now != (cells[a], salts[a]):
                    yield from flush()
                    now, held, best = (cells[a], salts[a]), [], None
                key, ids, level = (batch.column(c).to_numpy(zero_copy_only=False)[a:b] for c in ("key", "id", "level"))
                x = from_codes(code_matrix(batch.column("code").slice(a, b - a)))
                if kinds[a] == 0:
                    held.append((key, ids, level, x))
                    continue
                if not held:
                    continue
                if best is None:
                    q = tuple(np.concatenate([h[i] for h in held]) for i in range(4))
                    best = (q, np.full((len(q[0]), keep), -2.0, np.float32), np.full((len(q[0]), keep), np.iinfo(np.int64).max))
                best = (best[0], *_kept(best, key, ids, x, keep))
        yield from flush()

    return run


def _kept(best: tuple, key: np.ndarray, ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The best scores and ids so far of all queries of a cell, with another batch of rows."""
    (qkey, qid, qlevel, qx), top, who = best
    free = (BITS - qlevel).astype(np.int64)
    low = (qkey >> free) << free
    high = low + (np.int64(1) << free)
    out_s, out_i = [], []
    for s in range(0, len(qid), 512):
        e = min(len(qid), s + 512)
        cos = qx[s:e] @ x.T
        cos[(key < low[s:e, None]) | (key >= high[s:e, None]) | (ids == qid[s:e, None])] = -2
        both, names = np.hstack([top[s:e], cos]), np.hstack([who[s:e], np.broadcast_to(ids, cos.shape)])
        if both.shape[1] > 4 * keep:
            bar = np.partition(both, -keep, axis=1)[:, -keep, None]
            # Ties at the bar are settled by id, so all of them are looked at.
            width = int((both >= bar).sum(1).max())
            pick = np.argpartition(-both, width - 1, axis=1)[:, :width]
            both, names = np.take_along_axis(both, pick, 1), np.take_along_axis(names, pick, 1)
        order = np.lexsort((names, -both), axis=1)[:, :keep]
        out_s.append(np.take_along_axis(both, order, 1))
        out_i.append(np.take_along_axis(names, order, 1))
    return np.concatenate(out_s), np.concatenate(out_i)
