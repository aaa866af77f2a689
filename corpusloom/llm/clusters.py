"""Grouping vectors into similarity clusters by hierarchical density clustering.

1. Smoothing. In many dimensions single vectors of a group are barely nearer to each other than
   to strangers; the means of their nearest ones are. A pass sorts the vectors by a tree of the
   hash-prefix forest and replaces each vector's smoothed form by the mean of the smoothed forms
   in its window that its own vector is nearest to. The first passes (PASSES) sort by the vectors
   themselves: there a vector that was smoothed into the wrong company meets the right one
   again. The last sorts by the smoothed forms, whose windows hold one group each.
2. Neighbour graph. Further trees over the smoothed vectors give core distances and the lightest
   edges of mutual reachability; every row of a window is compared. Of a cell's edges only a
   minimum spanning forest leaves it.
3. Spanning tree. Boruvka rounds over all those edges, in the cluster; what remains has fewer edges
   than there are vectors.
4. Condensed hierarchy. The tree is cut at LEVELS distances, spaced evenly in the logarithm of
   density; parts below the smallest cluster size fall off as noise; of nested clusters the most
   stable are selected.
5. Members are the vectors of a selected cluster, as the hierarchy has them; exemplars are those
   that stay longest in it, those of the smallest core distance.

Nothing here depends on the number of partitions or on the order of rows, so two runs have the same
clusters. The smallest cluster, the windows and the levels are the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.boruvka import components, contracted, spanning_forest, spanning_tree
from corpusloom.llm.forest import CELL_BITS, Forest, binary_column, blocks, code_matrix, from_codes, matrix, rows_by_dim, sorted_trees, stretches, to_codes
from corpusloom.session import cut

SMOOTHED = "id long, dim int, code binary"
#: (what a pass sorts by, rows on either side of the window, vectors in a mean).
PASSES = (("own", 256, 16), ("own", 256, 4), ("own", 1024, 4), ("smoothed", 256, 16))
#: Trees of the neighbour graph.
TREES = 2
#: Part of the usual fit below which a vector is taken for a stray.
STRAY = 0.5
#: How many times as far as a near one a neighbour may be and still count as of the same company.
JUMP = 2.0
#: The hierarchy is cut at LEVELS distances from FINEST to 1; below FINEST nothing is told apart.
FINEST, LEVELS = 0.01, 24
#: Tree edges of a dimension up to this number are condensed in one task, 24 bytes each; more level
#: by level in the cluster, with the same result.
TASK_EDGES = 2_000_000
GRAPH = "id long, other long, w double"


def coded(vectors: DataFrame) -> DataFrame:
    """(id, dim, code): byte vectors of (id, dim, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("dim"), binary_column(to_codes(matrix(part.column("vec"), int(d))))], ["id", "dim", "code"])

    return vectors.select("id", "dim", "vec").mapInArrow(run, SMOOTHED)


def halves(codes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed, own) unit vectors of codes; before the first pass both are the vector itself."""
    return from_codes(codes[:, :dim]), from_codes(codes[:, -dim:])


def smoothed(window: int, nearest: int):
    """Arrow map from one sorted tree to codes of (smoothed, own) vectors. Of the `nearest` rows of a
    window those count that are not JUMP times as far as the fourth, so a group smaller than
    `nearest` does not take strangers in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, _, ids, _, codes, lo, hi in stretches(batches, window):
            dim = cell >> CELL_BITS + 6
            y, x = halves(codes, dim)
            out = np.empty((hi - lo, x.shape[1]), np.float32)
            for s, e, columns, cos in blocks(y, lo, hi, window, left=x):
                k = min(nearest, cos.shape[1])
                top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                far = 1 - np.take_along_axis(cos, top, 1)
                good = (far < 3) & (far <= np.maximum(JUMP * np.partition(far, min(3, k - 1), axis=1)[:, min(3, k - 1), None], 0.02))
                mean = np.matmul(good[:, None, :].astype(np.float32), y[columns[top]])[:, 0]
                out[s - lo : e - lo] = np.where(good.any(1)[:, None], mean, y[s:e])
            both = np.hstack([to_codes(out), codes[lo:hi, -dim:]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(np.full(hi - lo, dim, np.int32)), binary_column(both)], ["id", "dim", "code"])

    return run


def typical_fit(table: DataFrame) -> dict[int, float]:
    """For each dimension the median cosine of own and smoothed vectors over all rows: the smallest
    that at least half of them do not exceed. The cosines' bits, as integers of the same order,
    are counted by their upper half, then those of the median's upper half by their lower one;
    what returns are at most 2^16 counts a dimension, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                y, x = halves(code_matrix(batch.filter(pa.array(dims == d)).column("code")), int(d))
                bits = (x * y).sum(1).astype(np.float32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), d, np.int32)), pa.array(in_order(bits))], ["dim", "place"])

    places = cut(table.select("dim", "code").mapInArrow(run, "dim int, place int"), "fits")
    upper, lower = F.shiftright("place", 16), F.col("place").bitwiseAND(0xFFFF)
    high = {d: at_rank(c, (sum(c.values()) + 1) // 2) for d, c in _counts(places, upper).items()}
    if not high:
        return {}
    middle = F.lit(False)
    for d, (half, _) in high.items():
        middle = middle | ((F.col("dim") == d) & (upper == half))
    out = {}
    for d, c in _counts(places.where(middle), lower).items():
        half, rank = high[d]
        place = np.array([half << 16 | at_rank(c, rank)[0]], np.int32)
        out[d] = float(in_order(place).view(np.float32)[0])
    return out


def in_order(bits: np.ndarray) -> np.ndarray:
    """The bits of 32-bit floats as integers of the same order; applied again, the bits."""
    return bits ^ (bits >> 31 & 0x7FFFFFFF)


def _counts(places: DataFrame, part: Column) -> dict[int, dict[int, int]]:
    """dim -> value of `part` -> number of rows."""
    out: dict[int, dict[int, int]] = {}
    for r in places.groupBy("dim", part.alias("part")).count().collect():
        out.setdefault(r["dim"], {})[r["part"]] = r["count"]
    return out


def at_rank(counts: dict[int, int], rank: int) -> tuple[int, int]:
    """The value at a rank, from 1, of counted values, and the rank among those equal to it."""
    for value in sorted(counts):
        if rank <= counts[value]:
            return value, rank
        rank -= counts[value]
    raise ValueError("rank beyond the counts")


def reachability_graph(window: int, core: int, near: int, edges: int, fit: dict[int, float]):
    """Arrow map from sorted trees to GRAPH rows. A row without other is a vector with its core
    distance in w: the distance of the core-th nearest in the window, but no more than JUMP
    times that of the near-th, so that a group of fewer than `core` vectors is as dense as it is.
    A vector much further from its smoothed form than is usual (`fit`) is a stray that was
    smoothed into company; its core distance is raised by as much, so that strays do not
    bridge groups. A row with other is an edge: of each row the `edges` lightest are formed, and
    of those of a stretch a minimum spanning forest is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, _, ids, _, codes, lo, hi in stretches(batches, window):
            dim = cell >> CELL_BITS + 6
            x, own = halves(codes, dim)
            n, far = len(ids), np.full(len(ids), 2.0)
            for s, e, _, cos in blocks(x, 0, n, window):
                c, m = min(core, cos.shape[1]) - 1, min(near, cos.shape[1]) - 1
                part = 1 - np.maximum(-np.partition(-cos, sorted({c, m}), axis=1)[:, [c, m]], -1)
                far[s:e] = np.minimum(part[:, 0], np.maximum(JUMP * part[:, 1], 1e-3))
            own_fit = (own * x).sum(1) / max(fit[dim], 1e-6)
            far = np.where(own_fit < STRAY, np.maximum(far, 1 - own_fit), far)
            ends, weights = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
            for s, e, columns, cos in blocks(x, 0, n, window):
                reach = np.maximum(np.maximum(1 - cos, far[s:e, None]), far[columns][None, :])
                reach[cos <= -2] = 9
                k = min(edges, cos.shape[1])
                top = np.argpartition(reach, k - 1, axis=1)[:, :k]
                w = np.take_along_axis(reach, top, 1)
                i, j = np.nonzero(w < 9)
                ends.append(np.stack([i + s, columns[top[i, j]]], 1))
                weights.append(w[i, j])
            ab, w = np.concatenate(ends), np.maximum(np.concatenate(weights), 0)
            pick = spanning_forest(n, ab[:, 0], ab[:, 1], w)
            yield _graph_rows(ids[lo:hi], None, far[lo:hi])
            yield _graph_rows(ids[ab[pick, 0]], ids[ab[pick, 1]], w[pick])

    return run


def _graph_rows(ids: np.ndarray, other: np.ndarray | None, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()) if other is None else pa.array(other), pa.array(w)], ["id", "other", "w"])


def levels(finest: float = FINEST, number: int = LEVELS) -> list[float]:
    """Distances at which the hierarchy is cut, evenly spaced in their logarithm, up to 1."""
    return np.geomspace(finest, 1.0, number).tolist()


def condensed(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, cuts: list[float], least: int) -> np.ndarray:
    """The smallest member of each node's cluster, or -1, from a spanning forest in one task.

    At every cut the parts of at least `least` nodes live. A part with one living part inside
    continues its cluster; with none it begins one; with several these end as clusters and a
    parent begins. A cluster's stability is its size integrated over the logarithm of density,
    from the cut where it begins to that where it ends. From the finest cut up a parent stands in
    place of the clusters inside where it is more stable than they are together. The root of a
    tree that was split never stands. Members are all nodes of the part when its cluster ends."""
    chain, part = [], np.arange(n)
    for cut_at in cuts:
        inside = w <= cut_at
        part = components(n, part[a[inside]], part[b[inside]])[part]
        chain.append(part)
    stands: list[np.ndarray] = []
    own, inner, live = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for i, part in enumerate(chain):
        size = np.bincount(part, minlength=n)
        new_own, new_inner, stand = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        if i:
            old = np.flatnonzero(live)
            up = part[old]
            single = np.bincount(up, minlength=n)[up] == 1
            new_own[up[single]], new_inner[up[single]] = own[old[single]], inner[old[single]]
            ended = old[~single]
            np.add.at(new_inner, part[ended], np.maximum(own, inner)[ended])
            stand[ended] = own[ended] >= inner[ended]
            stands.append(stand)
        live = (size >= least) & (size > 0)
        if i + 1 < len(cuts):
            new_own[live] += size[live] * np.log(cuts[i + 1] / cuts[i])
        own, inner = new_own, new_inner
    stands.append(live & (inner == 0))
    out = np.full(n, -1)
    for part, stand in zip(reversed(chain), reversed(stands), strict=True):
        out = np.where((out < 0) & stand[part], part, out)
    return out


def condensed_in_task(tree: DataFrame, dims: DataFrame, cuts: list[float], least: int) -> DataFrame:
    """(id, dim, cluster) by `condensed`, a task a dimension. dims is (id, dim)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([rows["a"], rows["b"]]))
        a, b = np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"])
        label = condensed(len(ids), a, b, rows["w"].to_numpy(), cuts, least)
        keep = label >= 0
        return pd.DataFrame({"id": ids[keep], "dim": np.int32(rows["dim"].iloc[0]), "cluster": ids[label[keep]]})

    edges = tree.join(dims.select(F.col("id").alias("a"), "dim"), "a")
    return edges.groupBy("dim").applyInPandas(run, "id long, dim int, cluster long")


def condensed_in_cluster(tree: DataFrame, dims: DataFrame, cuts: list[float], least: int) -> DataFrame:
    """(id, dim, cluster): the same as `condensed`, level by level in the cluster. Parts carry the
    name of their smallest member. Each level reads the parts of the last one."""
    size = dims.select(F.col("id").alias("part"), F.lit(1).cast("long").alias("size"))
    state = dims.where("false").select(F.col("id").alias("part"), F.lit(0.0).alias("own"), F.lit(0.0).alias("inner"))
    ups, stands, rest = [], [], tree
    for i, cut_at in enumerate(cuts):
        member, rest = contracted(rest, cut_at)
        joined = size.join(member.select(F.col("node").alias("part"), "root"), "part", "left").withColumn("root", F.coalesce("root", "part"))
        # The contraction names a part by any of its members; here it is the smallest.
        named = joined.groupBy("root").agg(F.min("part").alias("up"))
        up = cut(joined.join(named, "root").select("part", "root", "up", "size"), "up")
        ups.append(up.select("part", "up"))
        rest = _ends_renamed(rest, up.where("part = root").select(F.col("root").alias("node"), "up"))
        size = up.groupBy(F.col("up").alias("part")).agg(F.sum("size").alias("size"))
        old = state.join(up.select("part", "up"), "part")
        many = old.groupBy("up").agg(F.count(F.lit(1)).alias("parts"))
        old = cut(old.join(many, "up"), "old")
        if i:
            stands.append(old.where("parts > 1 AND own >= inner").select("part"))
        carried = old.groupBy(F.col("up").alias("part")).agg(
            F.sum(F.when(F.col("parts") == 1, F.col("own")).otherwise(0.0)).alias("own"),
            F.sum(F.when(F.col("parts") == 1, F.col("inner")).otherwise(F.greatest("own", "inner"))).alias("inner"),
        )
        gain = float(np.log(cuts[i + 1] / cuts[i])) if i + 1 < len(cuts) else 0.0
        live = size.where(F.col("size") >= least).join(carried, "part", "left").fillna(0.0, ["own", "inner"])
        state = cut(live.select("part", (F.col("own") + F.col("size") * gain).alias("own"), "inner"), "state")
    stands.append(state.where("inner = 0").select("part"))
    label: DataFrame | None = None
    for i in range(len(cuts) - 1, -1, -1):
        # ups[i] leads from the parts before cut i to those after it; a label is that of a part after it.
        mine = stands[i].select(F.col("part").alias("up"), F.col("part").alias("cluster"))
        after = ups[i].select("up").distinct()
        above = mine if label is None else label
        both = after.join(above.select("up", F.col("cluster").alias("high")), "up", "left").join(mine, "up", "left")
        now = both.select("up", F.coalesce("high", "cluster").alias("cluster")).where("cluster IS NOT NULL")
        label = cut(ups[i].join(now, "up").select(F.col("part").alias("up"), "cluster"), "label")
    return label.select(F.col("up").alias("id"), "cluster").join(dims, "id").select("id", "dim", "cluster")


def _ends_renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(names.select(F.col("node").alias(end), "up"), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
    return cut(edges, "rest")


def density_clusters(
    vectors: DataFrame,
    passes: tuple = PASSES,
    window: int = 256,
    core: int = 32,
    near: int = 8,
    edges: int = 4,
    least: int = 8,
    seed: int = 5,
    task_edges: int = TASK_EDGES,
) -> tuple[DataFrame, DataFrame]:
    """(members, cores): members is (id, dim, cluster) of every vector that belongs to a cluster, which
    is named after its smallest member; cores is (id, core) with the core distance of every
    vector. `vectors` is (id, dim, vec). A cluster has at least `least` members at every size of
    the table. An empty table has no rows."""
    raw = cut(coded(vectors), "codes")
    table, counts = raw, rows_by_dim(raw)
    by_own = Forest.fit(raw, sum(p[0] == "own" for p in passes), seed, "code", np.int8, counts)
    by_smoothed, own_no, smoothed_no = None, 0, 0
    total = sum(p[0] != "own" for p in passes) + TREES
    for order, width, nearest in passes:
        own = order == "own"
        if own:
            forest, own_no = by_own.some(own_no, 1), own_no + 1
        else:
            by_smoothed = by_smoothed or Forest.fit(table, total, seed + 1, "code", np.int8, counts)
            forest, smoothed_no = by_smoothed.some(smoothed_no, 1), smoothed_no + 1
        table = cut(sorted_trees(table, forest, codes=True, own=own).mapInArrow(smoothed(width, nearest), SMOOTHED), "smoothed")
    by_smoothed = by_smoothed or Forest.fit(table, total, seed + 1, "code", np.int8, counts)
    fit = typical_fit(table)
    trees = sorted_trees(table, by_smoothed.some(smoothed_no, TREES), codes=True)
    graph = cut(trees.mapInArrow(reachability_graph(window, core, near, edges, fit), GRAPH), "graph")
    cores = graph.where("other IS NULL").groupBy("id").agg(F.min("w").alias("core"))
    tree = spanning_tree(graph.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"), "w"))
    dims = raw.select("id", "dim")
    condense = condensed_in_task if max(counts.values(), default=0) <= task_edges else condensed_in_cluster
    return cut(condense(tree, dims, levels(), least), "members"), cores


def same_cluster(members: DataFrame, probes: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b) of the probes whose two chunks are members of one cluster. Null
    ids and repeated probes have no further rows."""
    one = members.select(F.col("id").alias("chunk_id_a"), F.col("cluster").alias("ca"))
    two = members.select(F.col("id").alias("chunk_id_b"), F.col("cluster").alias("cb"))
    rows = probes.select("chunk_id_a", "chunk_id_b").dropna().distinct()
    return rows.join(one, "chunk_id_a").join(two, "chunk_id_b").where("ca = cb").select("chunk_id_a", "chunk_id_b")


def described(members: DataFrame, cores: DataFrame, exemplars: int = 3) -> DataFrame:
    """(cluster, dim, size, exemplars): members of each cluster, and the ids of those that persist
    longest (smallest core distance, then smallest id). The ranking is limited before its shuffle."""
    sizes = members.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("size"))
    inner = members.select("id", "cluster").join(cores, "id")
    rank = F.row_number().over(W.partitionBy("cluster").orderBy("core", "id"))
    top = inner.withColumn("rank", rank).where(F.col("rank") <= exemplars)
    listed = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("exemplars"))
    return sizes.join(listed, "cluster", "left")
