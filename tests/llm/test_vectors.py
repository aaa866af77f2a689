import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import boruvka, clusters, forest, similar

VEC = "chunk_id long, catalog_id long, vector array<float>, embedded_at long, dim int, id string"
META = "catalog_id long, dim int, vector string"


def frames(spark, rows, dims=((1, 16), (2, 24))):
    return spark.createDataFrame(rows, VEC), spark.createDataFrame([(c, d, "clash") for c, d in dims], META)


def groups(rng, n, dim, centres, noise=0.8):
    c = rng.standard_normal((centres, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    g = rng.integers(0, centres, n)
    return g, 0.6 * c[g] + noise * rng.standard_normal((n, dim)) / np.sqrt(dim)


def brute(rows, dims, k=5, bar=0.93):
    dims, best = dict(dims), {}
    for chunk, cat, v, at, *_ in rows:
        if chunk is not None and (chunk not in best or (at if at is not None else -1) > best[chunk][0]):
            best[chunk] = (at if at is not None else -1, cat, v)
    ok = {}
    for chunk, (_, cat, v) in best.items():
        if v is None or cat not in dims or len(v) != dims[cat] or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float64)
        ok[chunk] = x / np.linalg.norm(x)
    lists = {a: sorted((-round(float(x @ y), 6), b) for b, y in ok.items() if b != a and len(y) == len(x))[:k] for a, x in ok.items()}
    return {(a, b) for a in lists for s, b in lists[a] if a < b and -s >= bar and any(q == a for _, q in lists[b])}


def dirty_rows(rng):
    rows, n = [], 0
    for cat, dim in ((1, 16), (2, 24)):
        for _ in range(120):
            v = rng.standard_normal(dim)
            for _ in range(rng.integers(1, 4)):
                rows.append((n, cat, (v + 0.08 * rng.standard_normal(dim)).astype(np.float32).tolist(), n, 0, "x"))
                n += 1
    same = rng.standard_normal(16).astype(np.float32).tolist()
    rows += [(10_000 + i, 1, same, 1, 0, "x") for i in range(120)]  # a third of the rows are one vector
    rows += [(20_000, 1, None, 1, 0, "x"), (20_001, 1, [0.0] * 16, 1, 0, "x"), (20_002, 1, [float("nan")] * 16, 1, 0, "x"), (20_003, 1, [1.0], 1, 0, "x")]
    rows += [(20_004, 9, [1.0] * 16, 1, 0, "x"), (None, 1, [1.0] * 16, 1, 0, "x"), (20_005, 1, [None] + [1.0] * 15, 1, 0, "x")]
    rows += [(20_006, 1, rows[0][2], 5, 0, "x"), (20_006, 1, None, 9, 0, "x"), (20_007, 1, [float("inf")] + [1.0] * 15, None, 0, "x"), (20_007, 1, rows[4][2], 3, 0, "x")]
    return rows + rows[:30]


def test_mutual_neighbours_against_brute_force(spark):
    rows = dirty_rows(np.random.default_rng(0))
    v, m = frames(spark, rows)
    got = {(r["a"], r["b"]) for r in similar.mutual_neighbours(similar.current_vectors(v, m)).collect()}
    assert got == brute(rows, ((1, 16), (2, 24)))


@pytest.mark.parametrize("partitions", [8, 64, 200])
def test_nearest_recall_whatever_the_partitions(spark, partitions):
    rng = np.random.default_rng(1)
    _, x = groups(rng, 12_000, 32, 12)
    v, m = frames(spark, [(i, 1, x[i].astype(np.float32).tolist(), 1, 0, "x") for i in range(len(x))], ((1, 32),))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = similar.nearest(similar.current_vectors(v, m), least=2048).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lists: dict = {}
    for r in found:
        lists.setdefault(r["id"], set()).add(r["neighbour"])
    hit = total = 0
    for q in range(0, len(x), 50):
        cos = u @ u[q]
        cos[q] = -2
        hit += len(set(np.argsort(-cos)[:5].tolist()) & lists[q])
        total += 5
    assert 0.9 <= hit / total < 1
    # The same rows are compared whatever the partitions.
    seen = test_nearest_recall_whatever_the_partitions.__dict__.setdefault("seen", lists)
    assert lists == seen


def test_levels_go_up_in_step():
    rng = np.random.default_rng(6)
    keys = [rng.integers(0, 1 << 62, 3000) for _ in range(3)]
    counts = np.array([np.bincount(k >> (62 - forest.DEPTH), minlength=1 << forest.DEPTH) for k in keys])
    got = forest.levels_in_step(counts, keys, 100)
    for i in range(0, 3000, 113):
        offered = lambda level: sum(int((k >> (62 - level) == k[i] >> (62 - level)).sum()) for k in keys) if level else 9000
        assert offered(got[i]) >= 100 and (got[i] == forest.DEPTH or offered(got[i] + 1) < 100)


def test_cells_split_equal_strings_and_borders_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELL_ROWS", 64)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((400, 16))
    x = np.vstack([base, base + 0.01 * rng.standard_normal((400, 16))])
    rows = [(i, 1, v.astype(np.float32).tolist(), 1, 0, "x") for i, v in enumerate(x)]
    v, m = frames(spark, rows, ((1, 16),))
    table = similar.current_vectors(v, m)
    f = forest.Forest.fit(table, 1, 11)
    assert len(f.parts[16][0][2]) == 800 // 64 - 1
    pairs = forest.sorted_trees(table, f).mapInArrow(forest.prefix_pairs(40, 0.99), forest.PAIRS).collect()
    inner = {(r["a"], r["b"]) for r in pairs if r["a"] is not None}
    border = spark.createDataFrame([r for r in pairs if r["border"] is not None], forest.PAIRS).repartition("border").sortWithinPartitions("border", "key", "id")
    over = {(r["a"], r["b"]) for r in border.mapInArrow(forest.across_borders(40, 0.99), "a long, b long").collect()}
    u = np.array([forest.from_codes(forest.to_codes(forest.matrix(pa.array([r["vec"]]), 16)))[0] for r in table.orderBy("id").collect()])
    key = f.keys(u, 16)[0]
    at = np.empty(800, int)
    at[np.lexsort((np.arange(800), key))] = np.arange(800)
    want = {(i, j) for i in range(800) for j in range(i + 1, 800) if abs(at[i] - at[j]) <= 40 and u[i] @ u[j] >= 0.99}
    assert inner | over == want and over - inner


def test_empty(spark):
    v, m = frames(spark, [])
    table = similar.current_vectors(v, m)
    assert similar.mutual_neighbours(table).count() == 0 and similar.nearest(table).count() == 0
    members, cores = clusters.density_clusters(similar.usable_vectors(v, m))
    assert members.count() == 0 and clusters.described(members, cores).count() == 0


def test_spanning_forest_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = 30
        a, b = rng.integers(0, n, 80), rng.integers(0, n, 80)
        w = rng.random(80).round(2)
        pick = boruvka.spanning_forest(n, a, b, w)
        top, cost, edges = list(range(n)), 0.0, 0

        def find(i, top=top):
            while top[i] != i:
                i = top[i]
            return i

        for e in np.argsort(w, kind="stable"):
            x, y = find(a[e]), find(b[e])
            if x != y:
                top[x], cost, edges = y, cost + w[e], edges + 1
        assert len(pick) == edges and w[pick].sum() == pytest.approx(cost)


def test_contraction_in_spark_matches_components(spark):
    rng = np.random.default_rng(3)
    n = 200
    a, b, w = rng.integers(0, n, 260), rng.integers(0, n, 260), rng.random(260)
    a, b, w = np.append(a, np.arange(199)[:50]), np.append(b, np.arange(1, 200)[:50]), np.append(w, np.full(50, 0.1))  # a long chain
    df = spark.createDataFrame([(int(x), int(y), float(z)) for x, y, z in zip(a, b, w)], "a long, b long, w double")
    member, rest = boruvka.contracted(df, 0.5)
    root = {r["node"]: r["root"] for r in member.collect()}
    want = boruvka.components(n, a[w <= 0.5], b[w <= 0.5])
    for i, j in itertools.combinations(range(n), 2):
        assert (root.get(i, i) == root.get(j, j)) == (want[i] == want[j])
    assert all(r["w"] > 0.5 and r["a"] != r["b"] for r in rest.collect())


def test_spanning_tree_in_spark_weighs_the_same(spark):
    rng = np.random.default_rng(8)
    n = 150
    a, b, w = rng.integers(0, n, 500), rng.integers(0, n, 500), rng.random(500).round(2)
    df = spark.createDataFrame([(int(x), int(y), float(z)) for x, y, z in zip(a, b, w)], "a long, b long, w double")
    got = boruvka.spanning_tree(df).collect()
    pick = boruvka.spanning_forest(n, a, b, w)
    assert len(got) == len(pick) and sum(r["w"] for r in got) == pytest.approx(w[pick].sum())
    assert {(min(x, y), max(x, y), z) for x, y, z in zip(a.tolist(), b.tolist(), w.tolist())} >= {(min(r[0], r[1]), max(r[0], r[1]), r[2]) for r in got}
    assert boruvka.spanning_tree(df.limit(0)).count() == 0


def test_condensed_hierarchy_splits_and_drops_noise():
    edges = [(i, i + 1, 0.1) for i in range(9)] + [(10 + i, 11 + i, 0.1) for i in range(9)] + [(9, 10, 0.5), (19, 20, 0.9), (20, 21, 0.9)]
    a, b, w = (np.array(c) for c in zip(*edges))
    label = clusters.condensed(22, a, b, w, clusters.levels(), 5)
    assert set(label[:10]) == {0} and set(label[10:20]) == {10} and set(label[20:]) == {-1}


@pytest.mark.parametrize("seed", [0, 1])
def test_condensing_in_the_cluster_gives_the_same(spark, seed):
    rng = np.random.default_rng(seed)
    n, cuts = 120, clusters.levels(0.02, 7)
    centre = rng.random((6, 2))
    x = np.vstack([centre[rng.integers(0, 6, 100)] + 0.03 * rng.standard_normal((100, 2)), rng.random((20, 2))])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    a, b = np.triu_indices(n, 1)
    pick = boruvka.spanning_forest(n, a, b, far[a, b])
    a, b, w = a[pick], b[pick], far[a[pick], b[pick]]
    want = clusters.condensed(n, a, b, w, cuts, 5)
    tree = spark.createDataFrame([(int(i) * 7, int(j) * 7, float(z)) for i, j, z in zip(a, b, w)], "a long, b long, w double")
    dims = spark.createDataFrame([(i * 7, 2) for i in range(n)], "id long, dim int")
    one = {r["id"]: r["cluster"] for r in clusters.condensed_in_task(tree, dims, cuts, 5).collect()}
    assert one == {i * 7: int(c) * 7 for i, c in enumerate(want) if c >= 0} and len(set(one.values())) > 1
    assert one == {r["id"]: r["cluster"] for r in clusters.condensed_in_cluster(tree, dims, cuts, 5).collect()}


def test_clusters_find_groups_and_are_the_same_in_two_runs(spark):
    rng = np.random.default_rng(4)
    g, x = groups(rng, 1500, 48, 6)
    stray = rng.standard_normal((60, 48))
    rows = [(i, 1, v.astype(np.float32).tolist(), 1, 0, "x") for i, v in enumerate(np.vstack([x, stray]))]
    v, m = frames(spark, rows + rows[:50], ((1, 48),))
    members, cores = clusters.density_clusters(similar.usable_vectors(v, m))
    found = {r["id"]: r["cluster"] for r in members.collect()}
    good = sum((found.get(i, -1) == found.get(j, -2)) == (g[i] == g[j]) for i, j in itertools.combinations(range(0, 1500, 7), 2))
    assert good / (215 * 214 / 2) > 0.95
    assert sum(i in found for i in range(1500, 1560)) < 30
    table = clusters.described(members, cores).collect()
    assert sum(r["size"] for r in table) == len(found) and all(1 <= len(r["exemplars"]) <= 3 for r in table)
    probes = spark.createDataFrame([(0, 1, "x"), (0, 1, "x"), (None, 3, "x"), (0, 99_999, "x")], "chunk_id_a long, chunk_id_b long, cluster string")
    assert clusters.same_cluster(members, probes).count() == int(0 in found and found.get(0) == found.get(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        again, _ = clusters.density_clusters(similar.usable_vectors(v.repartition(13), m))
        assert found == {r["id"]: r["cluster"] for r in again.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_small_groups_stay_apart(spark):
    rng = np.random.default_rng(9)
    number, size, dim = 1600, 15, 32
    c = rng.standard_normal((number, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    g = rng.permutation(np.repeat(np.arange(number), size))
    x = c[g] + 0.2 * rng.standard_normal((len(g), dim)) / np.sqrt(dim)
    rows = [(i, dim, v.astype(np.float32).tobytes()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    members, _ = clusters.density_clusters(spark.createDataFrame(rows, "id long, dim int, vec binary"))
    label = np.full(len(g), -1)
    for r in members.collect():
        label[r["id"]] = r["cluster"]
    whole = 0
    for k in range(number):
        mine = label[g == k]
        names, counts = np.unique(mine[mine >= 0], return_counts=True)
        whole += len(names) > 0 and counts.max() >= 0.8 * size and (label == names[counts.argmax()]).sum() <= 1.2 * size
    assert whole >= 0.75 * number


@pytest.mark.parametrize("size", [9, 12, 20, 30])
def test_core_distances_see_every_row_of_the_window(size):
    rng = np.random.default_rng(size)
    n, dim, window, core, near, at = 3000, 48, 256, 32, 8, 1501
    x = rng.standard_normal((n, dim))
    x[at : at + size] = rng.standard_normal(dim) + 0.3 * rng.standard_normal((size, dim))
    codes = clusters.to_codes(x)
    cols = [pa.array(np.full(n, dim * 64 << forest.CELL_BITS)), pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int32)), clusters.binary_column(codes)]
    batch = pa.RecordBatch.from_arrays(cols, ["cell", "key", "id", "level", "code"])
    got = {}
    for part in clusters.reachability_graph(window, core, near, 4, {dim: 1.0})(iter([batch])):
        got |= {r["id"]: r["w"] for r in part.to_pylist() if r["other"] is None}
    u = clusters.from_codes(codes)
    for i in range(0, n, 7):
        a = min(max(0, i - window), n - 1 - 2 * window)
        rows = np.arange(a, a + 2 * window + 1)
        far = np.sort(1 - u[rows[rows != i]] @ u[i])
        assert got[i] == pytest.approx(min(far[core - 1], 2 * far[near - 1]), abs=1e-5)
    assert max(got[i] for i in range(at, at + size)) < 0.4 < min(got[i] for i in range(n) if not at <= i < at + size)


def test_usual_fit_is_the_median_of_all_rows(spark):
    # Three rows of one dimension beside many of another; more rows than any sample held.
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for dim, n in ((3, 3), (4, 45_000), (5, 1_000)):
        code = rng.integers(-127, 128, (n, 2 * dim)).astype(np.int8)
        y, x = clusters.halves(code, dim)
        want[dim] = np.sort((x * y).sum(1))[(n - 1) // 2]
        rows += [(len(rows) + i, dim, c.tobytes()) for i, c in enumerate(code)]
    table = spark.createDataFrame(rows, clusters.SMOOTHED)
    got = clusters.typical_fit(table)
    assert got == {d: float(f) for d, f in want.items()}
    assert got == clusters.typical_fit(table.repartition(7))
    assert clusters.typical_fit(table.where("false")) == {}


def test_a_third_of_one_vector_does_not_stop_clusters(spark):
    rng = np.random.default_rng(5)
    _, x = groups(rng, 600, 32, 3)
    rows = [(i, 1, v.astype(np.float32).tolist(), 1, 0, "x") for i, v in enumerate(x)] + [(1000 + i, 1, x[0].astype(np.float32).tolist(), 1, 0, "x") for i in range(300)]
    v, m = frames(spark, rows, ((1, 32),))
    members, _ = clusters.density_clusters(similar.usable_vectors(v, m))
    copies = members.where(F.col("id") >= 1000).groupBy("cluster").count().collect()
    assert len(copies) == 1 and copies[0]["count"] == 300
