import itertools
import random

from pyspark.sql import functions as F

from corpusloom.operators import incremental as inc

NODE = "arrival_seq long, catalog_id long, node_id string, content_hash string, observed_at long, run_id string"
RUN = "run_id long, catalog_id long, up_to_seq long, status string, node_id string"


def brute(nodes, runs):
    out = set()
    by = {}
    for r in sorted({(c, i, s) for i, c, s, st, _ in runs if st == "ok" and None not in (i, c, s)}):
        by.setdefault(r[0], []).append((r[1], r[2]))

    def state(c, upto):
        best = {}
        for seq, cat, node, h, at, _ in sorted(set(n for n in nodes if None not in n[:5])):
            if cat == c and seq <= upto and (node not in best or at > best[node][0]):
                best[node] = (at, h)
        return {n: v[1] for n, v in best.items()}

    for c, rs in by.items():
        before = {}
        for run, upto in rs:
            now = state(c, upto)
            out |= {(run, n) for n, h in now.items() if before.get(n) != h}
            before = now
    return out


def test_against_brute_force_with_retries_and_dirt(spark):
    rng = random.Random(5)
    for trial in range(3):
        nodes = []
        for seq in range(150):
            cat = 1 if rng.random() < 0.4 else rng.randint(1, 4)
            nodes.append((seq, cat, f"n{rng.randint(0, 9)}", rng.choice("abc") if rng.random() > 0.1 else None, seq + rng.randint(-20, 20) * 3 + seq * 0, "clash"))
        nodes = [(s, c, n, h, a * 1000 + s, x) for s, c, n, h, a, x in nodes]
        nodes += rng.sample(nodes, 20) + [(None, 1, "n1", "a", 5, "x"), (3, None, "n1", "a", 5, "x"), (3, 1, None, "a", 5, "x")]
        seqs = sorted(rng.sample(range(150), 12))
        if trial == 2:
            seqs[4], seqs[7] = seqs[7], seqs[4]
        runs = [(i, i % 3 + 1, s, rng.choice(["ok", "ok", "failed", None]), "clash") for i, s in enumerate(seqs)] + [(99, 1, None, "ok", "x")]
        runs += runs[:2]
        n, r = spark.createDataFrame(nodes, NODE), spark.createDataFrame(runs, RUN)
        want = brute(nodes, runs)
        assert {tuple(x) for x in inc.run_changes(n, r).select("run_id", "node_id").collect()} == want
        kept = inc.refreshed_run_changes(n, r, partitions=4).collect()
        assert len(kept) == len(want) and {tuple(x) for x in kept} == want


def test_empty_tables(spark):
    n, r = spark.createDataFrame([], NODE), spark.createDataFrame([], RUN)
    assert inc.run_changes(n, r).count() == 0
    assert inc.refreshed_run_changes(n, r).collect() == []


def test_refresh_recomputes_only_what_changed(spark, tmp_path):
    store = inc.IncrementalTable(spark, str(tmp_path / "t"), ["k"], 8)
    rows = [(k, v) for k, v in itertools.product(range(40), "ab")]
    df = spark.createDataFrame(rows, "k long, v string")

    def count(x):
        return x.groupBy("k", "__part").agg(F.count(F.lit(1)).alias("n"))

    assert len(store.refresh(df, count)) == 8
    assert store.refresh(df, count) == []
    more = df.unionByName(spark.createDataFrame([(3, "z")], df.schema))
    assert len(store.refresh(more, count)) == 1
    assert {r["k"]: r["n"] for r in store.read("k long, n long").collect()} == {k: 3 if k == 3 else 2 for k in range(40)}
    less = more.where("k <> 3")
    assert len(store.refresh(less, count)) == 1
    assert store.read("k long, n long").where("k = 3").count() == 0


def test_a_crash_before_the_commit_repeats_the_same_partitions(spark, tmp_path):
    store = inc.IncrementalTable(spark, str(tmp_path / "t"), ["k"], 4)
    df = spark.createDataFrame([(k,) for k in range(20)], "k long")
    store.refresh(df, lambda x: x)
    more = df.unionByName(spark.createDataFrame([(100,)], df.schema))
    commit, store._commit = store._commit, lambda new: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        store.refresh(more, lambda x: x)
        raise AssertionError("the commit must fail")
    except RuntimeError:
        store._commit = commit
    assert len(store.refresh(more, lambda x: x)) == 1
    assert sorted(r["k"] for r in store.read("k long").collect()) == [*range(20), 100]


def test_what_a_crash_left_is_removed_and_mended(spark, tmp_path):
    store = inc.IncrementalTable(spark, str(tmp_path / "t"), ["k"], 8)
    df = spark.createDataFrame([(k, "a") for k in range(40)], "k long, v string")
    store.refresh(df, lambda x: x)
    part = {r["k"]: r["__part"] for r in store.with_part(df).collect()}
    fewer = df.where(F.col("k").isin([k for k in part if part[k] != part[0]]))
    other = fewer.withColumn("v", F.lit("b"))
    commit, store._commit = store._commit, lambda new: (_ for _ in ()).throw(RuntimeError("lost"))
    for _ in range(2):
        try:
            store.refresh(other, lambda x: x)
            raise AssertionError("the commit must fail")
        except RuntimeError:
            pass
    store._commit = commit
    # The source is again as at the last commit, but the stored partitions are not.
    store.refresh(fewer, lambda x: x)
    assert sorted(map(tuple, store.read("k long, v string").collect())) == sorted((k, "a") for k in part if part[k] != part[0])
    assert store.refresh(fewer, lambda x: x) == [] and len(store._listed("_manifest-*")) == 1 and store._listed("_pending-*") == []


def test_a_hot_node_and_a_kept_table(spark, tmp_path):
    rng = random.Random(11)
    nodes = [(seq, 1, "hot" if rng.random() < 0.5 else f"n{seq % 5}", rng.choice("abcd"), rng.randint(0, 10**6), "x") for seq in range(300)]
    runs = [(i, 1, 30 * i, "ok", "x") for i in range(1, 11)]
    n, r = spark.createDataFrame(nodes, NODE), spark.createDataFrame(runs, RUN)
    path = str(tmp_path / "kept")
    assert {tuple(x) for x in inc.refreshed_run_changes(n, r, path, 4).collect()} == brute(nodes, runs)
    more = [*nodes, (301, 1, "late", "z", 5, "x")]
    more_runs = [*runs, (11, 1, 310, "ok", "x")]
    got = inc.refreshed_run_changes(spark.createDataFrame(more, NODE), spark.createDataFrame(more_runs, RUN), path, 4)
    assert {tuple(x) for x in got.collect()} == brute(more, more_runs)
