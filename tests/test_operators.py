import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hashing, scalars
from corpusloom.functions import vectors as V
from corpusloom.operators import dense, diagnostics, graph, holographic, live, retrieval, search, state
from corpusloom.plans import structure


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(V.normalized(F.col("a")).alias("n"), V.true_cosine(F.col("a"), F.col("b")).alias("c"), V.distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert rows[0]["n"] == [0.6, 0.8] and rows[1]["n"] == [0.0, 0.0]
    assert rows[0]["c"] == pytest.approx(0.6) and rows[1]["c"] == 0


def test_ternary(spark):
    df = spark.createDataFrame([([1, -1, 1, 0], [1, 1, -1, 0])], "a array<int>, b array<int>")
    assert df.select(V.ternary_dot(F.col("a"), F.col("b"))).first()[0] == -1


def test_dense_top_breaks_ties_and_skips_bad(spark):
    v = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [float("nan"), 0.0]), (4, None), (7, [0.0, 1.0]), (8, [1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q long, vector array<float>")
    assert [(r["id"], r["rank"]) for r in search.dense_top(v, q, 2).orderBy("rank").collect()] == [(3, 1), (5, 2)]


def test_budget_fold(spark):
    rows = [("q", i + 1, s, f"c{i}", p, a, b, t) for i, (s, p, a, b, t) in enumerate([(1.0, "x", 1, 10, 50), (0.9, "x", 8, 12, 10), (0.8, "y", 1, 5, 90), (0.7, "z", 1, 5, 40), (0.5, "w", 1, 5, 1)])]
    cand = spark.createDataFrame(rows, "q string, rank int, score double, chunk string, path string, line_start int, line_end int, tokens int")
    r = search.budget_fold(cand, "q", token_budget=100).first()
    assert [a["chunk"] for a in r["accepted"]] == ["c0", "c3"] and r["spent"] == 90 and r["dropped"] == 1
    top = search.budget_fold(cand, "q", max_chunks=1).first()
    assert len(top["accepted"]) == 1 and top["dropped"] == 3
    none = search.budget_fold(cand, "q", threshold=1.01).first()
    assert none["accepted"] == [] and none["dropped"] == 0


def test_render(spark):
    cand = spark.createDataFrame([("q", 1, 0.9, "c", "a.rs", 1, 2, 3)], "q string, rank int, score double, chunk string, path string, line_start int, line_end int, tokens int")
    chunks = spark.createDataFrame([("c", "body")], "chunk string, text string")
    text = search.render_context(search.budget_fold(cand, "q"), chunks, "q").first()["context"]
    assert "--- a.rs:1-2 (similarity 0.900) ---\nbody" in text
    empty = search.render_context(search.budget_fold(cand, "q", threshold=2.0), chunks, "q").first()["context"]
    assert empty == ""


def test_hash_embeddings_are_unit(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha", "a/x.rs"), (2, "beta gamma", "b/y.rs"), (3, "", "c.rs"), (4, None, None)], "doc_id long, text string, path string")
    rows = dense.hash_embeddings(docs, 64, path="path").collect()
    for k in (1, 2):
        assert sum(r["value"] ** 2 for r in rows if r["key"] == k) == pytest.approx(1)


def test_kmeans_finds_groups(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((5, 16))
    rows = [(i, (centres[i % 5] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(300)]
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
    _, parts = dense.kmeans(spark.createDataFrame(rows, "id long, vector array<double>"), 20)
    got = {r["id"]: r["part"] for r in parts.collect()}
    assert all(len({i % 5 for i in got if got[i] == p}) == 1 for p in set(got.values()))


def test_live_view(spark):
    base = spark.createDataFrame([("a", "old"), ("b", "keep"), ("c", "gone")], "path string, text string")
    log = spark.createDataFrame([("a", 1, "update", "x"), ("a", 2, "update", "new"), ("c", 3, "delete", None), ("d\\e", 4, "update", "fresh"), (None, 5, "update", "z"), ("f", 6, "update", "")], "path string, seq long, op string, text string")
    rows = {(r["path"], r["text"], r["origin"]) for r in live.live_view(base, live.latest_edits(log)).collect()}
    assert rows == {("b", "keep", "base"), ("a", "new", "delta"), ("d/e", "fresh", "delta")}


def test_debounce_boundary(spark):
    t = spark.createDataFrame([("p", 1, 0), ("p", 2, 499), ("p", 3, 999), ("p", 4, 1000)], "path string, seq long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    assert [r["touches"] for r in live.debounced(t, 500).orderBy("session").collect()] == [2, 2]


def test_heat(spark):
    log = [(g, i) for g in range(10) for i in (1, 2)] + [(g, 3) for g in range(10, 13)]
    h = {r["item"]: r["heat"] for r in live.heat(spark.createDataFrame(log, "generation long, item long")).collect()}
    assert max(h.values()) == 1.0 and h[1] == pytest.approx(h[2]) and h[2] > h[3]
    recent = live.heat(spark.createDataFrame([(g, 1) for g in range(5)] + [(g, 2) for g in range(5, 8)], "generation long, item long"), 0.5)
    assert {r["item"]: r["heat"] for r in recent.collect()}[2] == 1.0


def test_ema_matches_a_loop_with_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [(0 if i % 3 else i % 5, i, float(rng.random())) for i in range(400)]
    got = {r["k"]: r["ema"] for r in live.ema(spark.createDataFrame(rows, "k long, seq long, x double"), "k", "seq", "x", 0.1, 7).collect()}
    want = {}
    for k, _, x in rows:
        want[k] = want.get(k, 0.0) + 0.1 * (x - want.get(k, 0.0))
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def log(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "device long, seq long, op string, block long, bytes long")


def test_lru(spark):
    mib = 1 << 20
    out = state.lru_evictions(log(spark, [("add", i, mib) for i in range(5)]), 2 * mib).collect()
    assert len(out) == 3 and out[-1]["used"] <= 2 * mib
    first = state.lru_evictions(log(spark, [("add", 1, 1), ("add", 2, 1), ("add", 3, 1), ("access", 1, 0), ("add", 4, 1)]), 3).first()
    assert first["evicted"] == 2


def test_allocator(spark):
    out = state.allocator_trace(log(spark, [("alloc", 0, 256), ("alloc", 1, 256), ("free", 0, 0), ("alloc", 2, 128)]), 1024).orderBy("seq").collect()
    assert [r["offset"] for r in out] == [0, 256, None, 0] and out[-1]["used"] == 384


def test_thermal_and_schedule(spark):
    df = spark.createDataFrame([(79.0, 100.0), (80.0, 10.0), (70.0, 150.0), (50.0, 50.0), (72.0, 200.0)], "t double, w double")
    got = df.select(state.thermal_state(F.col("t"), F.col("w")).alias("s")).select("s.state", "s.delay_ms").collect()
    assert [tuple(r) for r in got] == [("thermal_throttle", 25), ("critical", 50), ("power_throttle", 25), ("normal", 0), ("thermal_throttle", 25)]
    plan = state.prefetch_schedule(spark.createDataFrame([("m", 4)], "model string, n int")).collect()
    assert {(r["step"], r["action"], r["layer"]) for r in plan if r["step"] == 2} == {(2, "prefetch", 3), (2, "evict", 0)}


def test_holographic_round_trip():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(256)
    x /= np.linalg.norm(x)
    k = holographic.path_key("src/a.rs", 256)
    back = holographic.correlate(k, holographic.convolve(k, x))
    assert np.linalg.norm(k) == pytest.approx(1)
    assert back @ x / np.linalg.norm(back) > 0.999
    assert abs(k @ holographic.path_key("src/b.rs", 256)) < 0.25


def test_superposition_falls_as_root(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(20):
        v = rng.standard_normal(128)
        rows.append((i, f"p/{i}", (v / np.linalg.norm(v)).tolist()))
    got = {r["k"]: r["mean_cosine"] for r in holographic.superposition_recall(spark.createDataFrame(rows, "n long, path string, vector array<double>"), [1, 5, 20], 128).collect()}
    assert got[1] == pytest.approx(1) and all(abs(got[k] - 1 / math.sqrt(k)) < 0.12 for k in (5, 20))


def test_superposition_recalls_every_item(spark):
    rng = np.random.default_rng(4)
    x = {i: v / np.linalg.norm(v) for i, v in enumerate(rng.standard_normal((23, 32)))}
    keys = {i: holographic.path_key(f"p/{i}", 32) for i in x}
    rows = spark.createDataFrame([(i, f"p/{i}", v.tolist()) for i, v in x.items()], "n long, path string, vector array<double>")
    got = {r["k"]: r for r in holographic.superposition_recall(rows, [1, 2, 5], 32).collect()}
    for k in (1, 2, 5):
        cos = []
        for i, v in x.items():
            back = holographic.correlate(keys[i], sum(holographic.convolve(keys[j], x[j]) for j in x if j // k == i // k))
            cos.append(back @ v / np.linalg.norm(back))
        assert got[k]["mean_cosine"] == pytest.approx(np.mean(cos), abs=1e-9) and got[k]["accuracy"] == pytest.approx(np.mean(np.array(cos) > 0.85))


def test_gist_fold(spark):
    rows = spark.createDataFrame([(1, 0, [0.5] * 4, "p"), (1, 1, [0.05] * 4, "p")], "g long, i long, vector array<double>, path string")
    r = holographic.gist_fold(rows, "g", "i").first()
    assert r["kept"] == 1 and r["gist"] == pytest.approx([0.05] * 4)


def merkle(spark, rows):
    return {r["node"]: (r["depth"], r["digest"]) for r in graph.merkle_digests(spark.createDataFrame(rows, "node string, up string, own string")).collect()}


def test_merkle_changes_only_above_an_edit(spark):
    tree = [("r", None, "0"), ("a", "r", "1"), ("b", "r", "2"), ("a1", "a", "3"), ("b1", "b", "4"), ("lost", "nowhere", "5"), (None, "r", "6")]
    one, two = merkle(spark, tree), merkle(spark, [(n, u, "9" if n == "b1" else o) for n, u, o in tree])
    assert one["a"] == two["a"] and one["b"] != two["b"] and one["r"] != two["r"] and one["lost"] == (0, "5")
    assert merkle(spark, []) == {}
    # A directory's own digest counts as well.
    assert merkle(spark, [(n, u, "9" if n == "b" else o) for n, u, o in tree])["r"] != one["r"]


def test_merkle_reaches_every_depth_and_leaves_cycles_out(spark):
    rows = [(f"n{i:02d}", f"n{i - 1:02d}" if i else None, str(i)) for i in range(40)] + [("x", "y", "1"), ("y", "x", "2")]
    want = {39: "39"}
    for i in range(38, -1, -1):
        part = hashlib.sha256((want[i + 1] + f"n{i + 1:02d}").encode()).hexdigest()
        want[i] = hashlib.sha256((str(i) + part).encode()).hexdigest()
    assert merkle(spark, rows) == {f"n{i:02d}": (i, want[i]) for i in range(40)}


def test_merkle_takes_the_newest_hash(spark, tmp_path):
    rows = [(1, "k", "FF", 1, 1), (1, "k", "aa", 2, 2), (1, "k", "bb", 2, 3), (1, "k", None, 9, 9), (2, "k", "cc", 5, 1), (2, "k", "dd", 4, 2)]
    table = spark.createDataFrame(rows, "catalog_id long, node_id string, content_hash string, observed_at long, arrival_seq long").withColumn("parent_id", F.lit(None).cast("string"))
    table.write.parquet(f"{tmp_path}/dag_nodes.parquet")
    got = {r["node"]: r["digest"] for r in structure.merkle_digests(spark, str(tmp_path)).collect()}
    assert got == {"k@1": "bb", "k@2": "cc"}


def test_file_graph(spark):
    paths = spark.createDataFrame([("a/b.rs",), ("a\\c.tsx",), ("target/x.rs",), ("top.MD",), ("top.md",), (None,), ("a/b.rs",)], "path string")
    rows = [tuple(r) for r in graph.file_nodes(paths).orderBy("id").collect()]
    assert rows == [(0, ".", "directory", "Network Structure", 8), (1, "a", "directory", "Network Structure", 8), (2, "a/b.rs", "file", "Logic", 1), (3, "a/c.tsx", "file", "Sensory", 2), (4, "top.MD", "file", "Gist", 0), (5, "top.md", "file", "Memory", 5)]
    assert [r["type"] for r in graph.file_nodes(paths.limit(0)).collect()] == ["Error"]
    assert {tuple(r) for r in graph.neighbour_lists(graph.file_links(paths)).where("name = '.'").collect()} == {(".", "top.MD"), (".", "top.md")}


def test_diagnostics(spark):
    line = '{"reason":"compiler-message","message":{"message":"m","level":"error","spans":[{"is_primary":false,"file_name":"a","line_start":1,"column_start":2},{"is_primary":true,"file_name":"b","line_start":3,"column_start":4}]}}'
    bare = '{"reason":"compiler-message","message":{"message":"n","level":"warning","spans":[]}}'
    d = diagnostics.diagnostics(spark.createDataFrame([("t", line), ("t", bare), ("u", bare), ("t", "no json"), ("t", None)], "target string, value string"))
    rows = {r["message"]: r for r in d.where("target = 't'").collect()}
    assert rows["m"]["file_name"] == "b" and rows["n"]["file_name"] is None
    assert {r["target"]: r["score"] for r in diagnostics.verity(d, "target").collect()} == {"t": 0.0, "u": 0.9}
    many = spark.createDataFrame([("t", "x.rs", 2, 3, i, "error" if i else "warning", "f.rs" if i % 2 else None, i, 1, f"m{i}") for i in range(8)], "target string, path string, attempt int, attempts int, n int, level string, file_name string, line_start int, column_start int, message string")
    text = diagnostics.render_errors(many, "target", "n", 2).first()["prompt"]
    assert text.startswith("Your patch to x.rs did not compile (attempt 2 of 3).\n\nerror at f.rs:1:1\n  m1\nerror\n  m2\n\n... and 5 further errors")
    assert diagnostics.render_errors(many.where("level = 'warning'"), "target", "n").count() == 0


def test_replies_and_paths(spark):
    assert diagnostics.first_object('x {"a": "}\\"{", "b": {"c": 1}} y') == '{"a": "}\\"{", "b": {"c": 1}}'
    assert diagnostics.first_object("none") is None
    paths = ["a/b.rs", "/etc/x", "../x", "a/../../x", "C:\\x", "a/../b", "", None]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(diagnostics.safe_path(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in rows] == [True, False, False, False, False, True, False, False]


def test_requests(spark):
    cases = [
        ('{"prompt":"p"}', "p"),
        ('{"messages":[{"role":"user","content":"one"},{"role":"assistant","content":"x"},{"role":"user","content":"two"}]}', "two"),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}]}', "a\nb"),
        ('{"messages":[]}', None),
        ("nonsense", None),
    ]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "p string").select(diagnostics.asked_text(F.col("p")).alias("a")).collect()
    assert [r["a"] for r in rows] == [w for _, w in cases]
    put = diagnostics.injected_payload
    assert put('{"messages":[{"role":"user","content":"q"}]}', "ctx", "openai").startswith('{"messages": [{"role": "system", "content": "ctx"}')
    assert put('{"prompt":"q"}', "ctx", "ollama") == '{"prompt": "ctx\\n\\nq"}'
    assert put('{"system":"s"}', "ctx", "anthropic") == '{"system": [{"type": "text", "text": "ctx\\n\\ns"}]}'
    assert '"cache_control"' in put('{"system":[{"type":"text","text":"s"}]}', "ctx", "anthropic") and '"cache_control"' in put("{}", "ctx", "anthropic")
    assert put("bad", "ctx", "openai") == "bad" and put('{"prompt":"q"}', "", "openai") == '{"prompt":"q"}' and put(None, "ctx", None) is None


def test_reply_text(spark):
    cases = [
        ('{"choices":[{"message":{"content":"c"}}]}', "c"),
        ('{"choices":[{"message":{"content":"  ","tool_calls":[{"function":{"arguments":"{}"}}]}}]}', "{}"),
        ('{"choices":[]}', None),
        ("no", None),
    ]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "p string").select(diagnostics.message_text(F.col("p")).alias("a")).collect()
    assert [r["a"] for r in rows] == [w for _, w in cases]


def test_patch_spellings(spark):
    cases = [('{"file_path":"a.rs","contents":"x"}', ("a.rs", "x", True)), ('{"filename":"a.rs","text":"x"}', (None, None, False)), ('{"path":"../a","new_content":"y","code":"z"}', ("../a", "z", False))]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "p string").select(diagnostics.parsed_patch(F.col("p")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in rows] == [w for _, w in cases]


def test_dangers(spark):
    rows = spark.createDataFrame([("rs", "unsafe {}"), ("py", "eval(x)"), ("py", "pickle.load(f)"), ("tsx", "eval(x)"), ("c", "gets(b)"), (None, None)], "l string, t string")
    got = rows.select(diagnostics.dangers(F.col("l"), F.col("t"))["name"].alias("n")).collect()
    assert [r["n"] for r in got] == [["UnsafeBlock"], [], ["PythonExecGate"], ["DangerousSuture"], [], []]


def test_scalars(spark):
    pairs = [(0, 5), (-1, -1), (1 << 62, 6), (12345678901234567, -98765432109876543), (None, 1)]
    rows = spark.createDataFrame(pairs, "a long, b long").select(scalars.wide_product(F.col("a"), F.col("b")).alias("z"), scalars.folded_address(F.col("a"), F.col("b")).alias("f")).collect()
    for (a, b), r in zip(pairs[:-1], rows[:-1], strict=True):
        want = (a % (1 << 64)) * (b % (1 << 64))
        assert (r["z"]["high"] % (1 << 64) << 64) + r["z"]["low"] % (1 << 64) == want
        assert r["f"] % (1 << 64) == (want ^ want >> 64) % (1 << 64)
    assert rows[-1]["f"] is None
    df = spark.createDataFrame([(50, "CLOUD", None), (130, None, "true"), (0, "other", "1")], "p int, n string, b string")
    got = df.select(scalars.progress_bar(F.col("p"), 4).alias("bar"), scalars.adaptive_mode(F.col("n"), F.col("b")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("██░░", "cloud_192gb"), ("████", "cloud_192gb"), ("░░░░", "local_8gb")]
    one = spark.range(1).select(scalars.packed_bytes(F.lit(3), F.lit(65)), scalars.longest_context(F.lit(192), F.lit(8), F.lit(70)), scalars.sha3(F.lit("x"))).first()
    assert one[0] == 96 and one[1] == 192 * 8 * (1 << 30) // 280 and one[2] == hashlib.sha3_256(b"x").hexdigest()


def test_pin_has_no_bound_and_reports(spark):
    hot = spark.createDataFrame([(i, 1.0 / (1 + i % 50), 1 if i % 9 else None) for i in range(12_000)], "item long, heat double, bytes long")
    got = live.pin_prefix(hot, 11_000)
    known = sorted([(-r["heat"], r["item"]) for r in hot.where("bytes IS NOT NULL").collect()])
    assert {r["item"] for r in got.collect()} == {i for _, i in known[:11_000]}
    report = {r["state"]: r["items"] for r in live.pin_report(hot.select("item", "heat"), hot.select("item", "bytes"), 100).collect()}
    assert report == {"pinned": 100, "over_budget": len(known) - 100, "unknown": 12_000 - len(known)}


def test_debounce_against_a_loop_with_a_hot_path(spark):
    rng = np.random.default_rng(7)
    rows = [("hot" if i % 3 else f"p{i % 4}", i, int(rng.integers(0, 40_000))) for i in range(900)]
    df = spark.createDataFrame(rows, "path string, seq long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = sorted((r["path"], r["session"], r["touches"], r["first_seq"]) for r in live.debounced(df, 100, 16).collect())
    want = []
    for p in {r[0] for r in rows}:
        session, last = 0, None
        for ms, seq in sorted((m, s) for q, s, m in rows if q == p):
            if last is None or ms - last >= 100:
                session += 1
                want.append([p, session, 0, seq])
            want[-1][2] += 1
            want[-1][3] = min(want[-1][3], seq)
            last = ms
    assert got == sorted(map(tuple, want))


def test_renames_and_clears(spark):
    log = [("a", 1, "update", "x", None), (None, 2, "clear", None, None), ("b", 3, "update", "y", None), ("b", 4, "rename", "y2", "c"), ("d", 5, "delete", None, None)]
    got = {r["path"]: (r["op"], r["text"]) for r in live.latest_edits(spark.createDataFrame(log, "path string, seq long, op string, text string, to string")).collect()}
    assert got == {"b": ("delete", None), "c": ("update", "y2"), "d": ("delete", None)}


def test_bm25_against_a_loop(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i}", " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(60)] + [("n", None), ("e", "")]
    asks = [(q, " ".join(rng.choice(words, 4)) + " absent") for q in range(5)] + [(9, None), (10, "...")]
    got = {(r["item_id"], r["chunk"]): r["score"] for r in search.bm25_top(spark.createDataFrame(docs, "chunk string, text string"), spark.createDataFrame(asks, "item_id long, text string"), 100).collect()}
    toks = {c: (t or "").split() for c, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    want = {}
    for q, text in asks[:5]:
        for c, ts in toks.items():
            score = 0.0
            for term in set(text.split()):
                tf, d = ts.count(term), sum(term in x for x in toks.values())
                score += math.log((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            if score:
                want[q, c] = score
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_query_sets_larger_than_one_pass(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "id long, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(11)], "q long, vector array<double>")
    docs = spark.createDataFrame([("a", "x y"), ("b", "y z")], "chunk string, text string")
    asks = spark.createDataFrame([(i, "x z y") for i in range(9)], "item_id long, text string")
    whole, lexical = search.dense_top(v, q, 3).collect(), search.bm25_top(docs, asks, 2).collect()
    monkeypatch.setattr(search, "SMALL_ROWS", 4)
    assert sorted(search.dense_top(v, q, 3).collect()) == sorted(whole) and sorted(search.bm25_top(docs, asks, 2).collect()) == sorted(lexical)


def test_partitioned_search_reads_little_and_finds_much(spark, tmp_path):
    rng = np.random.default_rng(9)
    c = rng.standard_normal((40, 24))
    x = c[rng.integers(0, 40, 5000)] + 0.35 * rng.standard_normal((5000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    centroids, table = dense.partitioned(v, str(tmp_path), 40, 6)
    q = v.where("id % 50 = 0").select(F.col("id").alias("q"), "vector")
    got = dense.probe(table, centroids, q, 6, 10)
    exact = {(r["q"], r["id"]) for r in search.dense_top(v, q, 10).collect()}
    assert len({(r["q"], r["id"]) for r in got.collect()} & exact) / len(exact) > 0.9
    sizes = {r["part"]: r["count"] for r in table.groupBy("part").count().collect()}
    parts = dense.nearest_parts(q, centroids, 6).collect()
    assert sum(sizes.get(r["part"], 0) for r in parts) / (100 * 5000) < 0.3
    few = dense.partitioned(v.limit(100), str(tmp_path / "few"), 40)[1]
    assert few.select("part").distinct().count() == 1


def test_coarse_codes_keep_the_best(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((10, 64))[rng.integers(0, 10, 600)] + 0.5 * rng.standard_normal((600, 64))
    v = spark.createDataFrame([(i, (r / np.linalg.norm(r)).tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    q = v.where("id % 50 = 0").select(F.col("id").alias("q"), "vector")
    exact = {(r["q"], r["id"]) for r in search.dense_top(v, q, 10).collect()}
    assert len({(r["q"], r["id"]) for r in dense.coarse_to_fine(v, q, 10).collect()} & exact) / len(exact) > 0.9


def test_fnv_many():
    words = [b"", b"a", "Grüße".encode(), b"x" * 200]
    for seed in (0, hashing.PAIR_SEED):
        for w, h in zip(words, dense.fnv_many(words, seed), strict=True):
            want = hashing.OFFSET ^ seed
            for b in w:
                want = (want ^ b) * 0x100000001B3 % (1 << 64)
            assert int(h) == want


CHUNK = "chunk string, path string, line_start int, line_end int, text string, tokens int"


def test_faults_scope_live_and_contexts(spark):
    chunks = spark.createDataFrame([("1", "lib/ring.rs", 1, 9, "fn push ring queue overflow", 9), ("2", "doc/a.md", 1, 3, "ring notes on queue", 6), ("3", "lib/ring.rs", 8, 12, "ring tail", 3)], CHUNK)
    vec = lambda rows, kind: spark.createDataFrame(rows, kind)
    base = vec([("1", "lib/ring.rs", [1.0, 0.0]), ("2", "doc/a.md", [0.9, 0.1]), ("3", "lib/ring.rs", [0.8, 0.2])], "id string, path string, vector array<double>")
    asks = vec([(1, "the ring queue overflow", [1.0, 0.0], []), (2, "see ring.rs", [0.0, 1.0], ["ring.rs"]), (3, "open zzz.rs", [1.0, 0.0], ["zzz.rs"]), (4, "hello", [0.0, 0.0], [])], "q long, text string, vector array<double>, hints array<string>")
    got = {r["q"]: r for r in retrieval.page_fault(base, chunks, asks).collect()}
    assert [h["chunk"] for h in got[1]["hits"]] == ["1", "2"] and got[1]["injected_tokens"] == sum(h["tokens"] for h in got[1]["hits"])
    assert [h["chunk"] for h in got[2]["hits"]] == ["3"] and [h["chunk"] for h in got[3]["hits"]] == ["1", "2"] and not got[4]["faulted"]
    delta_chunks = spark.createDataFrame([("live:1", "doc/a.md", 1, 2, "fresh ring", 4)], CHUNK)
    delta = vec([("live:1", "doc/a.md", [1.0, 0.05])], "id string, path string, vector array<double>")
    shadowed = spark.createDataFrame([("doc/a.md",), ("lib/ring.rs",)], "path string")
    live_got = {r["q"]: [h["chunk"] for h in r["hits"]] for r in retrieval.live_page_fault(base, chunks, delta, delta_chunks, shadowed, asks).collect()}
    assert live_got == {1: ["live:1"], 2: [], 3: ["live:1"], 4: []}
    out = {r["q"]: r for r in retrieval.context_for(base, chunks, delta, delta_chunks, shadowed.where("path = 'doc/a.md'"), asks.drop("hints")).collect()}
    assert {q: r["route"] for q, r in out.items()} == {1: "hybrid", 2: "live", 3: "live", 4: "skip"}
    assert out[1]["hits"][0] == "1" and "--- lib/ring.rs:1-9" in out[1]["context"] and out[4]["context"] == ""
    empty = retrieval.context_for(base, chunks, delta, delta_chunks, shadowed, asks.drop("hints").limit(0))
    assert empty.count() == 0
    answer = retrieval.page_fault(base, chunks, asks).where("q = 2").select(search.tool_block(F.col("hits"))).first()[0]
    assert answer == "── lib/ring.rs:8-12  (score 0.200)\nring tail"


def test_scratchpad_use_and_cluster_removal(spark):
    pad = state.scratchpad(log(spark, [("alloc", 0, 60), ("alloc", 0, 50), ("alloc", 0, 40), ("free", 0, 70), ("free", 0, 70)]), 100).orderBy("seq").collect()
    assert [(r["offset"], r["used"]) for r in pad] == [(0, 60), (None, 60), (60, 100), (None, 30), (None, 0)]
    use = state.resident_use(log(spark, [("add", 1, 5), ("add", 2, 7), ("remove", 1, 0), ("access", 1, 9), ("add", 2, 8)])).first()
    assert (use["blocks"], use["used"]) == (1, 8)
    rows = log(spark, [("add", 1, 5), ("add", 2, 5), ("remove", 1, 0), ("remove", 1, 0), ("add", 3, 1)]).withColumn("cluster", F.col("block"))
    got = state.injected(rows, 10).orderBy("seq").collect()
    assert [(r["position"], r["accepted"]) for r in got] == [(0, True), (5, True), (None, True), (None, False), (None, False)]


def test_blends_marks_and_directions(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6, 8))
    rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g long, i long, vector array<double>")
    for alpha, a in ((0.3, 0.3), (-1, 0.0), (7, 1.0)):
        want = x[0]
        for v in x[1:]:
            want = (1 - a) * want + a * v
        assert holographic.tuned(rows, "g", "i", alpha).first()["vector"] == pytest.approx(want.tolist())
    stream = hashlib.shake_256(b"seed").digest(2420)
    want = np.zeros(8)
    for i, b in enumerate(stream):
        want[17 * i % 8] += b * 1e-6
    marked = rows.where("i = 0").select(holographic.watermark_bias(F.col("vector"), "seed").alias("m")).first()["m"]
    assert marked == pytest.approx((x[0] + want).tolist())
    paths = spark.createDataFrame([("a/b/c",), ("a/b/d",), ("z/y/x",), (None,)], "p string")
    near, same, other, none = (r[0] for r in paths.select(holographic.path_direction(F.col("p"), 64)).collect())
    assert none is None and np.dot(near, same) > 0.8 > abs(np.dot(near, other)) + 0.3 and np.linalg.norm(near) == pytest.approx(1)


def test_workspace_vector_against_a_loop(spark):
    texts = {"b.md": "\n\n".join("block %d " % i * 12 for i in range(5)), "a.md": "short\n\n" + "long enough text " * 5}
    blocks = {("a.md", 1): 0, ("b.md", 0): 1, ("b.md", 1): 2, ("b.md", 2): 3}
    unit = np.eye(16)[:4]

    def embed(df):
        return df.sparkSession.createDataFrame([(r["path"], r["no"], unit[blocks[r["path"], r["no"]]].tolist()) for r in df.collect()], "path string, no int, vector array<double>")

    got = holographic.workspace_vector(spark.createDataFrame(list(texts.items()), "path string, text string"), 16, embed).first()["vector"]
    g = np.zeros(16)
    for (path, _), i in sorted(blocks.items()):
        g = 0.85 * g + 0.15 * unit[i] + 0.1 * holographic.convolve(holographic.path_key(path, 16), unit[i])
    assert got == pytest.approx((g / np.linalg.norm(g)).tolist())


def test_model_layers_and_snapshots(spark):
    files = spark.createDataFrame([("m/x.gguf", 1100), ("m/layer_7.bin", 5), ("m/layer_7.bin", 5), ("m/readme", 5), ("e.gguf", 0)], "file string, size long")
    assert {tuple(r) for r in graph.layer_files(files, 512).collect()} == {("m/x.gguf", 0), ("m/x.gguf", 1), ("m/x.gguf", 2), ("m/layer_7.bin", 7)}
    one, two = (spark.createDataFrame(r, "k long, digest string") for r in ([(1, "a"), (2, "b"), (3, "c")], [(2, "b"), (3, "d"), (4, "e")]))
    assert {tuple(r) for r in graph.snapshot_changes(one, two, ["k"]).collect()} == {(1, "removed"), (2, "same"), (3, "changed"), (4, "added")}


def test_layers_are_dealt_evenly(spark):
    sizes = {f"{n}.gguf": n for n in (1, 63, 64, 65, 16383, 16384, 16385, 40000)}
    got = graph.layer_files(spark.createDataFrame(list(sizes.items()), "file string, size long"), 1)
    assert got.dtypes == [("file", "string"), ("layer", "int")]
    assert sorted(tuple(r) for r in got.collect()) == sorted((f, i) for f, n in sizes.items() for i in range(n))
    one = graph.layer_files(spark.createDataFrame([("a.gguf", 9 << 20)], "file string, size long"), 1)
    at = [r[1] for r in one.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert sum(at) == 9 << 20 and max(at) <= 4 << 20
