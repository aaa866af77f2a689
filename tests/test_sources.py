import pytest
from pyspark.sql import functions as F

from corpusloom.sources import catalog, workspace
from corpusloom.streaming import jobs


def test_workspace(spark, tmp_path):
    for name, body in {"a.c": b"int x;", "docs/b.md": b"# t", "target/c.rs": b"no", ".git/d.py": b"no", "e.png": b"\x89PNG", "f.py": b"\xff\xfe", "src/.hidden.py": b"y = 1", "src/__init__.py": b"", "big.rs": b"x" * 5000}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    rows = {r["path"]: r["text"] for r in workspace.workspace_files(spark, str(tmp_path), 4096).collect()}
    assert rows == {"a.c": "int x;", "docs/b.md": "# t", "src/.hidden.py": "y = 1", "src/__init__.py": ""}


def test_stored_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.c").write_bytes(b"int x;")
    (tmp_path / "d" / "b.c").write_bytes(b"\xff")
    assert [(r["path"], r["text"]) for r in workspace.stored_files(spark, str(tmp_path)).collect()] == [("d/a.c", "int x;")]


def test_embedding_replies(spark):
    bodies = ['{"data":[{"index":1,"embedding":[3]},{"index":0,"embedding":[1,2]}]}', '{"embedding":[5]}', '{"embeddings":[[6],[7]]}', '{"error":"x"}']
    rows = workspace.embedding_replies(spark.createDataFrame(list(enumerate(bodies)), "n int, body string")).orderBy("n", "index").collect()
    assert [(r["n"], r["index"], list(r["vector"])) for r in rows] == [(0, 0, [1, 2]), (0, 1, [3]), (1, 0, [5]), (2, 0, [6]), (2, 1, [7])]


def test_catalog_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a.rs", "fn mailbox_irq() {}\nlet x = 1;"), ("b.md", "serial port notes")], "path string, text string")
    catalog.build(files, str(tmp_path / "cat"), 64)
    tables = catalog.open_catalog(spark, str(tmp_path / "cat"), "hash-v1-d64", verify=True)
    assert tables["chunks"].count() == 2 and tables["meta"].first()["file_count"] == 2
    catalog.build(files.unionByName(spark.createDataFrame([("c.py", "z = 3")], files.schema)), str(tmp_path / "cat"), 64)
    assert catalog.open_catalog(spark, str(tmp_path / "cat"))["chunks"].count() == 3
    with pytest.raises(catalog.CatalogError):
        catalog.open_catalog(spark, str(tmp_path / "cat"), "hash-v1-d512")
    with pytest.raises(catalog.CatalogError):
        catalog.open_catalog(spark, str(tmp_path / "none"))
    with pytest.raises(catalog.CatalogError):
        catalog.build(files.limit(0), str(tmp_path / "cat2"))


def test_edit_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("src", "out", "ck"))
    one = [("a.rs", 1, "update", "x"), ("b.rs", 2, "update", "y"), ("n.png", 3, "update", "z"), ("a.rs", 4, "delete", None)]
    two = [("b.rs", 5, "update", "yy"), ("c.rs", 6, "update", None)]
    for k, rows in enumerate((one, two)):
        df = spark.createDataFrame(rows, "path string, seq long, op string, text string").withColumn("ts", F.timestamp_seconds("seq"))
        df.select("path", "seq", "op", "ts", "text").write.mode("append").parquet(src)
        jobs.stream_edits(spark, src, out, ck).awaitTermination(120)
        assert k >= 0
    rows = {r["path"]: (r["action"], r["text"]) for r in jobs.live_layer(spark, out).collect()}
    assert rows == {"a.rs": ("remove", None), "b.rs": ("ingest", "yy"), "n.png": ("ignore", "z")}


def test_activation_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in "soc")
    for part in (range(0, 15), range(15, 30)):
        rows = [(1, i, 0.95) for i in part] + [(2, i, 0.5) for i in part]
        spark.createDataFrame(rows, "cluster long, seq long, x double").withColumn("ts", F.timestamp_seconds("seq")).select("cluster", "seq", "ts", "x").coalesce(1).write.mode("append").parquet(src)
        jobs.stream_activations(spark, src, out, ck).awaitTermination(120)
    last = {r["cluster"]: r for r in spark.read.parquet(out).orderBy("n").collect()}
    assert last[1]["n"] == 30 and last[1]["first_fault"] == 21 and last[2]["first_fault"] == -1


def test_catalog_keeps_weights_gist_and_partitions(spark, tmp_path, monkeypatch):
    from corpusloom.operators import dense

    monkeypatch.setattr(dense, "MIN_PARTITIONED", 50)
    files = spark.createDataFrame([(f"d{i % 3}/f{i}.rs", f"fn item{i}() ring{i % 5} queue{i % 4}") for i in range(80)], "path string, text string")
    version = catalog.build(files, str(tmp_path / "c"), 64)
    tables = catalog.open_catalog(spark, str(tmp_path / "c"), verify=True)
    assert tables["vectors"].select("part").distinct().count() > 1 and tables["weights"].count() == 64 and version.endswith("v-00000001")
    q = spark.createDataFrame([(1, "item7 ring2")], "q long, text string")
    full = [r["id"] for r in catalog.search(tables, q, 3).orderBy("rank").collect()]
    some = [r["id"] for r in catalog.search(tables, q, 3, probes=4).orderBy("rank").collect()]
    assert full[0] == some[0] and tables["chunks"].where(f"chunk_id = {full[0]}").first()["path"].endswith("f7.rs")
    # A build that stops before its metadata is not seen.
    (tmp_path / "c" / "v-00000002" / "chunks").mkdir(parents=True)
    assert catalog.open_catalog(spark, str(tmp_path / "c"))["chunks"].count() == 80
    with pytest.raises(Exception, match="elements"):
        catalog.checked(spark.createDataFrame([([1.0],)], "vector array<double>"), 2).collect()


def test_seals(spark, tmp_path):
    good = workspace.sealed(b"body" * 10)
    for name, data in {"good": good, "bad": b"x" + good[1:], "short": b"tiny"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["sealed"], r["intact"]) for r in workspace.sealed_files(spark, str(tmp_path)).collect()}
    assert got == {"good": (True, True), "bad": (True, False), "short": (False, False)}


def test_legacy_tensor_and_discovery(spark, tmp_path, monkeypatch):
    import numpy as np

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "v.bin").write_bytes(b"MAGC{}" + np.arange(4, dtype="<f4").tobytes())
    (tmp_path / "t" / "s.bin").write_bytes(b"MAGC{}")
    rows = {r["path"].rsplit("/", 1)[1]: r["vector"] for r in workspace.legacy_tensor(spark, str(tmp_path / "t"), 4).collect()}
    assert list(rows["v.bin"]) == [0, 1, 2, 3] and rows["s.bin"] is None
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / ".catalog").mkdir()
    assert workspace.find_catalog(str(deep)) == str(tmp_path / ".catalog")
    monkeypatch.setenv("LOOM_CATALOG", "/elsewhere")
    assert workspace.find_catalog(str(deep)) == "/elsewhere"


def test_burst_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in "soc")
    batches = [[("a", 1000), ("a", 1300), ("b", 1100)], [("a", 1900), ("b", 1200)], [("z", 20_000)], [("z", 40_000)]]
    for rows in batches:
        spark.createDataFrame(rows, "path string, ms long").select("path", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_bursts(spark, src, out, ck, 500).awaitTermination(120)
    got = {(r["path"], r["f"], r["l"], r["touches"]) for r in spark.read.parquet(out).selectExpr("path", "unix_millis(first_ts) AS f", "unix_millis(last_ts) AS l", "touches").collect()}
    assert got == {("a", 1000, 1300, 2), ("a", 1900, 1900, 1), ("b", 1100, 1200, 2), ("z", 20_000, 20_000, 1)}


def test_fault_phases(spark):
    rows = spark.createDataFrame([(1, i, 1.0) for i in range(9)] + [(2, i, 0.1) for i in range(9)], "cluster long, seq long, x double")
    got = [(r["seq"], r["before"], r["phase"]) for r in jobs.fault_phases(rows, 0.5, 0.85, 2).orderBy("seq").collect()]
    assert got == [(2, "monitoring", "fault_detected"), (3, "fault_detected", "inflating"), (5, "inflating", "monitoring"), (6, "monitoring", "fault_detected"), (7, "fault_detected", "inflating")]


def test_command_line(spark, tmp_path, capsys):
    import json

    from corpusloom.__main__ import main

    for name, body in {"lib/ring.rs": "fn push_ring(queue) {}\nlet depth = 3;\n", "doc/notes.md": "the ring queue overflows when depth is small\n", "app.py": "def serve(port):\n    return port\n"}.items():
        p = tmp_path / "w" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    out = str(tmp_path / "c")
    assert main(["build", str(tmp_path / "w"), "--out", out, "--dim", "64"], spark) == 0
    capsys.readouterr()
    assert main(["query", out, "why does the ring queue overflow", "--k", "2"], spark) == 0
    assert capsys.readouterr().out.startswith("── ")
    assert main(["query", out, "ring queue depth", "--scope", "notes.md", "--json"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["faulted"] and [h["path"] for h in got["hits"]] == ["doc/notes.md"]
    assert main(["define", out, "serve"], spark) == 0 and "app.py:1-2" in capsys.readouterr().out
    assert main(["stats", out], spark) == 0 and "file_count: 3" in capsys.readouterr().out
    assert main(["stats", str(tmp_path / "none")], spark) == 1
