import hashlib

from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.functions import text as T
from corpusloom.operators import chunking
from corpusloom.plans import text as plans_text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_subwords(spark):
    assert one(spark, "load_XMLTable7 flatname", T.subwords) == ["load", "xml", "table", "7", "flatname"]
    assert one(spark, "lib/io/ring_queue.rs", T.subwords) == ["lib", "io", "ring", "queue", "rs"]


def test_word_tokens_keep_camel_case(spark):
    assert one(spark, "LZ_window b7_1 camelCase", T.word_tokens) == ["lz", "window", "b7", "1", "camelcase"]


def test_fnv_known_value(spark):
    h = one(spark, "irq", lambda c: hashing.fnv1a(c))
    assert h & ((1 << 64) - 1) == 0x2BC8EC192BF7AD09


def test_fnv_matches_plain_arithmetic(spark):
    words = ["", "a", "Grüße", "x" * 50]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.fnv1a(F.col("w"), hashing.PAIR_SEED).alias("h"), hashing.slot(hashing.fnv1a(F.col("w")), 1536).alias("s")).collect()

    def plain(w, seed=0):
        h = hashing.OFFSET ^ seed
        for b in w.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h

    for r in rows:
        assert r["h"] & ((1 << 64) - 1) == plain(r["w"], hashing.PAIR_SEED)
        assert r["s"] == plain(r["w"]) % 1536


def test_gate(spark):
    skip = ["hey", "thanks a lot", "how much is 7+8", "great, ok", "i.e. release 3.7", "9 8 7 6 5", "ledger ledger ledger", " \t ", None]
    go = ["mend ring_queue", "read lib/core", "open todo.md", "ledger rounding overflow"]
    rows = spark.createDataFrame([(q,) for q in skip + go], "q string").select(T.gate("q")["decision"].alias("d")).collect()
    assert [r["d"] for r in rows] == ["skip"] * len(skip) + ["retrieve"] * len(go)


def test_path_hints(spark):
    assert one(spark, "why does ring_queue.rs block here", T.path_hints) == ["ring_queue.rs"]
    assert one(spark, "see lib\\io\\q.py; (lib/io/q.py)", T.path_hints) == ["lib/io/q.py"]
    assert one(spark, "i.e. releases 4.1 and 7.25", T.path_hints) == []


def test_defines(spark):
    yes = ["sym=1", "let sym: u8", "def sym(", "const SYM: x", "ring::sym = 4", "enum\tsym {"]
    no = ["x = sym", "sym == 2", "ring::sym", "mysym = 3", "sym::new()", "éfn sym()", None]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select(T.defines("t", "sym").alias("d")).collect()
    assert [bool(r["d"]) for r in rows] == [True] * 6 + [False] * 7


def test_defined_symbols_are_what_defines_finds(spark):
    texts = ["static const depth = 4\nlet ring: u8", "fn Push_Ring(q) {\n  q == 2; a::b = 3 }", "type größe = 1\nx : y :: z", "", None, "enum\tKind { A, B = 2 }"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["s"] for r in rows.select(T.defined_symbols("t").alias("s")).collect()]
    names = {n for g in got if g for n in g} | {"q", "a", "z", "u8", "static"}
    for n in names:
        want = [bool(r["d"]) for r in rows.select(T.defines("t", n).alias("d")).collect()]
        assert [bool(g) and n in g for g in got] == want, n
    assert set(got[0]) == {"const", "depth", "ring"}


def test_embedder_id(spark):
    assert one(spark, "local:wide-dmodel-d640", T.embedder_dim) == 640
    assert one(spark, "local:wide-dmodel-d640", T.embedder_server) == "local"
    assert one(spark, "hash-v1-d1536", T.embedder_server) is None


def test_capped_chunks():
    assert chunking.capped_chunks("") == chunking.capped_chunks(" \n\t\n") == []
    ten = "\n".join(f"line {i}" for i in range(10))
    assert [(a, b) for a, b, _ in chunking.capped_chunks(ten)] == [(1, 10)]
    got = chunking.capped_chunks("\n".join(f"l{i}" for i in range(97)), 10, 3)
    assert got[0][0] == 1 and got[1][0] == 8
    assert set(range(1, 98)) <= {n for a, b, _ in got for n in range(a, b + 1)}
    (only,) = chunking.capped_chunks("é" * 5000, cap=101)
    assert len(only[2].encode()) == 100
    long = chunking.capped_chunks("\n".join("x" * 40 for _ in range(50)), 10, 3, 100)
    assert set(range(1, 51)) <= {n for a, b, _ in long for n in range(a, b + 1)} and all(len(t.encode()) <= 100 for *_, t in long)
    assert chunking.capped_chunks("\n\nfirst\nsecond") == [(1, 4, "first\nsecond")]


def test_native_and_capped_windows_agree(spark):
    files = spark.createDataFrame([("a\\b.rs", "\n\n" + "\n".join(f"l{i}" for i in range(41))), ("c.rs", "x\r\ny\r\n"), ("d.rs", None), ("e.rs", " \n")], "path string, text string")
    one_ = sorted(map(tuple, chunking.line_windows(files, 10, 3).collect()))
    two = sorted(map(tuple, chunking.windows_with_cap(files, 10, 3).collect()))
    assert one_ == two and {r[0] for r in one_} == {"a/b.rs", "c.rs"}


def test_catalog_ids_are_dense(spark):
    files = spark.createDataFrame([(f"f{i % 7}/{i}.rs", "\n".join(f"l{j}" for j in range(i))) for i in range(1, 60)], "path string, text string")
    rows = chunking.catalog_chunks(files, window=10, overlap=3).collect()
    ordered = sorted(rows, key=lambda r: (r["path"], r["line_start"]))
    assert [r["chunk_id"] for r in ordered] == list(range(len(rows)))


def test_truncation_against_brute_force(spark):
    texts = ["", "a", "aé漢😀" * 3, "😀😀", "é" * 9, "plain ascii text", None]
    for limit in range(12):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.truncated_bytes("t", limit).alias("s")).collect()
        for r in rows:
            assert r["s"] == (None if r["t"] is None else r["t"].encode()[:limit].decode("utf-8", "ignore"))


def test_truncated_keeps_every_text(spark, tmp_path):
    texts = {1: "é" * 150, 2: "x" + "漢" * 100, 3: "a" * 300, 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "chunk_id long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["chunk_id"]: r["digest"] for r in plans_text.truncated(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(t.encode()[:200].decode("utf-8", "ignore").encode()).hexdigest() for i, t in texts.items() if t is not None}
