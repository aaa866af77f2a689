"""Retrieval: lexical and dense scoring, candidate limits, cutoffs, budgets and rendering.

Queries are the small side: a benchmark or a request batch. They are shipped to the workers in sets
of at most SMALL_ROWS, one pass over the collection for each set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import token_estimate, word_tokens
from corpusloom.session import cut

SMALL_ROWS = 200_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_per(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key with their rank; ties by `tie`. NaN and null scores are left
    out. The rank filter becomes a group limit before the shuffle."""
    w = W.partitionBy(key).orderBy(F.col(score).desc(), tie)
    good = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    return good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Lexicon:
    """Term counts of a collection for the terms of a query set, with the statistics of the whole
    collection. `lists` is a table of (chunk, dl, terms, tfs), a row a chunk with any of the
    terms; term numbers index `terms`."""

    def __init__(self, chunks: DataFrame, terms: list[str]) -> None:
        self.terms, spark = terms, chunks.sparkSession
        wanted = pa.array(terms, pa.string())
        kind = chunks.schema["chunk"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, n, total = ["chunk", "dl", "terms", "tfs"], 0, 0
            for batch in batches:
                words = batch.column(1)
                sizes = np.diff(words.offsets.to_numpy())
                n, total = n + len(sizes), total + int(sizes.sum())
                coded = words.flatten().dictionary_encode()
                place = pc.index_in(coded.dictionary, wanted).fill_null(-1).to_numpy(zero_copy_only=False)
                code = place[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
                at, tf = np.unique(row * max(1, len(terms)) + code[code >= 0], return_counts=True)
                row, code = at // max(1, len(terms)), at % max(1, len(terms))
                held, first = np.unique(row, return_index=True)
                ends = pa.array(np.append(first, len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (code, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), pa.array(sizes[held].astype(np.int64)), *lists], names)
            empty = pa.nulls(1, self_kind)
            yield pa.RecordBatch.from_arrays([empty, pa.array([total]), pa.array([[n]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32()))], names)

        self_kind = pa.int64() if kind == "bigint" else pa.string()
        tokens = chunks.select("chunk", F.coalesce(word_tokens("text"), F.array().cast("array<string>")).alias("ts"))
        table = cut(tokens.mapInArrow(run, f"chunk {kind}, dl long, terms array<int>, tfs array<int>"), "term-lists")
        self.lists = table.where("chunk IS NOT NULL")
        n, total = table.where("chunk IS NULL").agg(F.sum(F.col("terms")[0].cast("long")), F.sum("dl")).first()
        self.n = max(n or 0, 1)
        self.avgdl = max((total or 0) / self.n, 1.0)
        df = np.zeros(len(terms))
        for r in self.lists.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a query term
            df[r["t"]] = r["count"]
        self.idf = np.log((self.n - df + 0.5) / (df + 0.5) + 1)
        self.spark = spark


#: Queries that are scored together against a batch of chunks.
TOGETHER = 256


def bm25_blocks(queries: DataFrame) -> Iterator[tuple[list, list[str], list[np.ndarray]]]:
    """(ids, terms, term numbers of each query) of query sets of at most SMALL_ROWS query terms'
    queries each, whatever the number of queries (item_id, text)."""
    asked = queries.select("item_id", F.array_distinct(word_tokens("text")).alias("ts")).where("item_id IS NOT NULL AND size(ts) > 0")
    weight = asked.agg(F.sum(F.size("ts"))).first()[0] or 0
    sets = max(1, -(-weight // SMALL_ROWS))
    for i in range(sets):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == i).groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("ts")).collect()
        terms = sorted({t for r in rows for t in r["ts"]})
        number = {t: k for k, t in enumerate(terms)}
        rows = sorted(rows, key=lambda r: r["item_id"])
        yield [r["item_id"] for r in rows], terms, [np.array([number[t] for t in r["ts"]], np.int64) for r in rows]


def bm25_hits(lexicon: Lexicon, ids: list, asked: list[np.ndarray], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(item_id, chunk, score): of each Arrow batch of chunks the k best of every query, ties at the
    k-th place all included. A batch is scored against TOGETHER queries at a time: the saturated
    counts times the queries' weights are summed by chunk."""
    idf, avgdl, width = lexicon.idf, lexicon.avgdl, len(lexicon.terms)
    kind = lexicon.lists.schema["chunk"].dataType.simpleString()
    keys = np.array(ids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy(zero_copy_only=False)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            dl = batch.column(1).to_numpy(zero_copy_only=False)[row]
            part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            for s in range(0, len(keys), TOGETHER):
                mine = asked[s : s + TOGETHER]
                has = np.zeros((width, len(mine)))
                for q, terms in enumerate(mine):
                    has[terms, q] = 1
                score = np.zeros((batch.num_rows, len(mine)))
                for a in range(0, len(row), 65_536):
                    r, weights = row[a : a + 65_536], has[term[a : a + 65_536]] * part[a : a + 65_536, None]
                    first = np.flatnonzero(np.diff(r, prepend=-1))
                    score[r[first]] += np.add.reduceat(weights, first)
                score = score.T
                bar = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])] - 1e-6
                i, j = np.nonzero((score >= bar[:, None]) & (score > 0))
                yield pa.RecordBatch.from_arrays([pa.array(keys[s + i]), batch.column(0).take(pa.array(j)), pa.array(score[i, j])], ["item_id", "chunk", "score"])

    found = lexicon.lists.mapInArrow(run, f"item_id long, chunk {kind}, score double")
    return found.withColumn("score", F.round("score", 6))


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(item_id, chunk, score, rank): the k best of chunks (chunk, text) for each query (item_id, text).
    Texts are tokenised once, in a narrow pass that keeps the counts of query terms; statistics
    are over all chunks. Chunks without any query term have no score; neither have queries
    without terms."""
    parts = [bm25_hits(Lexicon(chunks, terms), ids, asked, k) for ids, terms, asked in bm25_blocks(queries)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top_per(found, "item_id", "score", "chunk", k)


def bm25_of(lexicon: Lexicon, ids: list, asked: list[np.ndarray], pairs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(item_id, chunk, score) of given pairs (item_id, chunk); pairs without a common term have no
    row. At most a query's candidates a query, joined to the term lists by chunk."""
    idf, avgdl, number = lexicon.idf, lexicon.avgdl, {q: t for q, t in zip(ids, asked, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, dl, terms, tfs in zip(*(batch.column(c).to_pylist() for c in ("item_id", "dl", "terms", "tfs")), strict=True):
                term, tf = np.array(terms), np.array(tfs, float)
                part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                out.append(float(part[np.isin(term, number.get(q, []))].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("chunk"), pa.array(out, pa.float64())], ["item_id", "chunk", "score"])

    kind = lexicon.lists.schema["chunk"].dataType.simpleString()
    joined = lexicon.lists.join(small_side(pairs.select("item_id", "chunk")), "chunk").select("item_id", "chunk", "dl", "terms", "tfs")
    return joined.mapInArrow(run, f"item_id long, chunk {kind}, score double").where("score > 0").withColumn("score", F.round("score", 6))


def budget_fold(cand: DataFrame, key: str, threshold: float = 0.05, relative: float = 0.6, max_chunks: int = 8, token_budget: int = 6000, stops: bool = True) -> DataFrame:
    """(key, accepted, spent, dropped): a greedy fold over each key's candidates in rank order.

    The fold stops at the first score under max(threshold, best * relative), or with stops=False
    never, for candidates that were admitted before. A candidate is
    dropped when max_chunks are taken or the budget would be passed (a later, smaller one may
    still fit), and passed over without being counted when its line range meets an accepted one
    of its path. Candidates are limited per key before, so the folded array is short. Columns of
    cand: key, rank, score, chunk, path, line_start, line_end, tokens."""
    item = F.struct("rank", "score", "chunk", "path", "line_start", "line_end", F.col("tokens").cast("int").alias("tokens"))
    rows = cand.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("cs"), F.max("score").alias("best"))
    kind = "array<struct<chunk:string,path:string,a:int,b:int,score:double>>"
    start = F.struct(
        F.from_json(F.lit("[]"), kind).alias("accepted"), F.lit(0).alias("spent"), F.lit(0).alias("dropped"), F.lit(False).alias("stopped")
    )
    bar = F.greatest(F.lit(threshold), F.col("best") * min(max(relative, 0.0), 1.0))

    def step(s, c):
        stop = (s["stopped"] | (c["score"] < bar)) if stops else F.lit(False)
        full = F.size(s["accepted"]) >= max_chunks
        poor = s["spent"] + c["tokens"] > token_budget
        over = F.exists(s["accepted"], lambda t: (t["path"] == c["path"]) & (t["a"] <= c["line_end"]) & (t["b"] >= c["line_start"]))
        take = ~stop & ~full & ~poor & ~over
        new = F.array(F.struct(c["chunk"].alias("chunk"), c["path"].alias("path"), c["line_start"].alias("a"), c["line_end"].alias("b"), c["score"].alias("score")))
        return F.struct(
            F.when(take, F.concat(s["accepted"], new)).otherwise(s["accepted"]).alias("accepted"),
            (s["spent"] + F.when(take, c["tokens"]).otherwise(0)).alias("spent"),
            (s["dropped"] + F.when(~stop & (full | poor), 1).otherwise(0)).alias("dropped"),
            stop.alias("stopped"),
        )

    return rows.select(key, F.aggregate("cs", start, step).alias("f")).select(key, "f.accepted", "f.spent", "f.dropped")


def with_texts(folded: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, hits): hits in rank order as structs of chunk, path, line_start, line_end, score, tokens
    and text; an empty array without hits. Texts are looked up for accepted hits only."""
    hits = folded.select(key, F.posexplode("accepted").alias("at", "h"))
    named = chunks.select(F.col("chunk").cast("string").alias("hit_chunk"), "text")
    texts = named.join(small_side(hits), F.col("h.chunk") == F.col("hit_chunk"))
    item = F.struct("at", F.col("h.chunk").alias("chunk"), F.col("h.path").alias("path"), F.col("h.a").alias("line_start"), F.col("h.b").alias("line_end"), F.col("h.score").alias("score"), token_estimate("text").alias("tokens"), "text")
    packed = texts.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("hits"))
    none = F.from_json(F.lit("[]"), packed.schema["hits"].dataType)
    return folded.select(key).join(packed, key, "left").select(key, F.transform(F.coalesce("hits", none), lambda h: h.dropFields("at")).alias("hits"))


def context_block(hits: Column) -> Column:
    """The hits as a block of citations and texts between a preamble and a trailer; an empty string
    without hits."""
    one = lambda h: F.format_string("\n--- %s:%d-%d (similarity %.3f) ---\n%s\n", h["path"], h["line_start"], h["line_end"], h["score"], h["text"])
    body = F.array_join(F.transform(hits, one), "")
    return F.when(F.size(hits) == 0, "").otherwise(F.concat(F.lit("Relevant excerpts from the workspace:\n"), body, F.lit("\nEnd of excerpts.\n")))


def tool_block(hits: Column) -> Column:
    """The hits as a tool's answer: a header line and the text of each, without blanks at the end."""
    one = lambda h: F.format_string("── %s:%d-%d  (score %.3f)\n%s\n\n", h["path"], h["line_start"], h["line_end"], h["score"], h["text"])
    return F.regexp_replace(F.array_join(F.transform(hits, one), ""), r"\s+$", "")


def render_context(folded: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, context) of folded candidates, see context_block."""
    return with_texts(folded, chunks, key).select(key, context_block(F.col("hits")).alias("context"))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, part: str | None = None, allow: Callable[[list], Callable] | None = None) -> DataFrame:
    """(q, id, score, rank): the k best inner products of vectors (id, vector) for each query (q,
    vector). Queries are scored in sets of at most SMALL_ROWS: each Arrow batch is one matrix
    product, of which only a query's k best leave the batch.

    With `part`, a column of vectors, and `allow`, rows are scored only for some queries:
    allow(query rows) gives a function from a value of the part to the queries that may see it."""
    sets = max(1, -(-queries.count() // SMALL_ROWS))
    found = None
    for i in range(sets):
        mine = queries if sets == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(sets)) == i)
        hits = _dense_hits(vectors, mine, k, part, allow)
        found = hits if found is None else found.unionByName(hits)
    return top_per(found.withColumn("score", F.round("score", 6)), "q", "score", "id", k)


def _dense_hits(vectors: DataFrame, queries: DataFrame, k: int, part: str | None, allow: Callable[[list], Callable] | None) -> DataFrame:
    rows = sorted(queries.where("q IS NOT NULL AND vector IS NOT NULL").collect(), key=lambda r: r["q"])
    ids = np.array([r["q"] for r in rows], np.int64)
    mats = {}
    for n in {len(r["vector"]) for r in rows}:
        at = [i for i, r in enumerate(rows) if len(r["vector"]) == n]
        mats[n] = (ids[at], np.array([rows[i]["vector"] for i in at], np.float64))
    seen_by = allow(rows) if allow else None
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(sizes)))
            coded = batch.column(2).dictionary_encode() if part else None
            values = coded.dictionary.to_pylist() if part else [None]
            code = coded.indices.to_numpy(zero_copy_only=False) if part else np.zeros(len(sizes), np.int64)
            for p, value in enumerate(values):
                seen = seen_by(value) if part else None
                if seen is not None and not len(seen):
                    continue
                for n, (qs, m) in mats.items():
                    at = np.flatnonzero((sizes == n) & (code == p))
                    use = np.arange(len(qs)) if seen is None else np.flatnonzero(np.isin(qs, seen))
                    if not len(at) or not len(use):
                        continue
                    x = flat[(starts[at][:, None] + np.arange(n)[None, :]).ravel()].reshape(len(at), n)
                    for s in range(0, len(use), 1024):
                        score = m[use[s : s + 1024]] @ x.T
                        score = np.where(np.isfinite(score), score, -np.inf)
                        # Ties beyond the k-th place must all leave the batch; the final rank settles them.
                        bar = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])] - 1e-6
                        i, j = np.nonzero((score >= bar[:, None]) & np.isfinite(score))
                        yield pa.RecordBatch.from_arrays([pa.array(qs[use[s + i]]), batch.column(0).take(pa.array(at[j])), pa.array(score[i, j])], ["q", "id", "score"])

    found = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector", *([part] if part else []))
    return found.mapInArrow(run, f"q long, id {kind}, score double")


def in_parts(picked: DataFrame) -> Callable[[list], Callable]:
    """For dense_top: queries see the parts of (q, part). A query's few parts each are collected."""

    def allow(rows: list) -> Callable:
        asked = {r["q"] for r in rows}
        wanted: dict = {}
        for r in picked.collect():
            if r["q"] in asked:
                wanted.setdefault(r["part"], []).append(r["q"])
        held = {p: np.array(qs, np.int64) for p, qs in wanted.items()}
        return lambda value: held.get(value, ())

    return allow


def in_scope(rows: list) -> Callable:
    """For dense_top: queries, which bring an array of hints, see the paths that contain any non-empty
    hint. All hints are looked for at once where the automaton is installed."""
    hints: dict[str, list[int]] = {}
    for r in rows:
        for h in r["hints"] or []:
            if h:
                hints.setdefault(h, []).append(r["q"])

    def seen_by(path: str | None) -> np.ndarray:
        out: set[int] = set()
        if path:
            for h in _contained(path, hints):
                out.update(hints[h])
        return np.array(sorted(out), np.int64)

    return seen_by


def scoped_requests(paths: DataFrame, queries: DataFrame) -> DataFrame:
    """(q): the queries (q, hints) of which some path (path) contains a hint; one narrow pass over the
    paths for each set of at most SMALL_ROWS queries."""
    sets = max(1, -(-queries.count() // SMALL_ROWS))
    found = None
    for i in range(sets):
        mine = queries if sets == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(sets)) == i)
        seen_by = in_scope(mine.select("q", "hints").collect())

        def run(batches: Iterator[pa.RecordBatch], seen_by=seen_by) -> Iterator[pa.RecordBatch]:
            out: set[int] = set()
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    out.update(seen_by(path).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.int64())], ["q"])

        part = paths.select("path").mapInArrow(run, "q long")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _contained(path: str, hints: dict[str, list[int]]) -> Iterator[str]:
    try:
        import ahocorasick
    except ImportError:
        yield from (h for h in hints if h in path)
        return
    known = _AUTOMATA.get(id(hints))
    if known is None or known[0] is not hints:
        automaton = ahocorasick.Automaton()
        for h in hints:
            automaton.add_word(h, h)
        if hints:
            automaton.make_automaton()
        _AUTOMATA.clear()
        known = _AUTOMATA[id(hints)] = (hints, automaton)
    if hints:
        yield from {h for _, h in known[1].iter(path)}


_AUTOMATA: dict[int, tuple] = {}
