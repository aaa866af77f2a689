"""Composite retrieval: candidates, admission, budget fold and result, for batches of requests.

Chunks are (chunk, path, line_start, line_end, text, tokens); requests (q, text); their vectors (id,
path, vector) and (q, vector). Every step after the candidate search works on at most a few dozen
rows a request. A request without hits has a result all the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import DECLARATIONS, gate, path_hints, word_tokens
from corpusloom.operators.dense import sum_of
from corpusloom.operators.search import Lexicon, bm25_blocks, bm25_hits, bm25_of, budget_fold, context_block, dense_top, in_scope, scoped_requests, small_side, top_per, with_texts
from corpusloom.session import cut


@dataclass(frozen=True)
class Limits:
    """Limits of a request: lowest score, part of the best score, candidates, hits and tokens."""

    threshold: float = 0.05
    relative: float = 0.6
    candidates: int = 48
    max_chunks: int = 8
    token_budget: int = 6000


# Weight of the lexical score, bonus of a definition, lowest trusted best score, and lowest score that admits.
LEXICAL_WEIGHT, DEFINITION_BONUS, TRUSTED, ADMITS = 1.5, 1.0, 0.5, 2.5


def gist_scores(gist: np.ndarray, queries: DataFrame) -> DataFrame:
    """(q, gist_score): inner product of each request's vector with the collection's gist."""
    g = F.array(*[F.lit(float(x)) for x in gist])
    dot = F.aggregate(F.zip_with("vector", g, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return queries.select("q", F.round(dot, 6).alias("gist_score"))


def unit_gist(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, unit mean) of a collection."""
    n, total = sum_of(vectors)
    length = np.linalg.norm(total)
    return n, total / length if np.isfinite(length) and length > 0 else np.zeros_like(total)


def live_gist(gist: np.ndarray, n: int, live: DataFrame) -> np.ndarray:
    """The gist with live vectors added to n base vectors' worth of it; hidden base rows are not taken
    out, since a unit mean does not hold their sum. Without live rows it is the base's."""
    _, total = sum_of(live)
    if not len(total):
        return gist
    both = gist * max(n, 1) + total
    length = np.linalg.norm(both)
    return both / length if np.isfinite(length) and length > 0 else np.zeros_like(both)


def scoped_candidates(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, id, score, rank): dense candidates among the paths that contain one of the request's hints.
    queries is (q, vector, hints). Requests whose hints match no path have no rows."""
    return dense_top(vectors, queries, k, "path", in_scope)


def with_fallback(scoped: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Scoped candidates, and for requests without any those of the whole collection."""
    kept = cut(scoped, "scoped")
    rest = queries.join(small_side(kept.select("q").distinct()), "q", "left_anti")
    return kept.unionByName(dense_top(vectors, rest, k))


def fault(cand: DataFrame, queries: DataFrame, chunks: DataFrame, gist: DataFrame, limits: Limits, admitted: bool = False) -> DataFrame:
    """(q, faulted, best_score, cutoff, gist_score, injected_tokens, dropped, hits): the result of each
    request. cand is (q, chunk, score, rank, path, line_start, line_end, tokens). Candidates stop
    at the cutoff, the best score's part but no less than the threshold; `admitted` ones were
    tested before, and their reported cutoff is the threshold."""
    kept = cut(cand, "candidates")
    folded = cut(budget_fold(kept, "q", limits.threshold, limits.relative, limits.max_chunks, limits.token_budget, stops=not admitted), "folded")
    best = kept.groupBy("q").agg(F.max("score").alias("best"))
    hits = with_texts(folded, chunks, "q")
    rows = queries.select("q").join(gist, "q", "left").join(best, "q", "left").join(folded.select("q", "spent", "dropped"), "q", "left").join(hits, "q", "left")
    top = F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0))) if admitted else F.coalesce("best", F.lit(0.0))
    bar = F.lit(limits.threshold) if admitted else F.greatest(F.lit(limits.threshold), top * min(max(limits.relative, 0.0), 1.0))
    none = F.from_json(F.lit("[]"), hits.schema["hits"].dataType)
    listed = F.coalesce("hits", none)
    return rows.select(
        "q", (F.size(listed) > 0).alias("faulted"), top.alias("best_score"), F.round(bar, 6).alias("cutoff"), "gist_score",
        F.coalesce("spent", F.lit(0)).alias("injected_tokens"), F.coalesce("dropped", F.lit(0)).alias("dropped"), listed.alias("hits"),
    )


def located(cand: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates (q, id, score, rank) with the place and tokens of their chunks."""
    place = chunks.select("chunk", "path", "line_start", "line_end", "tokens")
    return place.join(small_side(cand.select("q", F.col("id").alias("chunk"), "score", "rank")), "chunk")


def page_fault(vectors: DataFrame, chunks: DataFrame, queries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Dense retrieval, see fault. With a column of hints, queries are held to the paths that contain
    one of theirs, or to nothing if no path does."""
    _, gist = unit_gist(vectors)
    if "hints" in queries.columns:
        cand = with_fallback(scoped_candidates(vectors, queries, limits.candidates), vectors, queries, limits.candidates)
    else:
        cand = dense_top(vectors, queries, limits.candidates)
    return fault(located(cand, chunks), queries, chunks, gist_scores(gist, queries), limits)


def definitions_pattern(symbols: Column) -> Column:
    """Regular expression for lower-cased text with a line that declares or assigns one of the symbols, which
    are runs of letters or digits in lower case; null without symbols."""
    keys, one = "|".join(DECLARATIONS), F.array_join(symbols, "|")
    pattern = F.concat(F.lit(rf"(?m)(^|[^\p{{L}}\p{{N}}_])({keys})[ \t]+("), one, F.lit(r")($|[^a-z0-9_])|(^|[^a-z0-9_])("), one, F.lit(r")[ \t]*(=($|[^=])|:($|[^:]))"))
    return F.when(F.size(symbols) > 0, pattern)


def hybrid_candidates(dense: DataFrame, chunks: DataFrame, queries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(q, chunk, score, rank, dense, lexical, defines): admitted candidates of both channels, by the sum
    of the dense score, the lexical score over the request's best (where that is trusted) times
    its weight, and a bonus for defining a word of the request.

    Candidates are the dense ones (q, id, score) and as many by BM25 over all chunks; each brings
    its score in the other channel as well, the lexical one whatever its place. Admitted are
    those at the dense cutoff, with a lexical score that a rare word must have given, or with a
    definition."""
    near = cut(dense.select("q", F.col("id").alias("chunk"), F.col("score").alias("dense")), "dense-candidates")
    parts = []
    asked_text = queries.select(F.col("q").alias("item_id"), "text")
    for ids, terms, asked in bm25_blocks(asked_text):
        lexicon = Lexicon(chunks.select("chunk", "text"), terms)
        top = top_per(bm25_hits(lexicon, ids, asked, limits.candidates), "item_id", "score", "chunk", limits.candidates)
        other = bm25_of(lexicon, ids, asked, near.select(F.col("q").alias("item_id"), "chunk"))
        parts += [top.select("item_id", "chunk", "score"), other.select("item_id", "chunk", "score")]
    lexical = parts[0]
    for p in parts[1:]:
        lexical = lexical.unionByName(p)
    lexical = cut(lexical.distinct().select(F.col("item_id").alias("q"), "chunk", F.col("score").alias("lexical")), "lexical-candidates")
    both = near.join(lexical, ["q", "chunk"], "full_outer").fillna(0.0, ["dense", "lexical"])
    best = W.partitionBy("q")
    both = both.withColumns({"top": F.max("lexical").over(best), "bar": F.greatest(F.lit(limits.threshold), F.max("dense").over(best) * min(max(limits.relative, 0.0), 1.0))})
    patterns = queries.select("q", definitions_pattern(F.filter(F.array_distinct(word_tokens("text")), lambda t: F.octet_length(t) >= 4)).alias("pattern"))
    # A request's pattern is compiled once for all its candidates, which come one after the other.
    texts = chunks.select("chunk", "text").join(small_side(both), "chunk").join(small_side(patterns), "q").repartition("q").sortWithinPartitions("q")
    flagged = texts.withColumn("defines", F.when(F.rlike(F.lower("text"), F.col("pattern")), 1.0).otherwise(0.0)).drop("text", "pattern")
    norm = F.when(F.col("top") > TRUSTED, F.col("lexical") / F.col("top")).otherwise(0.0)
    scored = flagged.withColumn("score", F.round(F.col("dense") + LEXICAL_WEIGHT * norm + DEFINITION_BONUS * F.col("defines"), 6))
    kept = scored.where((F.col("dense") >= F.col("bar")) | (F.col("lexical") >= ADMITS) | (F.col("defines") > 0))
    order = W.partitionBy("q").orderBy(F.col("score").desc(), "chunk")
    return kept.select("q", "chunk", "score", F.row_number().over(order).alias("rank"), "dense", "lexical", "defines")


def hybrid_fault(vectors: DataFrame, chunks: DataFrame, queries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Hybrid retrieval, see hybrid_candidates and fault. queries is (q, text, vector)."""
    _, gist = unit_gist(vectors)
    cand = hybrid_candidates(dense_top(vectors, queries, limits.candidates), chunks, queries, limits)
    place = chunks.select("chunk", "path", "line_start", "line_end", "tokens").join(small_side(cand), "chunk")
    return fault(place, queries, chunks, gist_scores(gist, queries), limits, admitted=True)


def live_candidates(base: DataFrame, delta: DataFrame, shadowed: DataFrame, queries: DataFrame, limits: Limits, scoped: bool) -> DataFrame:
    """(q, id, score, rank, origin): twice the candidates of the base without those on shadowed paths,
    and the candidates of the live layer, by score; of equal ones the base first. The scope holds
    the base before its ranking and the live layer after its own. base is (id, path, vector),
    delta (id, path, line_start, vector)."""
    k = limits.candidates
    old = scoped_candidates(base, queries, 2 * k) if scoped else dense_top(base, queries, 2 * k)
    old = base.select("id", "path").join(small_side(old), "id").join(shadowed.select("path"), "path", "left_anti")
    new = dense_top(delta, queries, k)
    new = delta.select("id", "path").join(small_side(new), "id")
    if scoped:
        hints = queries.select("q", "hints")
        new = new.join(small_side(hints), "q").where(F.exists("hints", lambda h: (h != "") & F.col("path").contains(h))).drop("hints")
    both = old.withColumn("origin", F.lit("base")).unionByName(new.withColumn("origin", F.lit("delta")))
    order = W.partitionBy("q").orderBy(F.col("score").desc(), "origin", "rank")
    return both.select("q", "id", "score", "origin", F.row_number().over(order).alias("rank"))


def live_page_fault(base: DataFrame, base_chunks: DataFrame, delta: DataFrame, delta_chunks: DataFrame, shadowed: DataFrame, queries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Dense retrieval over a base and its live layer, see live_candidates and fault. With a column of
    hints, requests are scoped; where neither layer has a path that matches, they are not. Chunk
    names of the two layers must differ. The gist is the live one."""
    chunks = base_chunks.select("chunk", "path", "line_start", "line_end", "text", "tokens").unionByName(delta_chunks.select("chunk", "path", "line_start", "line_end", "text", "tokens"))
    if "hints" in queries.columns:
        paths = base_chunks.select("path").unionByName(delta_chunks.select("path")).distinct()
        matched = cut(scoped_requests(paths, queries), "matched")
        inside = cut(queries.join(matched, "q", "left_semi"), "scoped-requests")
        rest = cut(queries.join(matched, "q", "left_anti").drop("hints"), "open-requests")
        cand = live_candidates(base, delta, shadowed, inside, limits, True).unionByName(live_candidates(base, delta, shadowed, rest, limits, False))
    else:
        cand = live_candidates(base, delta, shadowed, queries, limits, False)
    n, gist = unit_gist(base)
    return fault(located(cand, chunks), queries, chunks, gist_scores(live_gist(gist, n, delta), queries), limits)


MARKER = "Relevant excerpts from the workspace:"


def context_for(base: DataFrame, base_chunks: DataFrame, delta: DataFrame, delta_chunks: DataFrame, shadowed: DataFrame, queries: DataFrame, limits: Limits = Limits(), hybrid: bool = True) -> DataFrame:
    """(q, route, hits, context): what each request (q, text, vector) is answered with. The gate decides
    from the text alone, and a request that carries a context already is left alone (route skip);
    requests that name paths go to the live layer within their scope (live), others to both channels
    of the base (hybrid), or with hybrid=False to the live layer. No hits give no context. The
    hits' chunks are what access heat counts."""
    decided = queries.withColumns({"go": (gate("text")["decision"] == "retrieve") & ~F.coalesce(F.col("text").contains(MARKER), F.lit(False)), "hints": F.coalesce(path_hints("text"), F.array().cast("array<string>"))})
    decided = cut(decided, "requests")
    named = decided.where("go AND size(hints) > 0").drop("go")
    plain = decided.where("go AND size(hints) = 0").drop("go", "hints")
    live = live_page_fault(base, base_chunks, delta, delta_chunks, shadowed, named, limits).withColumn("route", F.lit("live"))
    if hybrid:
        other = hybrid_fault(base, base_chunks, plain, limits).withColumn("route", F.lit("hybrid"))
    else:
        other = live_page_fault(base, base_chunks, delta, delta_chunks, shadowed, plain, limits).withColumn("route", F.lit("live"))
    found = live.unionByName(other).select("q", "route", F.transform("hits", lambda h: h["chunk"]).alias("hits"), context_block(F.col("hits")).alias("context"))
    none = decided.where("NOT go").select("q", F.lit("skip").alias("route"), F.array().cast("array<string>").alias("hits"), F.lit("").alias("context"))
    return found.unionByName(none)


def result_json(result: DataFrame) -> DataFrame:
    """(q, result): each request's result as a JSON object, its context included."""
    fields = ["faulted", "best_score", "gist_score", "injected_tokens", F.col("dropped").alias("dropped_to_budget")]
    hits = F.transform("hits", lambda h: F.struct(h["chunk"].alias("chunk_id"), h["path"].alias("path"), h["line_start"].alias("line_start"), h["line_end"].alias("line_end"), h["score"].alias("score"), h["tokens"].alias("token_estimate"), h["text"].alias("text")))
    return result.select("q", F.to_json(F.struct(*fields, hits.alias("hits"), context_block(F.col("hits")).alias("context"))).alias("result"))
