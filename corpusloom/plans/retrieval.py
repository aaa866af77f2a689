"""Queries on composite retrieval: hash embeddings, dense, scoped, hybrid and live search, end to end.

The collection is the table of chunks, by its own texts; the requests are the documents whose id is
divisible by 50; the live layer are the code patches, the newest of each path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.functions import text as T
from corpusloom.operators import chunking, dense, retrieval, search
from corpusloom.plans import text as texts
from corpusloom.registry import Registry
from corpusloom.session import cut, table

REGISTRY = Registry()
DIM = 256
LIMITS = retrieval.Limits(token_budget=1500)


# ---- the collection in SQL ------------------------------------------------------------------
def _sub(x: str) -> str:
    for pattern in (r"(\p{Lu})(\p{Lu}\p{Ll})", r"([\p{Ll}])(\p{Lu})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        x = rf"regexp_replace({x}, '{pattern}', '\1 \2', 'g')"
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def _hashed(seed: int) -> str:
    return f"list_reduce(list_prepend({hashing.OFFSET ^ seed}::UHUGEINT, b), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


CATALOG = r"""cat AS (SELECT chunk_id::VARCHAR AS chunk, regexp_replace(max(replace(path, '\', '/')), '^(\./)+', '') AS path,
  coalesce(min(least(line_start, line_end)), 1)::INT AS line_start, coalesce(max(greatest(line_start, line_end)), min(least(line_start, line_end)), 1)::INT AS line_end,
  max(text) AS text, greatest(1, ceil(strlen(max(text)) / 3.2))::INT AS tokens FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id HAVING max(path) IS NOT NULL)"""
REQUESTS = "req AS (SELECT doc_id AS q, max(text) AS text FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL GROUP BY doc_id)"


def _embedding(name: str, source: str, path: bool, weights: str | None = None) -> str:
    """CTEs {name}_v(key, slot, x): weighted unit vectors in sparse form; weights from `weights` or itself."""
    w = weights or name
    parts = [("text", 1.0)] + ([("path", 2.0)] if path else [])
    words = ", ".join(f"coalesce({_sub(c)}, []) AS w_{c}" for c, _ in parts)
    feats = " UNION ALL ".join(
        f"SELECT key, unnest(w_{c}) AS f, 0 AS pair, {wt}::DOUBLE AS wt FROM {name}_w UNION ALL SELECT key, unnest(list_transform(generate_series(1, len(w_{c}) - 1), lambda i: w_{c}[i] || ' ' || w_{c}[i + 1])), 1, {wt}::DOUBLE FROM {name}_w"
        for c, wt in parts
    )
    return f"""{name}_w AS MATERIALIZED (SELECT key, {words} FROM ({source})),
{name}_tf AS MATERIALIZED (SELECT key, f, pair, wt, count(*) AS tf FROM ({feats}) GROUP BY ALL),
{name}_b AS (SELECT f, pair, list_transform(generate_series(1, strlen(f)), lambda i: ('0x' || hex(f::VARCHAR)[2*i-1:2*i])::UHUGEINT) AS b FROM (SELECT DISTINCT f, pair FROM {name}_tf)),
{name}_h AS MATERIALIZED (SELECT f, pair, CASE pair WHEN 0 THEN {_hashed(0)} ELSE {_hashed(hashing.PAIR_SEED)} END AS h FROM {name}_b),
{name}_r AS MATERIALIZED (SELECT key, (h % {DIM})::INT AS slot, round(sum(wt * CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -1 ELSE 1 END * (1 + ln(tf))), 9) AS v FROM {name}_tf JOIN {name}_h USING (f, pair) GROUP BY ALL HAVING v <> 0),
{name}_df AS MATERIALIZED (SELECT slot, count(*) AS df FROM {w}_r GROUP BY slot), {name}_n AS (SELECT count(*)::DOUBLE AS n FROM {w}_w),
{name}_x AS (SELECT key, slot, v * ln(1 + n / greatest(coalesce(df, 0), 1)) AS x FROM {name}_r LEFT JOIN {name}_df USING (slot), {name}_n),
{name}_v AS MATERIALIZED (SELECT key, slot, x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS x FROM {name}_x)"""


BASE = (
    "WITH RECURSIVE "
    + ", ".join([CATALOG, REQUESTS, _embedding("c", "SELECT chunk AS key, text, path FROM cat", True), _embedding("r", "SELECT q AS key, text FROM req", False, "c")])
    + """, gist AS (SELECT slot, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT slot, sum(x) AS x FROM c_v GROUP BY slot)),
gs AS (SELECT q, round(coalesce(sum(r_v.x * gist.x), 0), 6) AS gist_score FROM req LEFT JOIN r_v ON r_v.key = q LEFT JOIN gist USING (slot) GROUP BY q),
dots AS MATERIALIZED (SELECT q, chunk, round(coalesce(sum(a.x * b.x), 0), 6) AS score FROM req CROSS JOIN cat LEFT JOIN r_v a ON a.key = q LEFT JOIN c_v b ON b.key = chunk AND b.slot = a.slot GROUP BY q, chunk)
"""
)


def _top(name: str, source: str, k: int) -> str:
    return f", {name} AS (SELECT q, chunk, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk) AS rank FROM ({source}) QUALIFY rank <= {k})\n"


def _fold(cand: str, bar: str) -> str:
    """CTE fold_end(q, hits, spent, dropped) of cand(q, rank, chunk, score, path, line_start, line_end, tokens)."""
    stop = f"(f.stopped OR k.score < {bar})"
    full, poor = f"(len(f.taken) >= {LIMITS.max_chunks})", f"(f.spent + k.tokens > {LIMITS.token_budget})"
    over = "(len(list_filter(f.taken, lambda t: t.p = k.path AND t.a <= k.line_end AND t.b >= k.line_start)) > 0)"
    take = f"(NOT {stop} AND NOT {full} AND NOT {poor} AND NOT {over})"
    return f""", ranked AS MATERIALIZED (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM {cand}),
fold AS (
  SELECT q, 0::BIGINT AS rank, []::STRUCT(p VARCHAR, a INT, b INT)[] AS taken, []::VARCHAR[] AS hits, 0::BIGINT AS spent, 0 AS dropped, false AS stopped FROM (SELECT DISTINCT q FROM ranked)
  UNION ALL
  SELECT f.q, k.rank, CASE WHEN {take} THEN list_append(f.taken, struct_pack(p := k.path, a := k.line_start, b := k.line_end)) ELSE f.taken END,
    CASE WHEN {take} THEN list_append(f.hits, k.chunk) ELSE f.hits END, f.spent + CASE WHEN {take} THEN k.tokens ELSE 0 END,
    f.dropped + CASE WHEN NOT {stop} AND ({full} OR {poor}) THEN 1 ELSE 0 END, {stop}
  FROM fold f JOIN ranked k ON k.q = f.q AND k.rank = f.rank + 1),
fold_end AS (SELECT q, arg_max(hits, rank) AS hits, arg_max(spent, rank)::INT AS spent, arg_max(dropped, rank)::INT AS dropped FROM fold GROUP BY q),
bests AS (SELECT q, max(score) AS best FROM ranked GROUP BY q)
"""


CUT_BAR = "greatest(0.05, 0.6 * k.best)"
RESULT = """SELECT q, coalesce(len(hits), 0) > 0 AS faulted, coalesce(best, 0)::DOUBLE AS best_score, {cutoff} AS cutoff, gist_score, coalesce(spent, 0)::INT AS injected_tokens,
  coalesce(dropped, 0)::INT AS dropped, coalesce(array_to_string(hits, '|'), '') AS hits FROM req LEFT JOIN gs USING (q) LEFT JOIN fold_end USING (q) LEFT JOIN bests USING (q)"""
PLACED = "(SELECT t.q, t.rank, t.chunk, t.score, cat.path, cat.line_start, cat.line_end, cat.tokens FROM {} t JOIN cat USING (chunk))"
CUT = "round(greatest(0.05, 0.6 * coalesce(best, 0)), 6)"
HINTS = rf""", hints AS (SELECT q, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[\s()\[\]{{}}<>"''`,;]+'),
  lambda w: regexp_replace(replace(w, '\', '/'), '^[./]+|[./]+$', '', 'g')), lambda w: strlen(w) BETWEEN 3 AND 200 AND (contains(w, '/') OR lower(regexp_extract(w, '[^/]\.([^./]+)$', 1)) IN {texts.EXT})))) AS hints FROM req),
scope AS MATERIALIZED (SELECT DISTINCT q, path FROM (SELECT q, unnest(hints) AS h FROM hints) JOIN (SELECT DISTINCT path FROM {{paths}}) ON contains(path, h))
"""


# ---- the collection in Spark ----------------------------------------------------------------
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by their own texts, one row a chunk; lines in order, paths in one spelling."""
    rows = table(spark, sf_dir, "chunks").where("chunk_id IS NOT NULL AND text IS NOT NULL")
    low, high = F.min(F.least("line_start", "line_end")), F.max(F.greatest("line_start", "line_end"))
    one = rows.groupBy("chunk_id").agg(
        F.regexp_replace(F.max(T.normal_path("path")), r"^(\./)+", "").alias("path"), F.coalesce(low, F.lit(1)).cast("int").alias("line_start"), F.coalesce(high, low, F.lit(1)).cast("int").alias("line_end"), F.max("text").alias("text")
    )
    return one.where("path IS NOT NULL").select(F.col("chunk_id").cast("string").alias("chunk"), "path", "line_start", "line_end", "text", T.token_estimate("text").alias("tokens"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 50 = 0 AND text IS NOT NULL")
    return docs.groupBy(F.col("doc_id").alias("q")).agg(F.max("text").alias("text"))


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, object]:
    """(chunks, vectors, requests, weights): the collection embedded with its own weights, and the
    requests with the collection's."""
    chunks = cut(catalog(spark, sf_dir), "catalog")
    raw = cut(dense.raw_features(chunks, DIM, "chunk", "text", "path"), "features")
    weights = dense.slot_weights(raw, DIM)[2]
    vectors = cut(dense.weighted(raw, weights).select(F.col("key").alias("id"), "vector").join(chunks.select(F.col("chunk").alias("id"), "path"), "id"), "vectors")
    asked = requests(spark, sf_dir)
    embedded = dense.weighted(dense.raw_features(asked, DIM, "q", "text"), weights).select(F.col("key").alias("q"), "vector")
    return chunks, vectors, cut(asked.join(embedded, "q"), "requests"), weights


def shown(result: DataFrame) -> DataFrame:
    return result.withColumn("hits", F.array_join(F.transform("hits", lambda h: h["chunk"]), "|"))


def _hints(asked: DataFrame) -> DataFrame:
    return asked.withColumn("hints", F.coalesce(T.path_hints("text"), F.array().cast("array<string>")))


# ---- queries --------------------------------------------------------------------------------
FILES_EMBEDDED = "WITH " + texts.FILES + ", " + _embedding("c", "SELECT path AS key, text, path FROM files", True)


@REGISTRY.query("hash_embeddings", FILES_EMBEDDED + " SELECT key, slot, round(x, 6) AS value FROM c_v WHERE round(x, 6) <> 0")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense.hash_embeddings(texts.files(spark, sf_dir), DIM, "path", "text", "path")
    return rows.select("key", "slot", F.round("value", 6).alias("value")).where("value <> 0")


@REGISTRY.query("catalog_slot_weights", FILES_EMBEDDED + f" SELECT s.slot::INT AS slot, coalesce(df, 0)::BIGINT AS df, round(ln(1 + n / greatest(coalesce(df, 0), 1)), 6) AS weight FROM generate_series(0, {DIM - 1}) s(slot) LEFT JOIN c_df ON c_df.slot = s.slot, c_n")
def catalog_slot_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot weights of a collection, fresh from its texts."""
    raw = dense.raw_features(texts.files(spark, sf_dir), DIM, "path", "text", "path")
    _, df, weight = dense.slot_weights(raw, DIM)
    return spark.createDataFrame([(i, int(d), round(float(w), 6)) for i, (d, w) in enumerate(zip(df, weight, strict=True))], "slot int, df long, weight double")


@REGISTRY.query("dense_page_fault", BASE + _top("top", "SELECT * FROM dots", 48) + _fold(PLACED.format("top"), CUT_BAR) + RESULT.format(cutoff=CUT))
def dense_page_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors, asked, _ = indexed(spark, sf_dir)
    return shown(retrieval.page_fault(vectors, chunks, asked, LIMITS))


SCOPED = (
    BASE
    + HINTS.replace("{paths}", "cat")
    + _top("stop", "SELECT d.q, d.chunk, d.score FROM dots d JOIN cat USING (chunk) JOIN scope s ON s.q = d.q AND s.path = cat.path", 48)
    + _top("otop", "SELECT * FROM dots WHERE q NOT IN (SELECT q FROM scope)", 48)
    + ", top AS (SELECT * FROM stop UNION ALL SELECT * FROM otop)"
)


@REGISTRY.query("scoped_page_fault", SCOPED + _fold(PLACED.format("top"), CUT_BAR) + RESULT.format(cutoff=CUT))
def scoped_page_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search within the paths that a request names, in full where it names none that exists."""
    chunks, vectors, asked, _ = indexed(spark, sf_dir)
    return shown(retrieval.page_fault(vectors, chunks, _hints(asked), LIMITS))


@REGISTRY.query("scoped_top10", SCOPED + "SELECT q, chunk, score, rank::INT AS rank FROM top WHERE rank <= 10")
def scoped_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vectors, asked, _ = indexed(spark, sf_dir)
    asked = _hints(asked)
    return retrieval.with_fallback(retrieval.scoped_candidates(vectors, asked, 10), vectors, asked, 10).select("q", F.col("id").alias("chunk"), "score", "rank")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
HYBRID = (
    BASE
    + f""", qt AS (SELECT DISTINCT q, unnest({_WORDS}) AS term FROM req), tok AS (SELECT chunk, unnest({_WORDS}) AS term FROM cat),
len AS (SELECT chunk, len({_WORDS}) AS dl FROM cat), st AS (SELECT greatest(count(*), 1)::DOUBLE AS n, greatest(avg(dl), 1)::DOUBLE AS avgdl FROM len),
btf AS (SELECT chunk, term, count(*) AS tf FROM tok GROUP BY ALL), bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY term),
lex AS MATERIALIZED (SELECT q, chunk, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN btf USING (term) JOIN bdf USING (term) JOIN len USING (chunk), st GROUP BY q, chunk)"""
    + _top("dtop", "SELECT * FROM dots", 48)
    + _top("ltop", "SELECT * FROM lex", 48)
    + f""", pool AS (SELECT q, chunk FROM dtop UNION SELECT q, chunk FROM ltop),
defs AS MATERIALIZED (SELECT DISTINCT p.q, p.chunk FROM pool p JOIN cat USING (chunk) JOIN qt ON qt.q = p.q AND strlen(term) >= 4 AND contains(lower(text), term)
  AND regexp_matches(lower(text), '(?m)(^|[^\\p{{L}}\\p{{N}}_])({"|".join(T.DECLARATIONS)})[ \\t]+' || term || '($|[^a-z0-9_])|(^|[^a-z0-9_])' || term || '[ \\t]*(=($|[^=])|:($|[^:]))')),
joined AS (SELECT p.q, p.chunk, coalesce(d.score, 0) AS dense, coalesce(l.score, 0) AS lexical, CASE WHEN f.chunk IS NULL THEN 0.0 ELSE 1.0 END AS defines
  FROM pool p LEFT JOIN dtop d USING (q, chunk) LEFT JOIN lex l USING (q, chunk) LEFT JOIN defs f USING (q, chunk)),
tops AS (SELECT *, max(lexical) OVER (PARTITION BY q) AS top, greatest(0.05, 0.6 * max(dense) OVER (PARTITION BY q)) AS bar FROM joined),
mixed AS (SELECT q, chunk, round(dense + 1.5 * CASE WHEN top > 0.5 THEN lexical / top ELSE 0 END + defines, 6)::DOUBLE AS score, dense, lexical, defines::DOUBLE AS defines FROM tops WHERE dense >= bar OR lexical >= 2.5 OR defines > 0),
hyb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk) AS rank FROM mixed)
"""
)


@REGISTRY.query("hybrid_fused", HYBRID + "SELECT q, chunk, score, rank::INT AS rank, dense::DOUBLE AS dense, lexical::DOUBLE AS lexical, defines FROM hyb")
def hybrid_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted candidates of the dense and the lexical channel of every request, fused."""
    chunks, vectors, asked, _ = indexed(spark, sf_dir)
    return retrieval.hybrid_candidates(search.dense_top(vectors, asked, 48), chunks, asked, LIMITS)


@REGISTRY.query("hybrid_fault", HYBRID + _fold(PLACED.format("hyb"), "-1") + RESULT.format(cutoff="0.05::DOUBLE"))
def hybrid_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors, asked, _ = indexed(spark, sf_dir)
    return shown(retrieval.hybrid_fault(vectors, chunks, asked, LIMITS))


@REGISTRY.query("request_definitions")
def request_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that define a word of a request: an equi-join on the names that each chunk defines."""
    words = requests(spark, sf_dir).select("q", F.explode(F.array_distinct(T.word_tokens("text"))).alias("symbol")).where("octet_length(symbol) >= 4")
    names = catalog(spark, sf_dir).select("chunk", F.explode(T.defined_symbols("text")).alias("symbol"))
    return names.join(search.small_side(words), "symbol").select("q", "symbol", "chunk")


LIVE_ROWS = r"""edits AS (SELECT regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') AS path, arg_max(struct_pack(c := content), struct_pack(a := created_at, p := patch_id, c := coalesce(content, ''))).c AS text
  FROM code_patches WHERE relative_path IS NOT NULL AND patch_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): the newest patch of each path; a patch without content deletes."""
    rows = table(spark, sf_dir, "code_patches").where("relative_path IS NOT NULL AND patch_id IS NOT NULL AND created_at IS NOT NULL")
    path = F.regexp_replace(T.normal_path("relative_path"), r"^(\./)+", "")
    return rows.groupBy(path.alias("path")).agg(F.max_by(F.struct("content"), F.struct("created_at", "patch_id", F.coalesce("content", F.lit("")))).getField("content").alias("text"))


def live_layer(spark: SparkSession, sf_dir: str, weights) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, vectors, shadowed paths) of the edits, embedded with the collection's weights."""
    last = cut(edits(spark, sf_dir), "edits")
    fresh = chunking.windows_with_cap(last.where("text IS NOT NULL"))
    fresh = fresh.select(F.format_string("live:%s:%d", "path", "line_start").alias("chunk"), "path", "line_start", "line_end", "text", T.token_estimate("text").alias("tokens"))
    fresh = cut(fresh, "live-chunks")
    vectors = dense.weighted(dense.raw_features(fresh, DIM, "chunk", "text", "path"), weights).select(F.col("key").alias("id"), "vector")
    return fresh, cut(vectors.join(fresh.select(F.col("chunk").alias("id"), "path"), "id"), "live-vectors"), last.select("path")


LIVE = (
    BASE
    + ", "
    + LIVE_ROWS
    + r""", l0 AS (SELECT path, string_split(text, chr(10)) AS p FROM edits WHERE text IS NOT NULL),
l1 AS (SELECT path, list_transform(CASE WHEN p[-1] = '' THEN p[1:len(p)-1] ELSE p END, lambda x: regexp_replace(x, '\r$', '')) AS ls FROM l0),
l2 AS (SELECT path, ls, len(ls) AS n, unnest(generate_series(0, greatest(0, ceil((len(ls) - 60) / 48.0)::INT) * 48, 48)) AS start FROM l1 WHERE len(ls) > 0),
lw AS (SELECT path, (start + 1)::INT AS line_start, least(start + 60, n)::INT AS line_end, regexp_replace(array_to_string(ls[start+1:start+60], chr(10)), '^\n+', '') AS text FROM l2),
lcat AS (SELECT 'live:' || path || ':' || line_start AS chunk, path, line_start, line_end, text, greatest(1, ceil(strlen(text) / 3.2))::INT AS tokens FROM lw WHERE regexp_replace(text, '\s+', '', 'g') <> ''),
allcat AS (SELECT * FROM cat UNION ALL SELECT * FROM lcat), """
    + _embedding("l", "SELECT chunk AS key, text, path FROM lcat", True, "c")
    + """, ldots AS MATERIALIZED (SELECT q, chunk, round(coalesce(sum(a.x * b.x), 0), 6) AS score FROM req CROSS JOIN lcat LEFT JOIN r_v a ON a.key = q LEFT JOIN l_v b ON b.key = chunk AND b.slot = a.slot GROUP BY q, chunk),
lgist AS (SELECT slot, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT slot, sum(x) AS x FROM (SELECT slot, x * (SELECT count(*) FROM cat) AS x FROM gist UNION ALL SELECT slot, x FROM l_v) GROUP BY slot)),
lgs AS (SELECT q, round(coalesce(sum(r_v.x * lgist.x), 0), 6) AS gist_score FROM req LEFT JOIN r_v ON r_v.key = q LEFT JOIN lgist USING (slot) GROUP BY q)"""
    + HINTS.replace("{paths}", "allcat")
    + _top("bin", "SELECT d.q, d.chunk, d.score FROM dots d JOIN cat USING (chunk) JOIN scope s ON s.q = d.q AND s.path = cat.path", 96)
    + _top("bout", "SELECT * FROM dots WHERE q NOT IN (SELECT q FROM scope)", 96)
    + _top("dall", "SELECT * FROM ldots", 48)
    + """, lmix AS (SELECT q, chunk, score, 'base' AS origin, rank FROM (SELECT * FROM bin UNION ALL SELECT * FROM bout) JOIN cat USING (chunk) WHERE path NOT IN (SELECT path FROM edits)
  UNION ALL SELECT d.q, d.chunk, d.score, 'delta', d.rank FROM dall d JOIN lcat USING (chunk) WHERE d.q NOT IN (SELECT q FROM scope) OR (d.q, lcat.path) IN (SELECT (q, path) FROM scope)),
lcand AS MATERIALIZED (SELECT t.q, t.chunk, t.score, row_number() OVER (PARTITION BY t.q ORDER BY t.score DESC, t.origin, t.rank) AS rank, a.path, a.line_start, a.line_end, a.tokens FROM lmix t JOIN allcat a USING (chunk))
"""
)


@REGISTRY.query("live_page_fault", LIVE + _fold("lcand", CUT_BAR) + RESULT.format(cutoff=CUT).replace("LEFT JOIN gs", "LEFT JOIN lgs"))
def live_page_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over the collection with the patches as its live layer, scoped where a request names
    paths."""
    chunks, vectors, asked, weights = indexed(spark, sf_dir)
    return shown(retrieval.live_page_fault(vectors, chunks, *_layer(spark, sf_dir, weights), _hints(asked), LIMITS))


@REGISTRY.query("live_gist", LIVE + "SELECT slot::INT AS slot, round(x, 6) AS value FROM lgist WHERE round(x, 6) <> 0")
def live_gist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's gist with the live layer blended in."""
    _, vectors, _, weights = indexed(spark, sf_dir)
    n, gist = retrieval.unit_gist(vectors)
    both = retrieval.live_gist(gist, n, _layer(spark, sf_dir, weights)[0])
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(both)], "slot int, value double").where("value <> 0")


def _layer(spark: SparkSession, sf_dir: str, weights) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, chunks, shadowed) of the live layer, the order in which searches take it."""
    chunks, vectors, shadowed = live_layer(spark, sf_dir, weights)
    return vectors, chunks, shadowed


ENDS = """, {n}_at AS (SELECT q, unnest(hits) AS chunk, generate_subscripts(hits, 1) AS at FROM fold_end),
{n}_shown AS (SELECT h.q, list(chr(10) || '--- ' || a.path || ':' || a.line_start || '-' || a.line_end || ' (similarity ' || round(r.score::DECIMAL(18,6), 3)::DECIMAL(18,3)::VARCHAR || ') ---' || chr(10) || a.text || chr(10) ORDER BY h.at) AS bs
  FROM {n}_at h JOIN {cat} a USING (chunk) JOIN ranked r ON r.q = h.q AND r.chunk = h.chunk GROUP BY h.q)
"""
WRAP = "CASE WHEN bs IS NULL THEN '' ELSE 'Relevant excerpts from the workspace:' || chr(10) || array_to_string(bs, '') || chr(10) || 'End of excerpts.' || chr(10) END"
ROUTES = (
    LIVE
    + HYBRID.removeprefix(BASE)
    + texts.GATE.replace("SELECT DISTINCT doc_id, text FROM documents", "SELECT q AS doc_id, text FROM req").replace("WITH q AS", ", gq AS", 1).replace("FROM q)", "FROM gq)").replace("w AS (", "gw AS (", 1).replace("c AS (SELECT doc_id", "gc AS (SELECT doc_id", 1).replace("FROM w)", "FROM gw)").replace("e AS (SELECT *, text", "ge AS (SELECT *, text", 1).replace("FROM c)", "FROM gc)")
    + """, route AS (SELECT doc_id AS q, CASE WHEN empty OR NOT (code OR found >= 3) OR contains(text, 'Relevant excerpts from the workspace:') THEN 'skip' WHEN len(h.hints) > 0 THEN 'live' ELSE 'hybrid' END AS route FROM ge JOIN hints h ON h.q = doc_id),
both_cand AS MATERIALIZED (SELECT q, rank, chunk, score, path, line_start, line_end, tokens, 0 AS free FROM lcand WHERE q IN (SELECT q FROM route WHERE route = 'live')
  UNION ALL SELECT q, rank, chunk, score, path, line_start, line_end, tokens, 1 FROM (SELECT h.*, c2.path, c2.line_start, c2.line_end, c2.tokens FROM hyb h JOIN cat c2 USING (chunk)) WHERE q IN (SELECT q FROM route WHERE route = 'hybrid'))
"""
    + _fold("both_cand", "CASE k.free WHEN 1 THEN -1 ELSE greatest(0.05, 0.6 * k.best) END")
    + ENDS.format(n="e", cat="allcat")
)


@REGISTRY.query("context_for", ROUTES + f"SELECT q, route, coalesce(array_to_string(hits, '|'), '') AS hits, md5({WRAP}) AS context FROM route LEFT JOIN fold_end USING (q) LEFT JOIN e_shown USING (q)")
def context_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: gate, hints, hybrid or live scoped search, budget fold and rendering."""
    chunks, vectors, asked, weights = indexed(spark, sf_dir)
    out = retrieval.context_for(vectors, chunks, *_layer(spark, sf_dir, weights), asked, LIMITS)
    return out.select("q", "route", F.array_join("hits", "|").alias("hits"), F.md5("context").alias("context"))


DENSE_SHOWN = BASE + _top("top", "SELECT * FROM dots", 48) + _fold(PLACED.format("top"), CUT_BAR)
TOOL = """, t_at AS (SELECT q, unnest(hits) AS chunk, generate_subscripts(hits, 1) AS at FROM fold_end)
SELECT req.q, coalesce(regexp_replace(array_to_string(list('── ' || a.path || ':' || a.line_start || '-' || a.line_end || '  (score ' || round(r.score::DECIMAL(18,6), 3)::DECIMAL(18,3)::VARCHAR || ')' || chr(10) || a.text || chr(10) || chr(10) ORDER BY h.at) FILTER (h.at IS NOT NULL), ''), '\\s+$', ''), '') AS answer
FROM req LEFT JOIN t_at h USING (q) LEFT JOIN cat a USING (chunk) LEFT JOIN ranked r ON r.q = h.q AND r.chunk = h.chunk GROUP BY req.q"""


@REGISTRY.query("tool_hits", DENSE_SHOWN + TOOL)
def tool_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hits as a tool's answer."""
    chunks, vectors, asked, _ = indexed(spark, sf_dir)
    return retrieval.page_fault(vectors, chunks, asked, LIMITS).select("q", search.tool_block(F.col("hits")).alias("answer"))


@REGISTRY.query("fault_json", DENSE_SHOWN + "SELECT q, faulted, best_score, gist_score, injected_tokens, dropped, hits FROM (" + RESULT.format(cutoff=CUT) + ")")
def fault_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense results as JSON objects, read back: what a reader of the JSON finds."""
    chunks, vectors, asked, _ = indexed(spark, sf_dir)
    rows = retrieval.result_json(retrieval.page_fault(vectors, chunks, asked, LIMITS))
    kind = "faulted boolean, best_score double, gist_score double, injected_tokens int, dropped_to_budget int, hits array<struct<chunk_id:string>>, context string"
    x = rows.select("q", F.from_json("result", kind).alias("x"))
    return x.select("q", "x.faulted", "x.best_score", "x.gist_score", "x.injected_tokens", F.col("x.dropped_to_budget").alias("dropped"), F.array_join("x.hits.chunk_id", "|").alias("hits"))


@REGISTRY.query("path_chunks", "WITH " + CATALOG + " SELECT path, array_to_string(list(chunk ORDER BY chunk), '|') AS chunks, count(*) AS n FROM cat GROUP BY path")
def path_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each path. The list of a path is what a reader of that file needs, so it is a row."""
    rows = catalog(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list("chunk")).alias("cs"))
    return rows.select("path", F.array_join("cs", "|").alias("chunks"), F.size("cs").cast("long").alias("n"))
