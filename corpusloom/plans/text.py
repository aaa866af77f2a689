"""Queries on scalar text functions and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import hashing, text as T
from corpusloom.operators import chunking
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()
EXT = "(" + ", ".join(f"'{e}'" for e in T.EXTENSIONS) + ")"
DIRS = "(" + ", ".join(f"'{d}'" for d in T.IGNORED_DIRS) + ")"
STOP = "[" + ", ".join(f"'{s}'" for s in T.STOPWORDS) + "]"
SYMBOLS = ("table", "merge", "node", "vector", "cache")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; repeated rows of a document count once, without a window's sort."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND path IS NOT NULL AND text IS NOT NULL")
    return docs.groupBy("doc_id").agg(F.max("path").alias("path"), F.max("text").alias("text")).select(F.format_string("%d/%s", "doc_id", T.normal_path("path")).alias("path"), "text")


FILES = r"""files AS (SELECT doc_id || '/' || replace(max(path), '\', '/') AS path, max(text) AS text FROM documents
  WHERE doc_id IS NOT NULL AND path IS NOT NULL AND text IS NOT NULL GROUP BY doc_id)"""
WINDOWS = (
    "WITH "
    + FILES
    + r""", l0 AS (SELECT path, string_split(text, chr(10)) AS p FROM files),
l1 AS (SELECT path, list_transform(CASE WHEN p[-1] = '' THEN p[1:len(p)-1] ELSE p END, lambda x: regexp_replace(x, '\r$', '')) AS ls FROM l0),
l2 AS (SELECT path, ls, len(ls) AS n, unnest(generate_series(0, greatest(0, ceil((len(ls) - 10) / 7.0)::INT) * 7, 7)) AS start FROM l1 WHERE len(ls) > 0),
win AS (SELECT path, (start + 1)::INT AS line_start, least(start + 10, n)::INT AS line_end, regexp_replace(array_to_string(ls[start+1:start+10], chr(10)), '^\n+', '') AS text FROM l2),
windows AS (SELECT * FROM win WHERE regexp_replace(text, '\s+', '', 'g') <> '')
"""
)


@REGISTRY.query("chunk_windows", WINDOWS + "SELECT path, line_start, line_end, md5(text) AS digest FROM windows")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_windows(files(spark, sf_dir), 10, 3).select("path", "line_start", "line_end", F.md5("text").alias("digest"))


WIDE = WINDOWS.replace("len(ls) - 10) / 7.0)::INT) * 7, 7)", "len(ls) - 60) / 48.0)::INT) * 48, 48)").replace("least(start + 10, n)", "least(start + 60, n)").replace("ls[start+1:start+10]", "ls[start+1:start+60]")


@REGISTRY.query("chunk_windows_capped")
def chunk_windows_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows_with_cap(files(spark, sf_dir))


@REGISTRY.query(
    "catalog_chunk_ids",
    WIDE + "SELECT row_number() OVER (ORDER BY path, line_start) - 1 AS chunk_id, path, line_start, line_end, greatest(1, ceil(strlen(text) / 3.2))::INT AS token_estimate, sha256(text)[1:32] AS content_hash FROM windows",
)
def catalog_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents with their ids; no cap, so that SQL can state them."""
    return chunking.catalog_chunks(files(spark, sf_dir), cap=1 << 30).drop("text")


@REGISTRY.query(
    "token_estimate", "SELECT DISTINCT chunk_id, greatest(1, ceil(strlen(text) / 3.2))::INT AS tokens FROM chunks WHERE text IS NOT NULL"
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_id", T.token_estimate("text").alias("tokens")).distinct()


@REGISTRY.query(
    "indexable_paths",
    rf"""WITH p AS (SELECT DISTINCT replace(path, '\', '/') AS path FROM chunks WHERE path IS NOT NULL)
SELECT path, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext,
  lower(regexp_extract(path, '\.([^./]+)$', 1)) IN {EXT} AND len(list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'),
    lambda d: d IN {DIRS} OR (starts_with(d, '.') AND d NOT IN ('.', '..')))) = 0 AS indexable FROM p""",
)
def indexable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "chunks").where("path IS NOT NULL").select(T.normal_path("path").alias("path")).distinct()
    return paths.select("path", T.extension("path").alias("ext"), T.is_indexable("path").alias("indexable"))


CUT = "SELECT DISTINCT chunk_id, md5(substring(text, 1, list_max(list_filter(generate_series(0, 200), lambda k: strlen(substring(text, 1, k)) <= 200)))) AS digest FROM chunks WHERE text IS NOT NULL"


@REGISTRY.query("truncated", CUT)
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts cut to 200 bytes of UTF-8 at a character border."""
    return table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_id", F.md5(T.truncated_bytes("text", 200)).alias("digest")).distinct()


@REGISTRY.query(
    "word_token_counts",
    r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term",
)
def word_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(T.word_tokens("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query(
    "subword_counts",
    r"""WITH s AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '([\p{Ll}])(\p{Lu})', '\1 \2', 'g'),
  '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g') AS t FROM chunks WHERE text IS NOT NULL)
SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS term FROM s) GROUP BY term""",
)
def subword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select(F.explode(T.subwords("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


FNV = """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT term, list_transform(generate_series(1, strlen(term)), lambda i: ('0x' || hex(term::VARCHAR)[2*i-1:2*i])::UHUGEINT) AS bytes FROM w),
h AS (SELECT term, list_reduce(list_prepend(14695981039346656037::UHUGEINT, bytes), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM b)
"""


@REGISTRY.query("fnv_slots", FNV + "SELECT term, (h % 1536)::INT AS slot, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -1 ELSE 1 END::INT AS sign FROM h")
def fnv_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.explode(T.word_tokens("text")).alias("term")).distinct()
    h = hashing.fnv1a(F.col("term"))
    return terms.select("term", h.alias("h")).select("term", hashing.slot(F.col("h"), 1536).alias("slot"), hashing.sign(F.col("h")).alias("sign"))


GATE = rf"""WITH q AS (SELECT DISTINCT doc_id, text FROM documents),
w AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_./]+'), lambda x: lower(regexp_replace(x, '^[./]+|[./]+$', '', 'g'))), lambda x: x <> '') AS ws FROM q),
c AS (SELECT doc_id, text, len(list_filter(ws, lambda x: regexp_matches(x, '[/_]') OR (regexp_extract(x, '^(.+)\.[^.]+$', 1) <> '' AND lower(regexp_extract(x, '\.([^.]+)$', 1)) IN {EXT}))) > 0 AS code,
  len(list_distinct(list_filter(flatten(list_transform(ws, lambda x: string_split(x, '.'))), lambda p: strlen(p) >= 2 AND NOT regexp_matches(p, '^[0-9]+$') AND (NOT list_contains({STOP}, p) OR strlen(p) >= 12)))) AS found FROM w),
e AS (SELECT *, text IS NULL OR trim(regexp_replace(text, '\s+', ' ', 'g')) = '' AS empty FROM c)
"""


@REGISTRY.query(
    "gate_decisions",
    GATE
    + """SELECT doc_id, CASE WHEN empty THEN 'skip' WHEN code OR found >= 3 THEN 'retrieve' ELSE 'skip' END AS decision,
  CASE WHEN empty THEN 'empty' WHEN code THEN 'code' WHEN found >= 3 THEN 'content' ELSE 'too_few' END AS reason, CASE WHEN empty THEN 0 ELSE found END::INT AS content FROM e""",
)
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").distinct()
    return docs.select("doc_id", T.gate("text").alias("g")).select("doc_id", "g.decision", "g.reason", "g.content")


@REGISTRY.query(
    "path_hints",
    rf"""WITH h AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[\s()\[\]{{}}<>"''`,;]+'),
  lambda w: regexp_replace(replace(w, '\', '/'), '^[./]+|[./]+$', '', 'g')), lambda w: strlen(w) BETWEEN 3 AND 200 AND (contains(w, '/') OR lower(regexp_extract(w, '[^/]\.([^./]+)$', 1)) IN {EXT})))) AS hints
FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))
SELECT doc_id, array_to_string(hints, '|') AS hints, len(hints)::INT AS n FROM h WHERE len(hints) > 0""",
)
def path_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    rows = docs.select("doc_id", T.path_hints("text").alias("h")).where("size(h) > 0")
    return rows.select("doc_id", F.array_join("h", "|").alias("hints"), F.size("h").alias("n"))


@REGISTRY.query(
    "last_user_turn",
    r"""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS turn FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
u AS (SELECT doc_id, turn, regexp_replace(regexp_extract(line, '^(user|me|Q): (.*)$', 2), '\r$', '') AS said FROM t WHERE regexp_matches(line, '^(user|me|Q): '))
SELECT doc_id, arg_max(said, turn) AS said FROM u GROUP BY doc_id""",
)
def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    turns = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("turn", "line")).where(F.col("line").rlike("^(user|me|Q): "))
    return turns.groupBy("doc_id").agg(F.max_by(F.regexp_extract("line", "^(?:user|me|Q): (.*)$", 1), "turn").alias("said"))


@REGISTRY.query(
    "find_definitions",
    " UNION ALL ".join(
        f"SELECT DISTINCT '{s}' AS symbol, chunk_id FROM chunks WHERE len(list_filter(string_split(lower(text), chr(10)), lambda l: regexp_matches(l, '{T.defines_pattern(s)}'))) > 0"
        for s in SYMBOLS
    ),
)
def find_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.array(*[F.when(T.defines("text", s), F.lit(s)) for s in SYMBOLS])
    rows = table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_id", F.explode(F.array_compact(hits)).alias("symbol"))
    return rows.select("symbol", "chunk_id").distinct()


@REGISTRY.query(
    "catalog_sizes",
    r"""SELECT DISTINCT catalog_id, embedder_id, try_cast(regexp_extract(embedder_id, '-d([0-9]+)$', 1) AS INT) AS dim, ((idf_off + 15) // 16 * 16)::BIGINT AS aligned,
CASE WHEN container_bytes < 1024 THEN printf('%d B', container_bytes) WHEN container_bytes < 1048576 THEN printf('%.2f KiB', container_bytes / 1024.0)
 WHEN container_bytes < 1073741824 THEN printf('%.2f MiB', container_bytes / 1048576.0) ELSE printf('%.2f GiB', container_bytes / 1073741824.0) END AS human FROM catalog_meta""",
)
def catalog_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "catalog_meta")
    return meta.select("catalog_id", "embedder_id", T.embedder_dim("embedder_id").alias("dim"), T.align_up("idf_off").alias("aligned"), T.human_bytes("container_bytes").alias("human")).distinct()


@REGISTRY.query("content_hashes", "SELECT DISTINCT chunk_id, sha256(text)[1:32] AS digest FROM chunks WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_id", T.content_hash("text").alias("digest")).distinct()


@REGISTRY.query(
    "content_addressed_leaves",
    "WITH "
    + FILES
    + r""", p AS (SELECT path, string_split(text, chr(10) || chr(10)) AS ps FROM files), b AS (SELECT path, ps, unnest(ps) AS block, generate_subscripts(ps, 1) - 1 AS leaf_no FROM p),
s AS (SELECT path, leaf_no::INT AS leaf_no, block, coalesce(list_sum(list_transform(ps[1:leaf_no], lambda x: strlen(x) + 2)), 0)::INT AS start FROM b)
SELECT path, leaf_no, start, (start + strlen(block))::INT AS "end", sha256(block)[1:32] AS leaf_id FROM s WHERE trim(regexp_replace(block, '\s+', ' ', 'g')) <> ''""",
)
def content_addressed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.blank_line_leaves(files(spark, sf_dir))


BM25 = (
    WINDOWS
    + r""", c AS (SELECT path, line_start, line_end, text, path || ':' || line_start AS chunk FROM windows),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark WHERE text IS NOT NULL),
tok AS (SELECT chunk, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM c),
len AS (SELECT c.chunk, coalesce(n, 0) AS dl FROM c LEFT JOIN (SELECT chunk, count(*) AS n FROM tok GROUP BY 1) USING (chunk)),
st AS (SELECT greatest(count(*), 1)::DOUBLE AS n, greatest(avg(dl), 1)::DOUBLE AS avgdl FROM len),
tf AS (SELECT chunk, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT item_id, chunk, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (chunk), st GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk)::INT AS rank FROM sc QUALIFY rank <= 48)
"""
)


def scored_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, top 48 of every benchmark query by BM25)."""
    from corpusloom.operators.search import bm25_top

    chunks = chunking.line_windows(files(spark, sf_dir), 10, 3)
    chunks = chunks.withColumn("chunk", F.concat_ws(":", "path", F.col("line_start").cast("string")))
    return chunks, bm25_top(chunks.select("chunk", "text"), table(spark, sf_dir, "benchmark"), 48)


@REGISTRY.query("bm25_top48", BM25 + "SELECT item_id, chunk, score, rank FROM top")
def bm25_top48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_windows(spark, sf_dir)[1]


FOLD = """, cand AS (SELECT item_id, rank, chunk, score, path, line_start, line_end, greatest(1, ceil(strlen(text) / 3.2))::INT AS tokens, max(score) OVER (PARTITION BY item_id) AS best FROM top JOIN c USING (chunk)),
fold AS (
  SELECT item_id, 0 AS rank, []::STRUCT(p VARCHAR, a INT, b INT)[] AS taken, []::VARCHAR[] AS hits, 0 AS spent, 0 AS dropped, false AS stopped FROM (SELECT DISTINCT item_id FROM cand)
  UNION ALL
  SELECT f.item_id, k.rank,
    CASE WHEN {accept} THEN list_append(f.taken, struct_pack(p := k.path, a := k.line_start, b := k.line_end)) ELSE f.taken END,
    CASE WHEN {accept} THEN list_append(f.hits, k.chunk) ELSE f.hits END,
    f.spent + CASE WHEN {accept} THEN k.tokens ELSE 0 END,
    f.dropped + CASE WHEN NOT {stop} AND ({full} OR {poor}) THEN 1 ELSE 0 END, {stop}
  FROM fold f JOIN cand k ON k.item_id = f.item_id AND k.rank = f.rank + 1)
SELECT item_id, array_to_string(arg_max(hits, rank), '|') AS hits, arg_max(spent, rank)::INT AS spent, arg_max(dropped, rank)::INT AS dropped FROM fold GROUP BY item_id"""
_STOP = "(f.stopped OR k.score < greatest(0.05, 0.6 * k.best))"
_FULL, _POOR = "(len(f.taken) >= 8)", "(f.spent + k.tokens > 1500)"
_OVER = "(len(list_filter(f.taken, lambda t: t.p = k.path AND t.a <= k.line_end AND t.b >= k.line_start)) > 0)"
FOLD = FOLD.format(stop=_STOP, full=_FULL, poor=_POOR, accept=f"(NOT {_STOP} AND NOT {_FULL} AND NOT {_POOR} AND NOT {_OVER})")


@REGISTRY.query("bm25_budget_fold", BM25.replace("WITH ", "WITH RECURSIVE ", 1) + FOLD)
def bm25_budget_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: BM25 candidates of every benchmark query, cut off, fitted into a token budget and
    freed of overlaps. Text is joined only to candidates."""
    from corpusloom.operators.search import budget_fold, small_side

    chunks, top = scored_windows(spark, sf_dir)
    cand = chunks.select("chunk", "path", "line_start", "line_end", T.token_estimate("text").alias("tokens")).join(small_side(top), "chunk")
    folded = budget_fold(cand, "item_id", token_budget=1500)
    return folded.select("item_id", F.array_join(F.transform("accepted", lambda a: a["chunk"]), "|").alias("hits"), "spent", "dropped")


SHOWN = """, ends AS (SELECT item_id, arg_max(hits, rank) AS hits FROM fold GROUP BY item_id), spots AS (SELECT item_id, unnest(hits) AS chunk, generate_subscripts(hits, 1) AS place FROM ends),
shown AS (SELECT a.item_id, list(chr(10) || '--- ' || c.path || ':' || c.line_start || '-' || c.line_end || ' (similarity ' || round(t.score::DECIMAL(18,6), 3)::DECIMAL(18,3)::VARCHAR || ') ---' || chr(10) || c.text || chr(10) ORDER BY a.place) AS bs
  FROM spots a JOIN c USING (chunk) JOIN top t ON t.item_id = a.item_id AND t.chunk = a.chunk GROUP BY a.item_id)
SELECT item_id, CASE WHEN bs IS NULL THEN '' ELSE 'Relevant excerpts from the workspace:' || chr(10) || array_to_string(bs, '') || chr(10) || 'End of excerpts.' || chr(10) END AS context FROM ends LEFT JOIN shown USING (item_id)"""


@REGISTRY.query("rendered_context", BM25.replace("WITH ", "WITH RECURSIVE ", 1) + FOLD[: FOLD.index("SELECT item_id, array_to_string(arg_max")].rstrip() + SHOWN)
def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded hits of every benchmark query as a block of cited excerpts."""
    from corpusloom.operators.search import budget_fold, render_context, small_side

    chunks, top = scored_windows(spark, sf_dir)
    cand = chunks.select("chunk", "path", "line_start", "line_end", T.token_estimate("text").alias("tokens")).join(small_side(top), "chunk")
    return render_context(budget_fold(cand, "item_id", token_budget=1500), chunks, "item_id")


@REGISTRY.query(
    "best_cut_queries",
    BM25 + "SELECT item_id, max(score) AS best, count(*) FILTER (score >= greatest(0.05, 0.6 * m)) AS kept FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS m FROM top) GROUP BY item_id",
)
def best_cut_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative cutoff: hits of each query at or above 0.6 of its best score."""
    top = scored_windows(spark, sf_dir)[1].withColumn("m", F.max("score").over(W.partitionBy("item_id")))
    kept = F.sum((F.col("score") >= F.greatest(F.lit(0.05), F.col("m") * 0.6)).cast("long"))
    return top.groupBy("item_id").agg(F.max("score").alias("best"), kept.alias("kept"))
