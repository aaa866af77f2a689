"""Queries on file graphs, trees, catalogs, diagnostics and holographic vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import diagnostics, graph, holographic
from corpusloom.plans.dense import collection
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()
_IGNORED = ", ".join(f"'{x}'" for x in graph.GRAPH_IGNORED)
PATHS = rf"""WITH every AS (SELECT DISTINCT replace(path, '\', '/') AS path FROM chunks WHERE path IS NOT NULL),
p AS (SELECT path FROM every WHERE len(list_filter(string_split(path, '/'), lambda c: c IN ({_IGNORED}))) = 0),
l AS (SELECT path AS source, CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS target FROM p)
"""
_KINDS = " ".join(f"WHEN '{e}' THEN '{k}'" for e, (k, _) in graph.FILE_TYPES.items())
_GROUPS = " ".join(f"WHEN '{e}' THEN {g}" for e, (_, g) in graph.FILE_TYPES.items())


@REGISTRY.query(
    "file_graph_nodes",
    PATHS
    + rf""", t AS (SELECT path, regexp_extract(path, '[^/]\.([^./]+)$', 1) AS e FROM p),
n AS (SELECT path AS name, 'file' AS kind, CASE e {_KINDS} ELSE 'Gist' END AS type, CASE e {_GROUPS} ELSE 0 END::INT AS grp FROM t UNION ALL SELECT DISTINCT target, 'directory', 'Network Structure', 8 FROM l)
SELECT row_number() OVER (ORDER BY name, kind) - 1 AS id, name, kind, type, grp FROM n""",
)
def file_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_nodes(table(spark, sf_dir, "chunks").select("path"))


@REGISTRY.query("file_graph_links", PATHS + "SELECT source, target FROM l")
def file_graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_links(table(spark, sf_dir, "chunks").select("path"))


@REGISTRY.query(
    "graph_neighbours",
    PATHS + ", b AS (SELECT source AS name, target AS other FROM l UNION SELECT target, source FROM l) SELECT name, count(*) AS degree FROM b GROUP BY name",
)
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(graph.file_links(table(spark, sf_dir, "chunks").select("path")))


@REGISTRY.query("graph_neighbour_lists", PATHS + "SELECT source AS name, target AS other FROM l UNION SELECT target, source FROM l")
def graph_neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbour_lists(graph.file_links(table(spark, sf_dir, "chunks").select("path")))


TREE = (
    PATHS
    + r""", cs AS (SELECT DISTINCT list_filter(string_split(path, '/'), lambda c: c <> '' AND c <> '.') AS cs FROM every), d AS (SELECT cs, unnest(generate_series(1, len(cs)))::INT AS depth FROM cs),
tree AS (SELECT DISTINCT array_to_string(cs[1:depth], '/') AS node, CASE WHEN depth = 1 THEN '.' ELSE array_to_string(cs[1:depth-1], '/') END AS up, depth FROM d)
"""
)


LIMITED = TREE.replace("list_filter(string_split(path, '/'), lambda c: c <> '' AND c <> '.') AS cs FROM every)", "list_filter(string_split(path, '/'), lambda c: c <> '' AND c <> '.') AS cs FROM (SELECT * FROM every ORDER BY path LIMIT 100))")


@REGISTRY.query("directory_tree_limited", LIMITED + "SELECT node, up, depth FROM tree")
def directory_tree_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of a limited number of files, which is the operator's own option."""
    return graph.directory_tree(table(spark, sf_dir, "chunks").select("path"), 100)


@REGISTRY.query("directory_tree", TREE + "SELECT node, up, depth FROM tree")
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.directory_tree(table(spark, sf_dir, "chunks").select("path"))


def dag_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, up, own): newest content hash of each node, with its parent, by catalog."""
    rows = table(spark, sf_dir, "dag_nodes").where("catalog_id IS NOT NULL AND node_id IS NOT NULL")
    newest = F.max_by(F.struct("own"), F.struct("seen", "arrival_seq", "own")).getField("own")
    rows = rows.select("catalog_id", "node_id", "parent_id", "arrival_seq", F.lower("content_hash").alias("own"), F.when(F.col("content_hash").isNotNull(), F.col("observed_at")).alias("seen"))
    one = rows.groupBy("catalog_id", "node_id").agg(F.max("parent_id").alias("parent_id"), newest.alias("own"))
    name = lambda c: F.concat(c, F.lit("@"), F.col("catalog_id").cast("string"))
    return one.select(name(F.col("node_id")).alias("node"), name(F.col("parent_id")).alias("up"), "own")


def _merkle_sql(depths: int = 12) -> str:
    """The tree hashed level by level, written out for trees of up to `depths` levels."""
    levels = []
    for d in range(depths - 1, -1, -1):
        below = f"(SELECT * FROM m{d + 1})" if d < depths - 1 else "(SELECT NULL AS node, NULL AS up, NULL AS digest WHERE false)"
        levels.append(
            f"""m{d} AS MATERIALIZED (SELECT s.node, s.up, CASE WHEN i.inner_ IS NULL THEN s.own ELSE sha256(s.own || i.inner_) END AS digest FROM s JOIN d USING (node)
  LEFT JOIN (SELECT up AS node, string_agg(part, '' ORDER BY block) AS inner_ FROM (SELECT up, node[1:2] AS block, sha256(string_agg(digest || node, '' ORDER BY node)) AS part FROM {below} GROUP BY up, node[1:2]) GROUP BY up) i USING (node) WHERE d.depth = {d})"""
        )
    return (
        """WITH RECURSIVE n AS (SELECT catalog_id, node_id, max(parent_id) AS parent_id, arg_max(lower(content_hash), struct_pack(a := observed_at, b := arrival_seq, c := lower(content_hash))) FILTER (content_hash IS NOT NULL) AS own FROM dag_nodes WHERE catalog_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL),
s AS MATERIALIZED (SELECT node_id || '@' || catalog_id AS node, parent_id || '@' || catalog_id AS up, coalesce(own, '') AS own FROM n),
d AS (SELECT node, 0 AS depth FROM s WHERE up IS NULL OR up NOT IN (SELECT node FROM s) UNION ALL SELECT s.node, d.depth + 1 FROM s JOIN d ON s.up = d.node),
"""
        + ",\n".join(levels)
        + "\n"
        + " UNION ALL ".join(f"SELECT node, {d}::INT AS depth, digest FROM m{d}" for d in range(depths))
    )


@REGISTRY.query("merkle_digests", _merkle_sql())
def merkle_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merkle_digests(dag_states(spark, sf_dir))


@REGISTRY.query(
    "catalog_totals",
    r"""WITH o AS (SELECT catalog_id, chunk_id, max(path) AS path, max(strlen(text)) AS bytes FROM chunks WHERE chunk_id IS NOT NULL GROUP BY ALL)
SELECT catalog_id, count(*) AS chunks, count(DISTINCT regexp_replace(replace(path, '\', '/'), '^\./', '')) AS files, coalesce(sum(bytes), 0)::BIGINT AS bytes,
coalesce(sum(CASE WHEN bytes IS NOT NULL THEN greatest(1, ceil(bytes / 3.2)) END), 0)::BIGINT AS tokens FROM o GROUP BY catalog_id""",
)
def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.catalog_totals(table(spark, sf_dir, "chunks"))


@REGISTRY.query(
    "catalog_integrity",
    """WITH o AS (SELECT DISTINCT chunk_id, catalog_id, uncompressed_len, strlen(text) AS bytes, md5(text) AS digest, content_hash FROM chunks WHERE text IS NOT NULL)
SELECT catalog_id, count(*) FILTER (uncompressed_len IS NULL OR uncompressed_len <> bytes) AS wrong_len, count(*) AS n FROM o GROUP BY catalog_id""",
)
def catalog_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose recorded length is not that of their text."""
    rows = table(spark, sf_dir, "chunks").where("text IS NOT NULL")
    rows = rows.select("chunk_id", "catalog_id", "uncompressed_len", F.octet_length("text").alias("bytes"), F.md5("text").alias("digest"), "content_hash").distinct()
    wrong = F.col("uncompressed_len").isNull() | (F.col("uncompressed_len") != F.col("bytes"))
    return rows.groupBy("catalog_id").agg(F.sum(wrong.cast("long")).alias("wrong_len"), F.count(F.lit(1)).alias("n"))


@REGISTRY.query(
    "dirty_nodes",
    """WITH o AS (SELECT DISTINCT catalog_id, node_id, arrival_seq, content_hash, observed_at FROM dag_nodes WHERE content_hash IS NOT NULL),
f AS (SELECT catalog_id, node_id, arg_min(lower(content_hash), observed_at) AS a, arg_max(lower(content_hash), observed_at) AS b FROM o GROUP BY ALL)
SELECT catalog_id, count(*) AS nodes, count(*) FILTER (a <> b) AS dirty FROM f GROUP BY catalog_id""",
)
def dirty_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each catalog whose newest hash is not their first."""
    rows = table(spark, sf_dir, "dag_nodes").where("content_hash IS NOT NULL")
    ends = rows.groupBy("catalog_id", "node_id").agg(F.min_by(F.lower("content_hash"), "observed_at").alias("a"), F.max_by(F.lower("content_hash"), "observed_at").alias("b"))
    return ends.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("dirty"))


SNAPSHOTS = """WITH o AS (SELECT DISTINCT catalog_id, node_id, arrival_seq, lower(content_hash) AS h, observed_at FROM dag_nodes WHERE content_hash IS NOT NULL AND catalog_id IS NOT NULL AND node_id IS NOT NULL),
m AS (SELECT (min(arrival_seq) + max(arrival_seq)) // 2 AS mid FROM o), a AS (SELECT catalog_id, node_id, arg_max(h, struct_pack(x := observed_at, y := arrival_seq, z := h)) AS h FROM o, m WHERE arrival_seq <= mid GROUP BY ALL),
b AS (SELECT catalog_id, node_id, arg_max(h, struct_pack(x := observed_at, y := arrival_seq, z := h)) AS h FROM o GROUP BY ALL)
SELECT catalog_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change, count(*) AS nodes FROM a FULL JOIN b USING (catalog_id, node_id) GROUP BY ALL"""


@REGISTRY.query("snapshot_changes", SNAPSHOTS)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each catalog against the snapshot at the middle of the arrivals."""
    rows = table(spark, sf_dir, "dag_nodes").where("content_hash IS NOT NULL AND catalog_id IS NOT NULL AND node_id IS NOT NULL")
    lo, hi = rows.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    newest = F.max_by(F.lower("content_hash"), F.struct("observed_at", "arrival_seq", F.lower("content_hash"))).alias("digest")
    state = lambda df: df.groupBy("catalog_id", "node_id").agg(newest)
    got = graph.snapshot_changes(state(rows.where(F.col("arrival_seq") <= ((lo or 0) + (hi or 0)) // 2)), state(rows), ["catalog_id", "node_id"])
    return got.groupBy("catalog_id", "change").agg(F.count(F.lit(1)).alias("nodes"))


@REGISTRY.query(
    "stitch_summary",
    """WITH o AS (SELECT DISTINCT catalog_id, node_id, node_type, path, content_hash, observed_at FROM dag_nodes WHERE node_type = 'leaf' AND content_hash IS NOT NULL AND path IS NOT NULL),
f AS (SELECT catalog_id, node_id, arg_max(path, (observed_at, path)) AS path, count(DISTINCT lower(content_hash)) AS versions FROM o GROUP BY ALL),
r AS (SELECT catalog_id, try_cast(regexp_extract(path, '#([0-9]+)-([0-9]+)$', 2) AS BIGINT) - try_cast(regexp_extract(path, '#([0-9]+)-([0-9]+)$', 1) AS BIGINT) AS bytes FROM f WHERE versions > 1)
SELECT catalog_id, count(*) AS leaves, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM r GROUP BY catalog_id""",
)
def stitch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that changed, and the bytes they span, per catalog."""
    rows = table(spark, sf_dir, "dag_nodes").where("node_type = 'leaf' AND content_hash IS NOT NULL AND path IS NOT NULL")
    leaves = rows.groupBy("catalog_id", "node_id").agg(F.max_by("path", F.struct("observed_at", "path")).alias("path"), F.count_distinct(F.lower("content_hash")).alias("versions")).where("versions > 1")
    at = lambda i: F.regexp_extract("path", r"#([0-9]+)-([0-9]+)$", i).try_cast("long")
    return leaves.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum(at(2) - at(1)), F.lit(0)).alias("bytes"))


@REGISTRY.query(
    "layer_pages",
    """WITH f AS (SELECT DISTINCT catalog_id AS file, container_bytes AS size FROM catalog_meta WHERE container_bytes > 0), p AS (SELECT file, size, unnest(generate_series(0, ceil(size / 16384.0)::INT - 1))::INT AS page_no FROM f)
SELECT file, page_no, page_no::BIGINT * 16384 AS start, least(16384, size - page_no::BIGINT * 16384)::BIGINT AS length FROM p""",
)
def layer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "catalog_meta").select(F.col("catalog_id").alias("file"), F.col("container_bytes").alias("size")).distinct()
    return graph.layer_pages(files, 16384)


@REGISTRY.query(
    "layer_files",
    r"""WITH p AS (SELECT DISTINCT replace(path, '\', '/') AS path FROM chunks WHERE path IS NOT NULL), n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM p),
f AS (SELECT CASE WHEN i % 5 = 0 THEN path || '.gguf' ELSE 'model/layer_' || (i % 40) || '.bin' END AS file, (i * 104729 + 1) * 4096 AS size FROM n)
SELECT file, unnest(generate_series(0, ceil(size / 536870912.0)::INT - 1))::INT AS layer FROM f WHERE ends_with(file, '.gguf') UNION ALL SELECT DISTINCT file, regexp_extract(file, 'layer_([0-9]+)', 1)::INT FROM f WHERE NOT ends_with(file, '.gguf')""",
)
def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of model files: pages of single-file models, and numbered files."""
    from corpusloom.session import numbered

    paths = table(spark, sf_dir, "chunks").where("path IS NOT NULL").select(T.normal_path("path").alias("path")).distinct()
    i = F.col("i")
    named = numbered(paths, ["path"], "i").select(F.when(i % 5 == 0, F.concat("path", F.lit(".gguf"))).otherwise(F.format_string("model/layer_%d.bin", i % 40)).alias("file"), ((i * 104729 + 1) * 4096).alias("size"))
    return graph.layer_files(named)


CHAIN = """WITH RECURSIVE o AS (SELECT DISTINCT catalog_id, run_id, up_to_seq FROM sync_runs WHERE up_to_seq IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY run_id) AS r FROM (SELECT catalog_id, run_id, sha256(up_to_seq::VARCHAR) AS d FROM o)),
c AS (SELECT catalog_id, 0::BIGINT AS r, '' AS root FROM (SELECT DISTINCT catalog_id FROM n) UNION ALL SELECT c.catalog_id, n.r, sha256(c.root || n.d) FROM c JOIN n ON n.catalog_id = c.catalog_id AND n.r = c.r + 1)
SELECT catalog_id, arg_max(root, r) AS root FROM c GROUP BY catalog_id"""


@REGISTRY.query("running_chain", CHAIN)
def running_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash chain over the runs of each catalog, whose number is that of its processing runs."""
    runs = table(spark, sf_dir, "sync_runs").where("up_to_seq IS NOT NULL").select("catalog_id", "run_id", F.sha2(F.col("up_to_seq").cast("string"), 256).alias("d")).distinct()
    return graph.running_chain(runs, "catalog_id", "run_id", "d")


def diagnostic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiler output as JSON lines, one for each patch whose status is known: rejected ones are
    errors, proposed ones warnings, verified ones build noise."""
    p = table(spark, sf_dir, "code_patches").where("patch_id IS NOT NULL AND relative_path IS NOT NULL").select("patch_id", "catalog_id", "relative_path", "status").distinct()
    level = F.when(F.col("status") == "rejected", "error").otherwise("warning")
    span = lambda primary, line: F.struct(F.lit(primary).alias("is_primary"), F.col("relative_path").alias("file_name"), line.cast("int").alias("line_start"), F.lit(5).alias("column_start"))
    message = F.struct(F.format_string("problem %d", "patch_id").alias("message"), level.alias("level"), F.array(span(False, F.col("patch_id") % 7), span(True, F.col("patch_id") % 11)).alias("spans"))
    reason = F.when(F.col("status") == "verified", "build-script-executed").otherwise("compiler-message")
    return p.select("catalog_id", F.to_json(F.struct(reason.alias("reason"), message.alias("message"))).alias("value"))


DIAG = """WITH p AS (SELECT DISTINCT patch_id, catalog_id, relative_path, status FROM code_patches WHERE patch_id IS NOT NULL AND relative_path IS NOT NULL),
d AS (SELECT catalog_id, 'problem ' || patch_id AS message, CASE WHEN status = 'rejected' THEN 'error' ELSE 'warning' END AS level, relative_path AS file_name, (patch_id % 11)::INT AS line_start, 5::INT AS column_start FROM p WHERE status IS DISTINCT FROM 'verified')
"""


@REGISTRY.query("primary_spans", DIAG + "SELECT * FROM d")
def primary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.diagnostics(diagnostic_lines(spark, sf_dir))


@REGISTRY.query(
    "verity_scores",
    DIAG + "SELECT catalog_id, round(CASE WHEN count(level) = 0 THEN 1.0 WHEN count(*) FILTER (level = 'error') > 0 THEN 0.0 ELSE greatest(0.1, 1 - 0.1 * count(level)) END, 6)::DOUBLE AS score FROM d GROUP BY catalog_id",
)
def verity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.verity(diagnostics.diagnostics(diagnostic_lines(spark, sf_dir)), "catalog_id")


@REGISTRY.query(
    "error_prompts",
    DIAG
    + """, e AS (SELECT *, split_part(message, ' ', 2)::BIGINT AS n, row_number() OVER (PARTITION BY catalog_id ORDER BY split_part(message, ' ', 2)::BIGINT) AS r, count(*) OVER (PARTITION BY catalog_id) AS total FROM d WHERE level = 'error')
SELECT catalog_id, 'Your patch to catalog-' || catalog_id || ' did not compile (attempt 1 of 3).' || chr(10) || chr(10)
 || string_agg('error at ' || file_name || ':' || line_start || ':' || column_start || chr(10) || '  ' || message || chr(10), '' ORDER BY r) FILTER (r <= 5)
 || CASE WHEN max(total) > 5 THEN chr(10) || '... and ' || (max(total) - 5) || ' further errors, which probably follow from those above.' || chr(10) ELSE '' END
 || chr(10) || 'Mend the cause of the first error and give the whole corrected file. Do not remove the failing code.' AS prompt FROM e GROUP BY catalog_id""",
)
def error_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnostics.diagnostics(diagnostic_lines(spark, sf_dir))
    rows = rows.withColumns({"path": F.format_string("catalog-%d", "catalog_id"), "attempt": F.lit(1), "attempts": F.lit(3), "n": F.regexp_extract("message", r"(\d+)$", 1).cast("long")})
    return diagnostics.render_errors(rows, "catalog_id", "n")


@REGISTRY.query(
    "danger_rules",
    r"""WITH p AS (SELECT DISTINCT patch_id, lower(regexp_extract(replace(relative_path, '\', '/'), '\.([^./]+)$', 1)) AS lang, content FROM code_patches WHERE content IS NOT NULL AND relative_path IS NOT NULL),
f AS (SELECT lang, CASE WHEN lang IN ('rust', 'rs') AND contains(content, 'unsafe') THEN 'UnsafeBlock' WHEN lang IN ('typescript', 'ts', 'tsx') AND (contains(content, 'eval(') OR contains(content, 'dangerouslySetInnerHTML')) THEN 'DangerousSuture'
  WHEN lang IN ('python', 'py') AND (contains(content, 'exec(') OR contains(content, 'pickle.load')) THEN 'PythonExecGate' END AS name FROM p)
SELECT lang, count(*) AS patches, count(name) AS dangerous, max(name) AS name FROM f GROUP BY lang""",
)
def danger_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "code_patches").where("content IS NOT NULL AND relative_path IS NOT NULL").select("patch_id", T.extension("relative_path").alias("lang"), "content").distinct()
    found = p.select("lang", F.get(diagnostics.dangers(F.col("lang"), F.col("content")), 0)["name"].alias("name"))
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("patches"), F.count("name").alias("dangerous"), F.max("name").alias("name"))


@REGISTRY.query(
    "patch_replies",
    r"""WITH p AS (SELECT DISTINCT patch_id, relative_path AS path, content FROM code_patches WHERE patch_id IS NOT NULL),
s AS (SELECT *, list_transform(list_filter(string_split(replace(path, '\', '/'), '/'), lambda c: c <> '' AND c <> '.'), lambda c: CASE c WHEN '..' THEN -1 ELSE 1 END) AS steps FROM p)
SELECT patch_id, path, length(content)::INT AS chars, coalesce(trim(path) <> '' AND NOT starts_with(replace(path, '\', '/'), '/') AND NOT regexp_matches(path, '^[A-Za-z]:')
  AND coalesce(list_min(list_transform(generate_series(1, len(steps)), lambda i: list_sum(steps[1:i]))), 0) >= 0, false) AS safe FROM s""",
)
def patch_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches as JSON replies in prose, extracted, parsed and checked again."""
    p = table(spark, sf_dir, "code_patches").where("patch_id IS NOT NULL").select("patch_id", "relative_path", "content").distinct()
    reply = F.concat(F.lit("Here is the patch:\n```json\n"), F.to_json(F.struct(F.col("relative_path").alias("file_path"), F.col("content").alias("contents"))), F.lit("\n```\n"))
    parsed = p.select("patch_id", diagnostics.parsed_patch(diagnostics.extract_object(reply)).alias("x"))
    return parsed.select("patch_id", "x.path", F.length("x.content").alias("chars"), "x.safe")


@REGISTRY.query(
    "reply_texts",
    "WITH p AS (SELECT DISTINCT patch_id, content FROM code_patches WHERE patch_id IS NOT NULL) SELECT patch_id, CASE WHEN content IS NULL OR regexp_replace(content, '\\s+', '', 'g') = '' THEN md5('call ' || patch_id) ELSE md5(content) END AS text FROM p",
)
def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches as chat replies: the content, or the arguments of a tool call where there is none."""
    p = table(spark, sf_dir, "code_patches").where("patch_id IS NOT NULL").select("patch_id", "content").distinct()
    call = F.array(F.struct(F.struct(F.format_string("call %d", "patch_id").alias("arguments")).alias("function")))
    message = F.struct(F.col("content").alias("content"), call.alias("tool_calls"))
    reply = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    return p.select("patch_id", F.md5(diagnostics.message_text(reply)).alias("text"))


@REGISTRY.query("request_payloads", "SELECT DISTINCT doc_id, md5(text) AS asked FROM documents WHERE text IS NOT NULL")
def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chat payloads: what each asks comes back from the JSON."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    payload = F.to_json(F.struct(F.array(message("system", F.lit("be brief")), message("user", F.col("text")), message("assistant", F.lit("ok"))).alias("messages")))
    return docs.select("doc_id", F.md5(diagnostics.asked_text(payload)).alias("asked"))


@REGISTRY.query(
    "injected_payloads",
    """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, 'anthropic' AS dialect, md5('context' || chr(10) || chr(10) || text) AS first FROM d
UNION ALL SELECT doc_id, 'chat', md5('context') FROM d UNION ALL SELECT doc_id, 'generate', md5('context' || chr(10) || chr(10) || text) FROM d""",
)
def injected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads of three dialects with a context put in: what then comes first."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    user = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    kinds = {"anthropic": F.struct(F.col("text").alias("system"), user.alias("messages")), "chat": F.struct(user.alias("messages")), "generate": F.struct(F.col("text").alias("prompt"))}
    at = {"anthropic": "$.system[0].text", "chat": "$.messages[0].content", "generate": "$.prompt"}
    rows = None
    for name, body in kinds.items():
        sent = docs.select("doc_id", F.to_json(body).alias("payload"), F.lit("context").alias("context"), F.lit(name).alias("dialect"))
        out = sent.select("doc_id", "dialect", diagnostics.inject(F.col("payload"), F.col("context"), F.col("dialect")).alias("out"))
        one = out.select("doc_id", "dialect", F.md5(F.try_variant_get(F.try_parse_json("out"), at[name], "string")).alias("first"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@REGISTRY.query(
    "circular_bind",
    """WITH v AS (SELECT DISTINCT vec_id AS id, embedding AS v FROM embeddings), k AS (SELECT v AS k FROM v WHERE id = 0)
SELECT id, pos::INT AS pos, round(list_sum(list_transform(generate_series(0, 63), lambda j: k[j + 1]::DOUBLE * v[(pos - j + 64) % 64 + 1]::DOUBLE)), 6) AS x FROM v, k, generate_series(0, 63) g(pos)""",
)
def circular_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir)
    key = v.where("id = 0").select(F.col("vector").alias("k"))  # one row
    bound = v.join(F.broadcast(key)).select("id", holographic.bind(F.col("k"), F.col("vector")).alias("b"))
    return bound.select("id", F.posexplode("b").alias("pos", "x")).withColumn("x", F.round("x", 6))


@REGISTRY.query(
    "circular_unbind",
    """WITH v AS (SELECT DISTINCT vec_id AS id, embedding AS v FROM embeddings), k AS (SELECT v AS k FROM v WHERE id = 0)
SELECT id, pos::INT AS pos, round(list_sum(list_transform(generate_series(0, 63), lambda j: k[j + 1]::DOUBLE * v[(pos + j) % 64 + 1]::DOUBLE)), 6) AS x FROM v, k, generate_series(0, 63) g(pos)""",
)
def circular_unbind(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir)
    key = v.where("id = 0").select(F.col("vector").alias("k"))  # one row
    got = v.join(F.broadcast(key)).select("id", holographic.unbind(F.col("k"), F.col("vector")).alias("b"))
    return got.select("id", F.posexplode("b").alias("pos", "x")).withColumn("x", F.round("x", 6))


@REGISTRY.query("workspace_vector")
def workspace_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector of the whole workspace, from hash embeddings of its first blocks."""
    from corpusloom.operators import dense
    from corpusloom.plans.text import files

    def embed(blocks: DataFrame) -> DataFrame:
        named = blocks.select(F.format_string("%s#%d", "path", "no").alias("key"), "text", "path", "no")
        raw = dense.weighted(dense.raw_features(named, 64, "key", "text"), np.ones(64))
        return raw.join(named.select("key", "path", "no"), "key").select("path", "no", "vector")

    return holographic.workspace_vector(files(spark, sf_dir), 64, embed).select(F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@REGISTRY.query("superposition_recall")
def superposition_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall from superpositions of growing size; mean cosine falls as 1 / sqrt(k)."""
    from corpusloom.functions.vectors import normalized

    v = collection(spark, sf_dir).select(F.col("id").alias("n"), F.format_string("src/module_%d/file_%d.rs", F.floor(F.col("id") / 20), F.col("id")).alias("path"), normalized(F.col("vector")).alias("vector"))
    out = holographic.superposition_recall(v, [1, 2, 5, 10, 20], 64)
    return out.select("k", F.round("mean_cosine", 6).alias("mean_cosine"), "accuracy")


@REGISTRY.query("surprise_gists")
def surprise_gists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gist of each label's vectors, in id order, skipping what it knows already."""
    v = collection(spark, sf_dir).select(F.col("label").cast("long").alias("label"), "id", F.col("vector").cast("array<double>").alias("vector"), F.format_string("l%d/f%d", "label", "id").alias("path"))
    out = holographic.gist_fold(v, "label", "id")
    return out.select(F.col("key").alias("label"), "kept", F.transform("gist", lambda x: F.round(x, 6)).alias("gist"))


@REGISTRY.query("watermarked")
def watermarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir).select("id", F.col("vector").cast("array<double>").alias("vector"))
    return v.select("id", F.transform(holographic.watermark_bias(F.col("vector"), "corpus"), lambda x: F.round(x, 6)).alias("marked"))


@REGISTRY.query("path_directions")
def path_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "chunks").where("path IS NOT NULL").select(T.normal_path("path").alias("path")).distinct()
    return paths.select("path", F.transform(holographic.path_direction(F.col("path"), 16), lambda x: F.round(x, 6)).alias("direction"))
