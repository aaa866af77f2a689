"""Queries on live overlays, access logs and state replays. The events table plays the log: an
event's user is the session or device, its id the order, its value a magnitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import live, state
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of 400 paths: an error deletes, anything else writes."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return e.select(F.format_string("src/f%d.rs", F.col("event_id") % 400).alias("path"), F.col("event_id").alias("seq"), op.alias("op"), "ts", F.format_string("edit %d", "event_id").alias("text"))


EDITS = "WITH log AS (SELECT 'src/f' || (event_id % 400) || '.rs' AS path, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op, ts, 'edit ' || event_id AS text FROM events), last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)\n"


@REGISTRY.query("latest_edit_state", EDITS + "SELECT path, seq, op FROM last")
def latest_edit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.latest_edits(edit_log(spark, sf_dir)).select("path", "seq", "op")


BASE = "base AS (SELECT 'src/f' || (doc_id % 700) || '.rs' AS path, doc_id AS seq, max(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id)\n"


@REGISTRY.query(
    "shadow_merge",
    EDITS + ", " + BASE + "SELECT path, seq, 'base' AS origin FROM base WHERE path NOT IN (SELECT path FROM last) UNION ALL SELECT path, seq, 'delta' FROM last WHERE op <> 'delete'",
)
def shadow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text"))
    base = docs.select(F.format_string("src/f%d.rs", F.col("doc_id") % 700).alias("path"), F.col("doc_id").alias("seq"), "text")
    return live.live_view(base, live.latest_edits(edit_log(spark, sf_dir))).select("path", "seq", "origin")


@REGISTRY.query(
    "debounce_bursts",
    """WITH t AS (SELECT user_id, ts, event_id, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 3600000000, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM t)
SELECT user_id, session::BIGINT AS session, count(*) AS touches, min(event_id) AS first_id FROM s GROUP BY ALL""",
)
def debounce_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", F.col("event_id").alias("seq"))
    return live.debounced(e, 3_600_000).select(F.col("path").alias("user_id"), "session", "touches", F.col("first_seq").alias("first_id"))


HEAT = """WITH g AS (SELECT DISTINCT event_id // 100 AS generation, user_id AS item FROM events), h AS (SELECT item, sum(pow(0.98, (SELECT max(generation) FROM g) - generation)) AS h FROM g GROUP BY item),
hot AS (SELECT item, h / max(h) OVER () AS heat FROM h)
"""


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("generation"), F.col("user_id").alias("item")).distinct()


@REGISTRY.query("heat_ranking", HEAT + "SELECT item, round(heat, 6) AS heat, row_number() OVER (ORDER BY round(heat, 6) DESC, item)::INT AS rank FROM hot QUALIFY rank <= 50")
def heat_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    hot = live.heat(access_log(spark, sf_dir)).withColumn("heat", F.round("heat", 6))
    top = hot.orderBy(F.col("heat").desc(), "item").limit(50)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("heat").desc(), "item")))


@REGISTRY.query("heat_prune", HEAT + "SELECT item FROM hot WHERE round(heat, 6) >= 0.5")
def heat_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.heat(access_log(spark, sf_dir)).where(F.round("heat", 6) >= 0.5).select("item")


@REGISTRY.query(
    "pin_prefix",
    HEAT + ", b AS (SELECT item, round(heat, 6) AS heat, 1000 + item * 37 AS bytes FROM hot), r AS (SELECT *, sum(bytes) OVER (ORDER BY heat DESC, item)::BIGINT AS total FROM b) SELECT item, total FROM r WHERE total <= 100000",
)
def pin_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = live.heat(access_log(spark, sf_dir)).select("item", F.round("heat", 6).alias("heat"), (F.col("item") * 37 + 1000).alias("bytes"))
    return live.pin_prefix(hot, 100_000).select("item", "total")


EMA = """WITH a AS (SELECT user_id % 10 AS cluster, event_id, least(value / 50, 1.0) AS x FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY event_id DESC) - 1 AS k FROM a)
"""


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("cluster"), "event_id", F.least(F.col("value") / 50, F.lit(1.0)).alias("x"))


@REGISTRY.query("activation_ema", EMA + "SELECT cluster, round(sum(0.1 * pow(0.9, k) * x), 6) AS ema, count(*) AS n, least(count(*), 100) AS samples FROM r GROUP BY cluster")
def activation_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.ema(activations(spark, sf_dir), "cluster", "event_id", "x", 0.1).select("cluster", F.round("ema", 6).alias("ema"), "n", F.least("n", F.lit(100).cast("long")).alias("samples"))


@REGISTRY.query(
    "latency_ema",
    """WITH r AS (SELECT event_type AS route, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS k FROM events)
SELECT route, round(sum(0.1 * pow(0.9, k) * value), 6) AS latency, count(*) AS n FROM r GROUP BY route""",
)
def latency_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving average of each route's latency, with its number of requests."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), "event_id", "value")
    return live.ema(rows, "route", "event_id", "value", 0.1).select("route", F.round("ema", 6).alias("latency"), "n")


@REGISTRY.query(
    "watch_counters",
    r"""WITH e AS (SELECT 'src/f' || (event_id % 400) || CASE WHEN event_id % 3 = 0 THEN '.png' ELSE '.rs' END AS path, event_type, event_id FROM events)
SELECT CASE WHEN path LIKE '%.png' THEN 'ignore' WHEN event_type = 'error' THEN 'remove' WHEN event_id % 11 = 0 THEN 'failed' ELSE 'ingest' END AS action, count(*) AS n FROM e GROUP BY 1""",
)
def watch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each edit of the log, counted."""
    from corpusloom.streaming import jobs

    e = table(spark, sf_dir, "events")
    ext = F.when(F.col("event_id") % 3 == 0, ".png").otherwise(".rs")
    log = e.select(F.concat(F.format_string("src/f%d", F.col("event_id") % 400), ext).alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.when(F.col("event_id") % 11 != 0, "text").alias("text"))
    return jobs.watch_counters(jobs.classified(log))


@REGISTRY.query(
    "activation_peaks",
    EMA + "SELECT cluster, max(x) AS peak, arg_max(event_id, (x, -event_id)) AS at, count(DISTINCT event_id % 8) AS heads, count(*) FILTER (x >= 0.85) AS strong FROM a GROUP BY cluster",
)
def activation_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activations(spark, sf_dir)
    return a.groupBy("cluster").agg(
        F.max("x").alias("peak"), F.max_by("event_id", F.struct("x", -F.col("event_id"))).alias("at"), F.count_distinct(F.col("event_id") % 8).alias("heads"), F.sum((F.col("x") >= 0.85).cast("long")).alias("strong")
    )


@REGISTRY.query("ring_buffer", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 16")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 16 events of each user; limited before the shuffle."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(F.col("event_id").desc())
    return table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("rn", F.row_number().over(w)).where("rn <= 16").drop("rn")


STATE = "CASE WHEN c >= 80 THEN 'critical' WHEN c >= 72 THEN 'thermal_throttle' WHEN w >= 150 THEN 'power_throttle' ELSE 'normal' END"
HEATED = "WITH t AS (SELECT user_id, event_id, 60 + value / 8 AS c, 100 + value AS w FROM events)\n"


def _thermal() -> Column:
    return state.thermal_state(60 + F.col("value") / 8, 100 + F.col("value"))


@REGISTRY.query(
    "thermal_states",
    HEATED + f"SELECT state, count(*) AS n, max(CASE state WHEN 'critical' THEN 50 WHEN 'normal' THEN 0 ELSE 25 END)::INT AS delay_ms FROM (SELECT {STATE} AS state FROM t) GROUP BY state",
)
def thermal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(_thermal().alias("s"))
    return s.groupBy("s.state").agg(F.count(F.lit(1)).alias("n"), F.max("s.delay_ms").alias("delay_ms"))


@REGISTRY.query(
    "thermal_transitions",
    HEATED
    + f""", x AS (SELECT *, {STATE} AS state FROM t), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM x)
SELECT before, state, count(*) AS n FROM l WHERE before IS NOT NULL AND before <> state GROUP BY ALL""",
)
def thermal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    s = table(spark, sf_dir, "events").select("user_id", "event_id", _thermal()["state"].alias("state"))
    before = F.lag("state").over(W.partitionBy("user_id").orderBy("event_id"))
    return s.withColumn("before", before).where("before <> state").groupBy("before", "state").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query(
    "burst_routing",
    """SELECT CASE WHEN value * 1000 > 32000 AND event_type <> 'error' THEN 'burst' ELSE 'local' END AS route, count(*) AS requests, sum((value * 1000)::BIGINT)::BIGINT AS tokens,
count(*) FILTER (event_type = 'error') AS offline FROM events GROUP BY 1""",
)
def burst_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over 32,000 tokens go to the burst backend unless it is offline."""
    tokens = F.col("value") * 1000
    route = F.when((tokens > 32000) & (F.col("event_type") != "error"), "burst").otherwise("local")
    return table(spark, sf_dir, "events").groupBy(route.alias("route")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.round(tokens).cast("long")).alias("tokens"), F.sum((F.col("event_type") == "error").cast("long")).alias("offline")
    )


@REGISTRY.query(
    "prefetch_schedule",
    """WITH m AS (SELECT DISTINCT catalog_id AS model, (dim / 4)::INT AS n FROM catalog_meta), s AS (SELECT model, n, unnest(generate_series(0, n - 1))::INT AS step FROM m)
SELECT model, step, 'prefetch' AS action, (step + d)::INT AS layer FROM s, (VALUES (1), (2)) v(d) WHERE step + d < n UNION ALL SELECT model, step, 'evict', (step - 2)::INT FROM s WHERE step >= 2""",
)
def prefetch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "catalog_meta").select(F.col("catalog_id").alias("model"), F.floor(F.col("dim") / 4).cast("int").alias("n")).distinct()
    return state.prefetch_schedule(models)


@REGISTRY.query(
    "correction_outcomes",
    """WITH a AS (SELECT user_id AS target, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS errors FROM events),
t AS (SELECT target, min(attempt) FILTER (errors = 0) AS first, max(attempt) AS last FROM a WHERE attempt <= 3 GROUP BY target)
SELECT target, CASE WHEN first IS NOT NULL THEN 'verified' ELSE 'exhausted' END AS outcome, coalesce(first, last)::INT AS attempt FROM t""",
)
def correction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), n.alias("attempt"), F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("errors"))
    return state.attempts_outcome(a)


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of each user's device: errors remove, clicks touch, anything else adds a block."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "access").otherwise("add")
    return e.select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 13).alias("block"), (F.col("value") * 10).cast("long").alias("bytes"))


@REGISTRY.query("lru_evictions")
def lru_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.lru_evictions(command_log(spark, sf_dir), 600)


@REGISTRY.query("allocator_trace")
def allocator_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = command_log(spark, sf_dir).withColumn("op", F.when(F.col("op") == "add", "alloc").otherwise("free"))
    return state.allocator_trace(log, 1024)


@REGISTRY.query("streamed_weights")
def streamed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.streamed_weights(command_log(spark, sf_dir), 800)


LOG = """WITH RECURSIVE log AS (SELECT user_id AS device, event_id AS seq, CASE event_type WHEN 'error' THEN 'remove' WHEN 'click' THEN 'access' ELSE 'add' END AS op, event_id % 13 AS block, floor(round(value * 10, 6))::BIGINT AS bytes,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
"""


@REGISTRY.query(
    "injected_entries",
    LOG
    + """, f AS (SELECT device, 0::BIGINT AS r, 0::BIGINT AS seq, 0::BIGINT AS at, 0::BIGINT AS position, true AS accepted FROM (SELECT DISTINCT device FROM log)
  UNION ALL SELECT l.device, l.r, l.seq, CASE WHEN f.at + l.bytes <= 5000 THEN f.at + l.bytes ELSE f.at END, CASE WHEN f.at + l.bytes <= 5000 THEN f.at END, f.at + l.bytes <= 5000 FROM f JOIN log l ON l.device = f.device AND l.r = f.r + 1)
SELECT device, seq, position, accepted FROM f WHERE r > 0""",
)
def injected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.injected(command_log(spark, sf_dir).drop("op"), 5000)


@REGISTRY.query("injected_clusters")
def injected_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with removals of whole clusters."""
    return state.injected(command_log(spark, sf_dir).withColumn("cluster", F.col("block") % 3), 5000)


@REGISTRY.query(
    "scratchpad_trace",
    LOG
    + """, f AS (SELECT device, 0::BIGINT AS r, 0::BIGINT AS seq, 0::BIGINT AS used, 0::BIGINT AS "offset" FROM (SELECT DISTINCT device FROM log)
  UNION ALL SELECT l.device, l.r, l.seq, CASE WHEN l.op <> 'add' THEN f.used - least(l.bytes, f.used) WHEN f.used + l.bytes <= 1024 THEN f.used + l.bytes ELSE f.used END, CASE WHEN l.op = 'add' AND f.used + l.bytes <= 1024 THEN f.used END FROM f JOIN log l ON l.device = f.device AND l.r = f.r + 1)
SELECT device, seq, "offset", used FROM f WHERE r > 0""",
)
def scratchpad_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = command_log(spark, sf_dir).withColumn("op", F.when(F.col("op") == "add", "alloc").otherwise("free"))
    return state.scratchpad(log, 1024)


@REGISTRY.query(
    "resident_use",
    LOG + ", m AS (SELECT device, block, arg_max(op, seq) AS op, arg_max(bytes, seq) AS bytes FROM log WHERE op <> 'access' GROUP BY ALL) SELECT device, count(*) AS blocks, sum(bytes)::BIGINT AS used FROM m WHERE op = 'add' GROUP BY device",
)
def resident_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.resident_use(command_log(spark, sf_dir))


@REGISTRY.query(
    "pin_report",
    HEAT
    + """, b AS (SELECT item, round(heat, 6) AS heat, CASE WHEN item % 7 = 0 THEN NULL ELSE 1000 + item * 37 END AS bytes FROM hot), r AS (SELECT item, sum(bytes) OVER (ORDER BY heat DESC, item) AS total FROM b WHERE bytes IS NOT NULL)
SELECT CASE WHEN b.bytes IS NULL THEN 'unknown' WHEN total <= 100000 THEN 'pinned' ELSE 'over_budget' END AS state, count(*) AS items, coalesce(sum(b.bytes), 0)::BIGINT AS bytes FROM b LEFT JOIN r USING (item) GROUP BY 1""",
)
def pin_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the hot items under a byte budget, when some of them have no known size."""
    hot = live.heat(access_log(spark, sf_dir)).select("item", F.round("heat", 6).alias("heat"))
    sizes = hot.where(F.col("item") % 7 != 0).select("item", (F.col("item") * 37 + 1000).alias("bytes"))
    return live.pin_report(hot, sizes, 100_000)


@REGISTRY.query(
    "running_latency",
    """WITH RECURSIVE l AS (SELECT event_type AS route, floor(round(value, 6))::BIGINT AS ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
f AS (SELECT route, 0::BIGINT AS r, 0::BIGINT AS avg FROM (SELECT DISTINCT route FROM l) UNION ALL SELECT l.route, l.r, (f.avg + l.ms) // 2 FROM f JOIN l ON l.route = f.route AND l.r = f.r + 1)
SELECT route, arg_max(avg, r) AS latency, max(r) AS requests FROM f GROUP BY route""",
)
def running_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route's running average in whole numbers, (average + latency) / 2 from 0 in order: after 64
    halvings an earlier request cannot count any more, so the last 64 decide."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), "event_id", F.floor(F.round("value", 6)).cast("long").alias("ms"))
    last = rows.withColumn("rn", F.row_number().over(W.partitionBy("route").orderBy(F.col("event_id").desc()))).where("rn <= 64")
    packed = last.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("event_id", "ms"))).alias("xs"))
    fold = F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: F.floor((s + x["ms"]) / 2).cast("long"))
    counts = rows.groupBy("route").agg(F.count(F.lit(1)).alias("requests"))
    return packed.select("route", fold.alias("latency")).join(counts, "route")


@REGISTRY.query("fault_phases")
def fault_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase changes of each cluster, as the stream's machine makes them."""
    from corpusloom.streaming import jobs

    rows = activations(spark, sf_dir).select("cluster", F.col("event_id").alias("seq"), "x")
    return jobs.fault_phases(rows, bar=0.6).select("cluster", "seq", "before", "phase", F.round("ema", 6).alias("ema"), "samples")


@REGISTRY.query(
    "route_stats",
    "SELECT event_type AS route, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS worst FROM events GROUP BY event_type",
)
def route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("worst"))
