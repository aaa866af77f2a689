"""Live overlay, access heat and event folds over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import normal_path
from corpusloom.session import running


def plain_edits(log: DataFrame) -> DataFrame:
    """A log (path, seq, op, text) whose op may also be rename (with a column to: the path is deleted and
    `to` updated with the text) or clear (every earlier edit is forgotten), as updates and deletes."""
    if "to" not in log.columns:
        log = log.withColumn("to", F.lit(None).cast("string"))
    last_clear = log.where("op = 'clear'").agg(F.max("seq").alias("cleared"))
    kept = log.join(F.broadcast(last_clear)).where("op <> 'clear' AND (cleared IS NULL OR seq > cleared)").drop("cleared")
    renamed = kept.where("op = 'rename'")
    gone = renamed.withColumn("op", F.lit("delete")).withColumn("text", F.lit(None).cast("string"))
    come = renamed.withColumn("op", F.lit("update")).withColumn("path", F.col("to"))
    return kept.where("op <> 'rename'").unionByName(gone).unionByName(come).drop("to")


def latest_edits(log: DataFrame) -> DataFrame:
    """(path, seq, op, text): the last edit of each path by sequence, after plain_edits; the ranking is
    limited before its shuffle. Deletions stay as tombstones. Null paths are dropped."""
    w = W.partitionBy("path").orderBy(F.col("seq").desc(), F.col("op"))
    rows = plain_edits(log).where("path IS NOT NULL").withColumn("path", normal_path("path"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def live_view(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Base rows (path, ...) of untouched paths and the edits' rows, with their origin. An edited or
    deleted path hides its base rows; a deletion or empty edit adds none."""
    columns = [c for c in base.columns]
    kept = base.join(edits.select("path"), "path", "left_anti").withColumn("origin", F.lit("base"))
    fresh = edits.where("op <> 'delete' AND text IS NOT NULL AND text <> ''").withColumn("origin", F.lit("delta"))
    return kept.select(*columns, "origin").unionByName(fresh.select(*[c if c in edits.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in columns], "origin"))


def debounced(touches: DataFrame, quiet_ms: int, blocks: int = 64) -> DataFrame:
    """(path, session, first_ts, last_ts, first_seq, touches): bursts of touches (path, seq, ts) of a
    path. A gap of at least quiet_ms ends a burst (a session window would merge a gap of exactly
    that length). Null paths and times are left out.

    A path's touches are cut into blocks of time, so that a path with a third of all touches is
    spread; the last touch and the number of bursts of earlier blocks are carried over."""
    rows = touches.where("path IS NOT NULL AND ts IS NOT NULL").select("path", "seq", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    span = rows.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    rows = rows.join(F.broadcast(span)).withColumn("block", F.floor((F.col("us") - F.col("lo")) * blocks / (F.col("hi") - F.col("lo") + 1)).cast("int")).drop("lo", "hi")
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy("path", "block").agg(F.max("us").alias("end")).select("path", "block", F.max("end").over(earlier).alias("before"))
    inner = W.partitionBy("path", "block").orderBy("us", "seq")
    gap = F.col("us") - F.coalesce(F.lag("us").over(inner), F.col("before"))
    marked = rows.join(ends, ["path", "block"]).withColumn("new", F.when(gap.isNull() | (gap >= quiet_ms * 1000), 1).otherwise(0))
    marked = marked.withColumn("inner", F.sum("new").over(inner))
    parts = marked.groupBy("path", "block", "inner").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("touches"))
    counts = parts.groupBy("path", "block").agg(F.max("inner").alias("n"))
    offsets = counts.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered_parts = parts.join(offsets, ["path", "block"]).withColumn("session", F.col("offset") + F.col("inner"))
    # A burst that goes on in the next block has inner 0 there, which is the last number of the blocks before.
    return numbered_parts.groupBy("path", "session").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min("first_seq").alias("first_seq"), F.sum("touches").alias("touches"))


def heat(access: DataFrame, decay: float = 0.98) -> DataFrame:
    """(item, heat): accesses weighted by decay ** age in generations, relative to the hottest. The
    closed form of a decaying counter: sums combine map-side, whatever an item's share."""
    last = access.agg(F.max("generation").alias("last"))
    weight = F.pow(F.lit(decay), F.col("last") - F.col("generation"))
    sums = access.join(F.broadcast(last)).groupBy("item").agg(F.sum(weight).alias("h"))
    top = sums.agg(F.max("h").alias("top"))
    return sums.join(F.broadcast(top)).select("item", F.when(F.col("top") > 0, F.col("h") / F.col("top")).otherwise(0.0).alias("heat"))


def pin_prefix(hot: DataFrame, budget: int) -> DataFrame:
    """(item, heat, bytes, total): hottest items in order (heat, then item) up to the first that
    exceeds the byte budget; a prefix, not a greedy fill. Items without size are left out. The
    running sum goes by range partitions, whatever the number of items."""
    known = hot.where("bytes IS NOT NULL AND item IS NOT NULL")
    return running(known, [F.col("heat").desc(), F.col("item")], F.col("bytes"), "total").where(F.col("total") <= budget)


def pin_report(hot: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """(state, items, bytes): how many of the hot items (item, heat) are pinned, left out for the budget, or
    unknown to sizes (item, bytes)."""
    rows = hot.select("item", "heat").join(sizes.select("item", "bytes"), "item", "left")
    pinned = pin_prefix(rows, budget).select("item", F.lit("pinned").alias("state"))
    state = F.when(F.col("bytes").isNull(), "unknown").otherwise(F.coalesce("state", F.lit("over_budget")))
    return rows.join(pinned, "item", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def ema(rows: DataFrame, key: str, order: str, value: str, alpha: float, buckets: int = 64) -> DataFrame:
    """(key, ema, n): exponential moving average from 0 in row order: sum of alpha * (1 - alpha)^k *
    x, k counted from the last row. Ranks come from counts of time buckets, so that no key's rows
    meet in one task: within (key, bucket) a window ranks, and the counts of later buckets are
    added."""
    spans = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    width = (F.col("hi") - F.col("lo") + 1) / F.lit(buckets)
    cut = rows.join(F.broadcast(spans)).withColumn("bucket", F.floor((F.col(order) - F.col("lo")) / width).cast("int"))
    counts = cut.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    later = counts.withColumn("later", F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy(key, "bucket").orderBy(F.col(order).desc())) - 1
    aged = cut.withColumn("place", place).join(later.select(key, "bucket", "later"), [key, "bucket"])
    part = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("place") + F.col("later")) * F.col(value)
    return aged.groupBy(key).agg(F.sum(part).alias("ema"), F.count(F.lit(1)).alias("n"))
