"""Structured Streaming jobs: edits into a live layer, and activations into moving averages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.functions.text import is_indexable, normal_path
from corpusloom.operators.live import latest_edits

EDIT = "path string, seq long, op string, ts timestamp, text string"
SAMPLE = "cluster long, seq long, ts timestamp, x double"


def classified(edits: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """Edits with what becomes of each: ingest, remove, ignore (not indexable or too large) or
    failed (no text for an update)."""
    path = normal_path("path")
    action = (
        F.when(~is_indexable(path), "ignore")
        .when(F.col("op") == "delete", "remove")
        .when(F.col("text").isNull(), "failed")
        .when(F.octet_length("text") > max_bytes, "ignore")
        .otherwise("ingest")
    )
    return edits.withColumn("path", path).withColumn("action", action)


def stream_edits(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Fold a folder of edit files into per-batch upserts under `target`/batch=N. A batch is written
    under its number, so a batch that is repeated after a failure replaces itself. Read with
    live_layer. No state is kept between batches; see stream_bursts for debouncing."""
    edits = spark.readStream.schema(EDIT).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        latest_edits(classified(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return edits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_layer(spark: SparkSession, target: str) -> DataFrame:
    """The newest edit of each path over all batches; failed edits keep what was there before."""
    rows = spark.read.parquet(target).where("action <> 'failed'")
    return latest_edits(rows.drop("batch"))


def watch_counters(edits: DataFrame) -> DataFrame:
    """(action, n) of classified edits."""
    return edits.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def _averages(alpha: float, bar: float):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ema, n, first = state.get if state.exists else (0.0, 0, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            ema, n = ema + alpha * (r.x - ema), n + 1
            if first < 0 and ema >= bar:
                first = int(r.seq)
        state.update((ema, n, first))
        yield pd.DataFrame({"cluster": [key[0]], "ema": [ema], "n": [n], "first_fault": [first]})

    return update


def stream_activations(spark: SparkSession, source: str, target: str, checkpoint: str, alpha: float = 0.1, bar: float = 0.85) -> StreamingQuery:
    """Moving average of each cluster's activations and the first sample that lifts it to the bar
    (-1 before), kept as keyed state across batches and runs. Changed clusters of each batch are
    written under `target`/batch=N; the newest row of a cluster is that with the greatest n."""
    samples = spark.readStream.schema(SAMPLE).parquet(source)
    kept = samples.groupBy("cluster").applyInPandasWithState(
        _averages(alpha, bar), "cluster long, ema double, n long, first_fault long", "ema double, n long, first_fault long", "update", "NoTimeout"
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TOUCH = "path string, ts timestamp"
BURST = "path string, first_ts timestamp, last_ts timestamp, touches long"


def _bursts(quiet_ms: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        out = []
        if state.hasTimedOut:
            out.append((key[0], first, last, n))
            state.remove()
        else:
            times = sorted(t for part in batches for t in (part["ts"].astype("datetime64[us]").astype("int64").tolist()))
            for t in times:
                if last is not None and t - last >= quiet_ms * 1000:
                    out.append((key[0], first, last, n))
                    first, n = None, 0
                first = t if first is None else min(first, t)
                last = t if last is None or n == 0 else max(last, t)
                n += 1
            state.update((first, last, n))
            # The timer must lie after the watermark; a burst that is over by now is released at once after it.
            state.setTimeoutTimestamp(max(last // 1000 + quiet_ms, state.getCurrentWatermarkMs() + 1))
        rows = pd.DataFrame(out, columns=["path", "first_ts", "last_ts", "touches"])
        for c in ("first_ts", "last_ts"):
            rows[c] = pd.to_datetime(rows[c], unit="us")
        yield rows

    return update


def bursts(touches: DataFrame, quiet_ms: int) -> DataFrame:
    """(path, first_ts, last_ts, touches) of a stream of touches (path, ts): a burst of a path is released
    when the watermark shows that it was left alone for quiet_ms; a gap of exactly that ends it. The
    watermark lags twice the quiet time behind, so touches that arrive later than that are lost."""
    known = touches.withWatermark("ts", f"{2 * quiet_ms} milliseconds")
    return known.groupBy("path").applyInPandasWithState(_bursts(quiet_ms), BURST, "first long, last long, n long", "append", "EventTimeTimeout")


def stream_bursts(spark: SparkSession, source: str, target: str, checkpoint: str, quiet_ms: int = 500) -> StreamingQuery:
    """Debounce a folder of touch files into bursts under `target`. State and timers are in the
    checkpoint; what is still open waits for later touches to move the watermark."""
    found = bursts(spark.readStream.schema(TOUCH).option("maxFilesPerTrigger", 1).parquet(source), quiet_ms)
    return found.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _faults(alpha: float, bar: float, hold: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ema, n, phase, left = state.get if state.exists else (0.0, 0, "monitoring", 0)
        rows, out = pd.concat(list(batches)).sort_values("seq"), []
        for r in rows.itertuples():
            ema, n = (1 - alpha) * ema + alpha * r.x, min(n + 1, SAMPLE_CAP)
            before = phase
            if phase == "monitoring" and ema >= bar:
                phase = "fault_detected"
            elif phase == "fault_detected":
                phase, left = "inflating", hold
            elif phase == "inflating":
                left -= 1
                phase = "monitoring" if left <= 0 else phase
            if phase != before:
                out.append((key[0], int(r.seq), before, phase, ema, n))
        state.update((ema, n, phase, left))
        yield pd.DataFrame(out, columns=["cluster", "seq", "before", "phase", "ema", "samples"])

    return update


#: Samples of a cluster that are counted at most.
SAMPLE_CAP = 100


def fault_phases(samples: DataFrame, alpha: float = 0.1, bar: float = 0.85, hold: int = 3) -> DataFrame:
    """(cluster, seq, before, phase, ema, samples): changes of each cluster's phase in a stream of samples
    (cluster, seq, x). A moving average at the bar is a fault; the next sample begins the inflation,
    which takes `hold` samples and leads back to monitoring, where a further crossing counts again.
    Also for batches, whose rows then are one run of the same machine."""
    schema = "cluster long, seq long, before string, phase string, ema double, samples int"
    picked = samples.select("cluster", "seq", "x")
    if samples.isStreaming:
        return picked.groupBy("cluster").applyInPandasWithState(_faults(alpha, bar, hold), schema, "ema double, n int, phase string, left int", "append", "NoTimeout")

    class Once:
        exists = False

        def update(self, value: tuple) -> None:
            pass

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return next(_faults(alpha, bar, hold)(key, iter([rows]), Once()))

    return picked.groupBy("cluster").applyInPandas(run, schema)
