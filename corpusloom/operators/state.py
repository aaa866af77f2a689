"""Replays of command logs: eviction queues, allocators and governors.

A log belongs to one device or session; each is folded by itself in an Arrow group, so a log's
length is what one machine produced, and logs spread over the cluster.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lru_evictions(log: DataFrame, cap: int, free_min: int = 0, total: int | None = None) -> DataFrame:
    """(device, seq, evicted, used): blocks pushed out by each command of a log (device, seq, op, block,
    bytes). op is add, access or remove; access moves a block to the back; after an add, blocks
    leave from the front while more than `cap` is used, or less than free_min of `total` is free,
    but never the block just added."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        queue: OrderedDict[int, int] = OrderedDict()
        used, out = 0, []
        for r in rows.sort_values(["seq", "block"]).itertuples():
            if r.op == "add":
                used -= queue.pop(r.block, 0)
                queue[r.block] = r.bytes
                used += r.bytes
                while len(queue) > 1 and (used > cap or (total is not None and total - used < free_min)):
                    block, size = queue.popitem(last=False)
                    used -= size
                    out.append((r.device, r.seq, block, used))
            elif r.op == "access" and r.block in queue:
                queue.move_to_end(r.block)
            elif r.op == "remove":
                used -= queue.pop(r.block, 0)
        return pd.DataFrame(out, columns=["device", "seq", "evicted", "used"])

    return log.groupBy("device").applyInPandas(replay, "device long, seq long, evicted long, used long")


def allocator_trace(log: DataFrame, size: int) -> DataFrame:
    """(device, seq, offset, used): first-fit allocations of a log (device, seq, op, block, bytes) in a
    region of `size` bytes; op is alloc or free. What is left of a free range goes to the front of
    the list; freed neighbours are joined. offset is null where nothing fits."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        free: list[tuple[int, int]] = [(0, size)]
        held: dict[int, tuple[int, int]] = {}
        out = []
        for r in rows.sort_values(["seq", "block"]).itertuples():
            place = None
            if r.op == "alloc" and r.block not in held:
                for i, (at, length) in enumerate(free):
                    if length >= r.bytes:
                        place = at
                        del free[i]
                        if length > r.bytes:
                            free.insert(0, (at + r.bytes, length - r.bytes))
                        held[r.block] = (at, r.bytes)
                        break
            elif r.op == "free" and r.block in held:
                free = _joined([*free, held.pop(r.block)])
            out.append((r.device, r.seq, place, sum(n for _, n in held.values())))
        return pd.DataFrame(out, columns=["device", "seq", "offset", "used"]).astype({"offset": "Int64"})

    return log.groupBy("device").applyInPandas(replay, "device long, seq long, offset long, used long")


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for at, n in sorted(ranges):
        if out and out[-1][0] + out[-1][1] == at:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((at, n))
    return out


def streamed_weights(log: DataFrame, cap: int) -> DataFrame:
    """(device, seq, block, action): prefetches that had to evict, by least access count, then least
    recent access; log as in lru_evictions."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        pages: dict[int, list] = {}
        out = []
        for r in rows.sort_values(["seq", "block"]).itertuples():
            if r.op == "access" and r.block in pages:
                pages[r.block][0] += 1
                pages[r.block][1] = r.seq
            elif r.op == "add" and r.block not in pages and r.bytes <= cap:
                while sum(p[2] for p in pages.values()) + r.bytes > cap:
                    victim = min(pages, key=lambda b: (pages[b][0], pages[b][1], b))
                    del pages[victim]
                    out.append((r.device, r.seq, victim, "evict"))
                pages[r.block] = [0, r.seq, r.bytes]
                out.append((r.device, r.seq, r.block, "load"))
            elif r.op == "remove":
                pages.pop(r.block, None)
        return pd.DataFrame(out, columns=["device", "seq", "block", "action"])

    return log.groupBy("device").applyInPandas(replay, "device long, seq long, block long, action string")


def injected(log: DataFrame, capacity: int) -> DataFrame:
    """(device, seq, position, accepted): a bump cursor over (device, seq, bytes) and, where the log has
    them, op and cluster. An entry that does not fit is rejected and leaves the cursor where it is;
    op remove drops the entries of its cluster without moving the cursor back, and accepts if there
    were any."""
    full = log if "op" in log.columns else log.withColumns({"op": F.lit("add"), "cluster": F.lit(0)})

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        at, out, held = 0, [], {}
        for r in rows.sort_values("seq").itertuples():
            if r.op == "remove":
                out.append((r.device, r.seq, None, held.pop(r.cluster, 0) > 0))
                continue
            fits = at + r.bytes <= capacity
            out.append((r.device, r.seq, at if fits else None, bool(fits)))
            if fits:
                at, held[r.cluster] = at + r.bytes, held.get(r.cluster, 0) + 1
        return pd.DataFrame(out, columns=["device", "seq", "position", "accepted"]).astype({"position": "Int64"})

    return full.select("device", "seq", "op", "cluster", "bytes").groupBy("device").applyInPandas(replay, "device long, seq long, position long, accepted boolean")


def thermal_state(temperature: Column, watts: Column) -> Column:
    """struct(state, rate, delay_ms): critical from 80 degrees, thermal_throttle from 72, else
    power_throttle from 150 W, else normal."""
    state = F.when(temperature >= 80, "critical").when(temperature >= 72, "thermal_throttle").when(watts >= 150, "power_throttle").otherwise("normal")
    rate = F.when(temperature >= 80, 0.0).when((temperature >= 72) | (watts >= 150), 0.5).otherwise(1.0)
    return F.struct(state.alias("state"), rate.alias("rate"), ((1 - rate) * 50).cast("int").alias("delay_ms"))


def scratchpad(log: DataFrame, size: int) -> DataFrame:
    """(device, seq, offset, used): a scratchpad that only counts, over a log (device, seq, op, bytes). alloc
    takes what is asked at the end of what is used, if it fits; free lowers the use by its bytes, never
    below 0. offset is null where nothing fits and for frees."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        for r in rows.sort_values("seq").itertuples():
            place = None
            if r.op == "alloc" and used + r.bytes <= size:
                place, used = used, used + r.bytes
            elif r.op == "free":
                used -= min(r.bytes, used)
            out.append((r.device, r.seq, place, used))
        return pd.DataFrame(out, columns=["device", "seq", "offset", "used"]).astype({"offset": "Int64"})

    return log.groupBy("device").applyInPandas(replay, "device long, seq long, offset long, used long")


def resident_use(log: DataFrame) -> DataFrame:
    """(device, blocks, used): blocks that are resident at the end of a log (device, seq, op, block, bytes)
    of adds and removes, and the bytes they take: each block's last add or remove decides."""
    moves = log.where("op IN ('add', 'remove')").groupBy("device", "block").agg(F.max_by(F.struct("op", "bytes"), "seq").alias("last"))
    live = moves.where("last.op = 'add'")
    return live.groupBy("device").agg(F.count(F.lit(1)).alias("blocks"), F.sum("last.bytes").alias("used"))


def prefetch_schedule(layers: DataFrame, ahead: int = 2, behind: int = 2) -> DataFrame:
    """(model, step, action, layer): before each layer the next `ahead` are prefetched, after it the
    one `behind` steps back is evicted. layers is (model, n)."""
    steps = layers.select("model", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"))
    near = steps.select("model", "n", "step", F.lit("prefetch").alias("action"), F.explode(F.sequence(F.col("step") + 1, F.col("step") + ahead)).alias("layer")).where("layer < n")
    far = steps.where(F.col("step") >= behind).select("model", "n", "step", F.lit("evict").alias("action"), (F.col("step") - behind).alias("layer"))
    return near.unionByName(far).select("model", "step", "action", "layer")


def attempts_outcome(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """(target, outcome, attempt): the first of at most `limit` attempts (target, attempt, errors)
    without errors, else 'exhausted' with the last attempt made."""
    tried = attempts.where(F.col("attempt") <= limit)
    best = tried.groupBy("target").agg(F.min(F.when(F.col("errors") == 0, F.col("attempt"))).alias("first"), F.max("attempt").alias("last"))
    return best.select("target", F.when(F.col("first").isNotNull(), "verified").otherwise("exhausted").alias("outcome"), F.coalesce("first", "last").alias("attempt"))
