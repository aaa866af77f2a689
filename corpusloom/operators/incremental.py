"""Processing only new or changed records.

Two layers:

* `run_changes` answers, for every successful run of a catalog, which nodes are new or have
  another content hash than at the catalog's previous successful run. Changed partitions are
  recognised by additive fingerprints (row count and the sum of row hashes in two 32-bit lanes,
  so that the sum can be kept up to date by adding and subtracting rows); node by node
  comparison happens only inside partitions whose fingerprint moved.
* `IncrementalTable` keeps a derived table in step with its source. Every refresh compares the
  source's fingerprints with those of the last committed refresh, recomputes only partitions
  that differ, replaces each of them through dynamic partition overwrite and commits the new
  fingerprints last. A crash before the commit repeats exactly those partitions, so nothing is
  skipped and nothing is delivered twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.session import cut, remove_path, work_path

LOW = (1 << 32) - 1
#: Number of the rules of run_changes; stored results of other rules are computed anew.
RULES = 2


def fingerprint_columns(*cols: Column | str) -> list[Column]:
    """Count and additive hash of the rows of a group. The 64-bit hash is summed in two 32-bit
    lanes: a plain 64-bit sum would overflow, and a lane holds 2^31 rows."""
    h = F.xxhash64(*cols)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(h.bitwiseAND(F.lit(LOW))).alias("h_low"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("h_high"),
    ]


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` of each key. Repeated rows count once; rows with a null
    key are dropped; nulls in the order columns come first, so any value beats them."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    keep = df.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    return keep.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def state_events(observations: DataFrame, blocks: int = 64) -> DataFrame:
    """Changes of each node's state, in order of arrival.

    The state at a sequence number is the hash of the row with the latest observed_at among those
    that arrived up to it. So a row changes the state exactly when its observed_at is later than
    that of every earlier arrival; of equal observed_at the earlier arrival stays. Rows with a
    null key, hash, sequence or time cannot be placed and are dropped; repeated rows count once.

    A node's arrivals are cut into blocks of the sequence, so that a node with a third of all rows
    is spread; what earlier blocks left is carried over as one row a block.

    Columns: catalog_id, node_id, seq, hash, prev_hash (null at the node's first event)."""
    rows = observations.select("catalog_id", "node_id", "arrival_seq", "observed_at", "content_hash").dropna()
    span = rows.agg(F.min("arrival_seq").alias("lo"), F.max("arrival_seq").alias("hi"))
    place = F.floor((F.col("arrival_seq") - F.col("lo")) * blocks / (F.col("hi") - F.col("lo") + 1)).cast("int")
    rows = rows.join(F.broadcast(span)).withColumn("block", place).drop("lo", "hi")
    state = F.struct("observed_at", (-F.col("arrival_seq")).alias("back"), "content_hash")
    node = ["catalog_id", "node_id"]
    left = rows.groupBy(*node, "block").agg(F.max(state).alias("state"))
    carried = left.select(*node, "block", F.max("state").over(W.partitionBy(*node).orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    order = W.partitionBy(*node, "block").orderBy("arrival_seq", F.col("observed_at").desc(), "content_hash")
    inner = F.max(state).over(order.rowsBetween(W.unboundedPreceding, -1))
    seen = rows.withColumn("inner", inner).join(carried, [*node, "block"])
    seen = seen.withColumn("before", F.greatest("inner", "carried"))
    return seen.where("before IS NULL OR observed_at > before.observed_at").select(
        *node, F.col("arrival_seq").alias("seq"), F.col("content_hash").alias("hash"), F.col("before.content_hash").alias("prev_hash")
    )


def run_spans(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boundaries, spans) of the successful runs. Boundaries are (catalog_id, up_to_seq, step): the
    distinct sequence numbers of a catalog's runs, numbered from 1; the arrivals of a step are
    those after the last boundary up to its own. Spans are (catalog_id, run_id, forward, step): the
    steps that separate a run's state from the previous successful run's, a row a step. Runs
    mostly take one step each; a retry with a smaller number goes back (forward = false). Runs
    with nulls are dropped."""
    ok = runs.where("status = 'ok'").select("catalog_id", "run_id", "up_to_seq").dropna()
    ok = ok.groupBy("catalog_id", "run_id").agg(F.max("up_to_seq").alias("up_to_seq"))
    distinct = ok.select("catalog_id", "up_to_seq").distinct()
    boundaries = distinct.withColumn("step", F.row_number().over(W.partitionBy("catalog_id").orderBy("up_to_seq")))
    placed = ok.join(boundaries, ["catalog_id", "up_to_seq"])
    prev = F.coalesce(F.lag("step").over(W.partitionBy("catalog_id").orderBy("run_id")), F.lit(0))
    moves = placed.withColumn("prev", prev).where("step <> prev")
    steps = F.sequence(F.least("prev", "step") + 1, F.greatest("prev", "step"))
    return boundaries, moves.select("catalog_id", "run_id", (F.col("step") > F.col("prev")).alias("forward"), F.explode(steps).alias("step"))


def run_changes(observations: DataFrame, runs: DataFrame, buckets: int = 16) -> DataFrame:
    """(catalog_id, run_id, node_id, new): nodes that each successful run must process; new is 1
    where the previous state did not have the node.

    Events are put into the steps between run boundaries by one sorted pass over both (a range
    join), and summed up by step before they meet the runs, so the work is linear in the events
    whatever the number of runs. A partition is a catalog's hash bucket of nodes; boundaries are
    repeated in each."""
    boundaries, spans = run_spans(runs)
    events = state_events(observations).withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(buckets)).cast("int"))
    marks = boundaries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    none = F.lit(None).cast("string")
    lined = events.select("catalog_id", "bucket", "seq", F.lit(0).alias("mark"), F.lit(None).cast("int").alias("step"), "node_id", "hash", "prev_hash").unionByName(
        marks.select("catalog_id", "bucket", F.col("up_to_seq").alias("seq"), F.lit(1).alias("mark"), "step", none.alias("node_id"), none.alias("hash"), none.alias("prev_hash"))
    )
    # Read backwards, the last boundary passed is the one that ends the event's step.
    back = W.partitionBy("catalog_id", "bucket").orderBy(F.col("seq").desc(), F.col("mark").desc()).rowsBetween(W.unboundedPreceding, 0)
    stepped = lined.withColumn("step", F.last("step", ignorenulls=True).over(back)).where("mark = 0 AND step IS NOT NULL")
    by_step = stepped.groupBy("catalog_id", "bucket", "node_id", "step").agg(
        F.max_by("hash", "seq").alias("late"), F.min_by(F.struct("prev_hash"), "seq").getField("prev_hash").alias("early")
    )
    met = by_step.join(spans, ["catalog_id", "step"])
    # State on both sides of the run's steps, one row a node and run.
    sides = met.groupBy("catalog_id", "bucket", "run_id", "node_id", "forward").agg(
        F.max_by("late", "step").alias("late"), F.min_by(F.struct("early"), "step").getField("early").alias("early")
    )
    now = F.when(F.col("forward"), F.col("late")).otherwise(F.col("early"))
    then = F.when(F.col("forward"), F.col("early")).otherwise(F.col("late"))
    sides = sides.select("catalog_id", "bucket", "run_id", "node_id", now.alias("now"), then.alias("then"))
    # How the partition's fingerprint moved: rows that came in minus rows that went out.
    part = ["catalog_id", "bucket", "run_id"]
    h_now, h_then = (F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.xxhash64("node_id", c)) for c in ("now", "then"))
    lanes = [
        F.sum(F.col("now").isNotNull().cast("long") - F.col("then").isNotNull().cast("long")).alias("d_n"),
        F.sum(h_now.bitwiseAND(F.lit(LOW)) - h_then.bitwiseAND(F.lit(LOW))).alias("d_low"),
        F.sum(F.shiftrightunsigned(h_now, 32) - F.shiftrightunsigned(h_then, 32)).alias("d_high"),
    ]
    moved = sides.groupBy(*part).agg(*lanes).where("d_n <> 0 OR d_low <> 0 OR d_high <> 0").select(*part)
    changed = sides.join(moved, part, "left_semi")
    return changed.where("now IS NOT NULL AND (then IS NULL OR now <> then)").select(
        "catalog_id", "run_id", "node_id", F.col("then").isNull().cast("long").alias("new")
    )


class IncrementalTable:
    """A derived table, kept in step with a source by partition fingerprints.

    `path` lies in the shared folder. Partitions are `partitions` hash buckets of `keys`; the
    number is a parameter, so the list of changed partitions that reaches the driver is bounded.
    Hot keys may be spread by naming further columns in `keys`.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partitions: int = 32) -> None:
        self.spark, self.path, self.keys, self.partitions = spark, path.rstrip("/"), keys, partitions

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _listed(self, pattern: str) -> list[str]:
        """Names that match a pattern under the table's path, in order."""
        fs, target = self._fs(f"{self.path}/{pattern}")
        return sorted(f.getPath().getName() for f in fs.globStatus(target) or [])

    def with_part(self, df: DataFrame) -> DataFrame:
        """The source with its partition number in `__part`; null keys have a partition too."""
        return df.withColumn("__part", F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int"))

    def fingerprints(self, source: DataFrame, salt: Column | None = None) -> DataFrame:
        """(__part, n, h_low, h_high) of the source as it is now."""
        cols = [F.col(c) for c in sorted(source.columns)] + ([salt] if salt is not None else [])
        return self.with_part(source).groupBy("__part").agg(*fingerprint_columns(*cols))

    def _manifests(self) -> list[str]:
        """Committed manifests, the newest last. A manifest counts once its _SUCCESS file, which is
        written last, is there."""
        return [m for m in self._listed("_manifest-*") if self._listed(f"{m}/_SUCCESS")]

    def committed(self) -> dict[int, tuple]:
        """Fingerprints of the last committed refresh; empty before the first."""
        known = self._manifests()
        if not known:
            return {}
        return {r[0]: tuple(r[1:]) for r in self.spark.read.parquet(f"{self.path}/{known[-1]}").select("__part", "n", "h_low", "h_high").collect()}

    def plan(self, source: DataFrame, salt: Column | None = None) -> tuple[list[int], list[int], dict[int, tuple]]:
        """Partitions to recompute, partitions to remove, and the new fingerprints. What to remove goes
        by the folders that are there, so what a crashed refresh left behind is found too."""
        new = {r[0]: tuple(r[1:]) for r in self.fingerprints(source, salt).collect()}
        old = self.committed()
        there = {int(name.split("=")[1]) for name in self._listed("data/__part=*")}
        begun = self._pending()
        return sorted(p for p, f in new.items() if old.get(p) != f or p in begun), sorted(there - set(new)), new

    def _pending(self) -> set[int]:
        """Partitions that a refresh announced and did not commit: what is stored of them may be of
        either state, so they are recomputed even if the source is as it was."""
        names = self._listed("_pending-*")
        return {r[0] for m in names if self._listed(f"{m}/_SUCCESS") for r in self.spark.read.parquet(f"{self.path}/{m}").collect()}

    def refresh(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame], salt: Column | None = None) -> list[int]:
        """Bring the table up to date and return the recomputed partitions.

        `transform` gets the rows of the changed partitions (with `__part`) and must return
        rows that depend on nothing outside a partition, `__part` included. `salt` names what
        else the result depends on; when it changes, so does every fingerprint."""
        changed, gone, new = self.plan(source, salt)
        data = f"{self.path}/data"
        if changed:
            self.spark.createDataFrame([(p,) for p in changed], "__part int").coalesce(1).write.parquet(f"{self.path}/_pending-{uuid.uuid4().hex}")
            rows = transform(self.with_part(source).where(F.col("__part").isin(changed)))
            if self._listed("data/__part=*"):
                # Dynamic overwrite leaves a partition as it was when it now has no rows, so such
                # partitions are found in the staged rows and removed.
                rows = cut(rows, "staged")
                live = {r[0] for r in rows.select("__part").distinct().collect()}
                gone = gone + [p for p in changed if p not in live]
            out = rows.repartition(min(len(changed), 200), "__part")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("__part").parquet(data)
        for p in gone:
            remove_path(self.spark, f"{data}/__part={p}")
        if changed or gone or not self._manifests():
            self._commit(new)
        return changed

    def _commit(self, new: dict[int, tuple]) -> None:
        """Write the next manifest under its own number; readers see it once it is complete, and the one
        before until then. This is the only step that moves the frontier. Older ones go afterwards."""
        rows = [(p, *f) for p, f in sorted(new.items())]
        known = self._listed("_manifest-*")
        number = 1 + max((int(m.split("-")[1]) for m in known), default=0)
        self.spark.createDataFrame(rows, "__part int, n long, h_low long, h_high long").coalesce(1).write.parquet(f"{self.path}/_manifest-{number:012d}")
        for m in known + self._listed("_pending-*"):
            remove_path(self.spark, f"{self.path}/{m}")

    def read(self, schema) -> DataFrame:
        """The table as of the last refresh, without the partition column."""
        if not self._listed("data/__part=*"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/data").drop("__part")


def refreshed_run_changes(observations: DataFrame, runs: DataFrame, path: str | None = None, partitions: int = 32) -> DataFrame:
    """`run_changes`, kept as an incremental table at `path` (a fresh one when none is given): only
    partitions whose observations changed are computed anew, or all when the runs changed."""
    spark = observations.sparkSession
    store = IncrementalTable(spark, path or work_path(spark, "run-changes"), ["catalog_id", "node_id"], partitions)
    marks = runs.agg(*fingerprint_columns(*sorted(runs.columns))).first()
    salt = F.lit("/".join(str(x) for x in (RULES, *marks)))
    source = observations.select("arrival_seq", "catalog_id", "node_id", "content_hash", "observed_at")

    def compute(rows: DataFrame) -> DataFrame:
        return store.with_part(run_changes(rows, runs)).select("run_id", "node_id", "__part")

    store.refresh(source, compute, salt)
    return store.read("run_id long, node_id string").select("run_id", "node_id")
