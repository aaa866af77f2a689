"""Queries on processing only new or changed records (problem 7)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import incremental as inc
from corpusloom.registry import Registry
from corpusloom.session import shared_dir, table, work_path

REGISTRY = Registry()

STATES = """
WITH ok AS (SELECT DISTINCT catalog_id, run_id, up_to_seq FROM sync_runs WHERE status = 'ok'),
runs AS (SELECT *, lag(up_to_seq) OVER (PARTITION BY catalog_id ORDER BY run_id) AS prev_seq FROM ok),
obs AS (SELECT DISTINCT arrival_seq, catalog_id, node_id, content_hash, observed_at FROM dag_nodes WHERE content_hash IS NOT NULL),
now AS (SELECT r.run_id, o.node_id, arg_max(o.content_hash, o.observed_at) AS h FROM runs r JOIN obs o ON o.catalog_id = r.catalog_id AND o.arrival_seq <= r.up_to_seq GROUP BY ALL),
prev AS (SELECT r.run_id, o.node_id, arg_max(o.content_hash, o.observed_at) AS h FROM runs r JOIN obs o ON o.catalog_id = r.catalog_id AND o.arrival_seq <= r.prev_seq GROUP BY ALL)
"""


def stored_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the changes of a source are kept."""
    return f"{shared_dir(spark).rstrip('/')}/run-changes-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


@REGISTRY.query(
    "p7_found",
    STATES + "SELECT n.run_id, n.node_id FROM now n LEFT JOIN prev p USING (run_id, node_id) WHERE p.h IS NULL OR p.h <> n.h",
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept in the shared folder under the name of its source: a further call computes only the
    partitions whose observations have changed since."""
    return inc.refreshed_run_changes(table(spark, sf_dir, "dag_nodes"), table(spark, sf_dir, "sync_runs"), stored_path(spark, sf_dir))


@REGISTRY.query(
    "p7_run_volume",
    STATES
    + "SELECT n.run_id, count(*) AS changed, count(*) FILTER (p.h IS NULL) AS added FROM now n LEFT JOIN prev p USING (run_id, node_id) WHERE p.h IS NULL OR p.h <> n.h GROUP BY n.run_id",
)
def p7_run_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each run has to do: changed nodes, and those never seen before."""
    nodes, runs = table(spark, sf_dir, "dag_nodes"), table(spark, sf_dir, "sync_runs")
    return inc.run_changes(nodes, runs).groupBy("run_id").agg(F.count(F.lit(1)).alias("changed"), F.sum("new").alias("added"))


@REGISTRY.query("p7_refresh_twice")
def p7_refresh_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the node state as an incremental table from the first half of the arrivals, refresh
    it with all of them, and once more without a change: partitions recomputed each time."""
    nodes = table(spark, sf_dir, "dag_nodes")
    store = inc.IncrementalTable(spark, work_path(spark, "node-state"), ["catalog_id", "node_id"], 16)

    def state(rows: DataFrame) -> DataFrame:
        return inc.latest_by(rows.where("content_hash IS NOT NULL"), ["catalog_id", "node_id"], ["observed_at", "arrival_seq", "content_hash"])

    half = nodes.agg(F.expr("percentile_approx(arrival_seq, 0.5)")).first()[0] or 0
    steps = [("half", nodes.where(F.col("arrival_seq") <= half)), ("all", nodes), ("again", nodes)]
    done = [(name, len(store.refresh(df, state)), store.read(nodes.schema).count()) for name, df in steps]
    return spark.createDataFrame(done, "step string, recomputed int, rows long")
