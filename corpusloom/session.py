"""Session, table and work-folder helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def build_session(app: str = "corpusloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "loom-warehouse"))
        .getOrCreate()
    )
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, whatever folder they start in. Once a session."""
    if getattr(ship, "_sent", None) != spark.sparkContext.applicationId:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="loom-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "corpusloom"), "zip", os.path.dirname(here), os.path.basename(here)))
        ship._sent = spark.sparkContext.applicationId
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, with the reader's own pushdown and pruning."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only where
    that is unset (tests, single machine) a temporary folder is made and set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = getattr(shared_dir, "_own", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="loom-shared-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
        shared_dir._own = known
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


_paths: list[tuple[SparkSession, str]] = []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a work path through Hadoop's file system, so that it works for any scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.
    Unlike a local checkpoint this survives the loss of executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """The rows with their place in the order, from 0, in column `name`. See running."""
    return running(df, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def running(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """The rows with the sum of `value` over all rows up to theirs in the order, in column `name`: sums
    within range partitions plus the partitions' offsets, so no task holds more than a partition.
    The ranged rows are cut from their lineage first, with their partition's number, so that sums
    and offsets speak of the same partitions."""
    ranged = df.withColumn("__v", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    kept = cut(ranged, "ranged")
    inner = F.sum("__v").over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    totals = kept.groupBy("__p").agg(F.sum("__v").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("__p", before.alias("__before"))  # a row a partition
    joined = kept.withColumn(name, inner).join(F.broadcast(offsets), "__p")
    return joined.withColumn(name, F.col("__before") + F.col(name)).drop("__p", "__v", "__before")


@atexit.register
def _clean() -> None:
    for spark, path in _paths:
        try:
            remove_path(spark, path)
        except Exception:  # the JVM may be gone already; its folder is then removed with the job's
            return
