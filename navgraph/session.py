"""Spark sessions and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Seconds after which the driver's garbage is collected again.
COLLECT_EVERY_S = 3
_collected = 0.0


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("navgraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (a single machine, as in tests) a temporary
    folder is made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, label: str, always: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; lineage ends there.

    A lost executor then costs a re-read, not a recomputation, and steps that
    read the table more than once see the same rows. The write's shuffle files
    are of no more use; Spark deletes them when the driver collects its garbage,
    which is asked for here, as jobs of many steps would else hold them all, but
    not again within a few seconds, in which small steps leave little (unless
    ``always``). Rows are kept apart ``by`` columns, so that some are read without the others.
    """
    global _collected
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/navgraph/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    if always or time.monotonic() - _collected > COLLECT_EVERY_S:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more: what was made of them is written itself."""
    for table in tables:
        jvm, sc = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended, before the next large one: plans go only after their events, so it takes two collections."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` sorted by ``order``, with gapless numbers from 1 and without one task that sorts it all."""
    kept = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.withColumn("_in", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` (a shuffled join).

    Meant for materialized tables, where the count is read from file footers.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
