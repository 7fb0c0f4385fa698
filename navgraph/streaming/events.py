"""Structured Streaming over game events: counts by type, and each game's state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.session import shared_dir
from navgraph.sources import views as V

#: How late a repeated event may come and still be known as one.
LATENESS = "1 hour"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Events from a growing folder (or glob) of Parquet files; event_id, ts, game_id, type, data, value."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return V.as_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def once(stream: DataFrame) -> DataFrame:
    """Without events that are sent again within the lateness, as after a replay.

    For live streams: events that come later than the lateness behind the
    latest time of the batches before are lost.
    """
    return stream.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def distinct_events(rows: DataFrame) -> DataFrame:
    """type of each event of a whole table: one row an event_id, its earliest, however far apart its repeats; all rows without an id."""
    known = rows.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.min(F.struct("ts", "type")).alias("first"))
    return known.select("first.type").unionByName(rows.filter("event_id IS NULL").select("type"))


def of_type(stream: DataFrame, *types: str) -> DataFrame:
    """The events of some topics; each topic's query runs, fails and recovers by itself."""
    return stream.filter(F.col("type").isin(*types) & F.col("game_id").isNotNull() & (F.length("type") > 0))


def count_by_type(stream: DataFrame) -> DataFrame:
    return stream.groupBy("type").agg(F.count("*").alias("n"))


def fold_games(stream: DataFrame) -> DataFrame:
    """Each game's state after each micro-batch that has events of it: moves, solver results, whether it ended, its last event by time.

    Built-in aggregates keep the state, one row a game; rows after the end still count. What is to go when
    nobody touches it is kept by ``state.lifetimes``.
    """
    kind = F.col("type")
    return stream.groupBy("game_id").agg(
        F.count_if(kind == "move_completed").alias("moves"), F.count_if(kind == "shortest_paths_found").alias("solved"),
        F.bool_or(kind == "game_ended").alias("ended"), F.max_by("event_id", "ts").alias("last_event"),
    )


def drain(result: DataFrame, mode: str, keys: list[str], write: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return its result table: the last row of each key."""
    out = run_through(result, mode, write)
    others = [c for c in result.columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def run_through(result: DataFrame, mode: str, write: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return all rows that it gave, with their batch as ``_batch``.

    Batches are written under their number in the shared folder, so one that is
    run again replaces itself.
    """
    spark = result.sparkSession
    base = f"{shared_dir(spark)}/navgraph/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).foreachBatch(write or put).start()
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in result.schema)}, _batch int").parquet(f"{base}/out/*")
