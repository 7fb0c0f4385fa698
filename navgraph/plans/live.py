"""Queries over events and games as streams, each run until all that is there is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from navgraph.operators.games import with_task
from navgraph.operators.sessions import SUBSCRIPTIONS
from navgraph.plans.graph import rows
from navgraph.plans.play import _ATTEMPTS, TASK, VIEWS, attempts
from navgraph.plans.registry import query
from navgraph.session import shared_dir
from navgraph.sources import views as V
from navgraph.streaming import events as E
from navgraph.streaming import state as S
from navgraph.streaming.topics import Topics


def _stream(spark, sf_dir):
    return E.event_stream(spark, f"{sf_dir}/events.parque[t]")


@query(VIEWS + " SELECT type, count(*) AS n FROM v_events GROUP BY type")
def event_counts(spark, sf_dir):
    return E.count_by_type(E.distinct_events(V.events(spark, sf_dir)))


@query(VIEWS + """ SELECT game_id, count(*) FILTER (type = 'move_completed') AS moves, count(*) FILTER (type = 'shortest_paths_found') AS solved,
  bool_or(type = 'game_ended') AS ended, arg_max(event_id, ts) AS last_event FROM v_events GROUP BY game_id""")
def game_states(spark, sf_dir):
    return E.drain(E.fold_games(_stream(spark, sf_dir)), "update", ["game_id"])


_TOPICS = "subscribed AS (SELECT * FROM (VALUES " + ", ".join(map(str, SUBSCRIPTIONS)) + ") AS s(topic, handler))"


@query(VIEWS + f", {_TOPICS} SELECT topic, handler, (SELECT count(*) FROM v_events WHERE type = topic AND game_id IS NOT NULL) AS delivered FROM subscribed")
def subscriptions(spark, sf_dir):
    """How many events each subscription's stream gets, of one source."""
    topics = Topics(spark, lambda: _stream(spark, sf_dir))
    out = f"{topics.base}/delivered"

    def write_to(topic, handler):
        def write(batch, number):
            batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/topic={topic}/handler={handler}/batch={number}")

        return write

    for topic, handler in SUBSCRIPTIONS:
        topics.subscribe(topic, handler, write_to(topic, handler))
    topics.start(once=True)
    topics.tend(once=True)
    if failed := [s for s in topics.all.values() if s.state != "done"]:
        raise RuntimeError("; ".join(f"{s.topic}/{s.handler}: {s.errors[-1]}" for s in failed))
    known = rows(spark, list(SUBSCRIPTIONS), "topic string,handler string")
    counted = spark.read.schema("n bigint, topic string, handler string, batch int").parquet(out).groupBy("topic", "handler").agg(F.sum("n").alias("delivered"))
    return known.join(counted, ["topic", "handler"], "left").select("topic", "handler", F.coalesce("delivered", F.lit(0)).alias("delivered"))


#: How long a solver result lives that nothing touches.
LIFETIME_S = 43_200


@query(VIEWS + f""", runs AS (
  SELECT game_id, type, ts, CASE WHEN epoch_ms(ts) - epoch_ms(lag(ts) OVER w) <= {LIFETIME_S * 1000} THEN 0 ELSE 1 END AS opens FROM v_events WINDOW w AS (PARTITION BY game_id ORDER BY ts)),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY game_id ORDER BY ts) AS run FROM runs),
seen AS (SELECT *, count(*) FILTER (type = 'shortest_paths_found') OVER (PARTITION BY game_id, run ORDER BY ts) > 0 AS lives FROM grouped),
counts AS (SELECT game_id, count(*) FILTER (type = 'shortest_paths_found') AS puts, count(*) FILTER (lives AND type <> 'shortest_paths_found') AS hits, count(*) FILTER (NOT lives) AS misses FROM seen GROUP BY 1),
ends AS (SELECT game_id, run, epoch_ms(max(ts)) AS last FROM seen WHERE lives GROUP BY 1, 2)
SELECT c.*, (SELECT count(*) FROM ends e WHERE e.game_id = c.game_id AND last + {LIFETIME_S * 1000} < (SELECT epoch_ms(max(ts)) FROM v_events)) AS expired FROM counts c""")
def cache_lifetimes(spark, sf_dir):
    """Each game's solver result as a cached entry: solver results put it, all other events of the game read it."""
    S.use_rocksdb(spark)
    rows = _stream(spark, sf_dir).filter("game_id IS NOT NULL AND ts IS NOT NULL")
    out = E.run_through(S.lifetimes(rows.select(F.col("game_id").alias("key"), "ts", "event_id", (F.col("type") == "shortest_paths_found").alias("put"), F.col("data").alias("value")), LIFETIME_S), "append")
    of = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return out.groupBy(F.col("key").alias("game_id")).agg(of("put", "puts"), of("hit", "hits"), of("miss", "misses"), of("expired", "expired"))


def _played(spark, sf_dir, parts=3):
    """The games of ``attempts``, streamed in about ``parts`` batches: rows are dealt to their files by their hash, so that attempts come long before their turn, their game or each other. A batch has a file for each core."""
    tries, configs = attempts(spark, sf_dir)
    players = with_task(configs).groupBy("task_id").agg(F.count("*").alias("players"))
    made = with_task(configs).join(players, "task_id").select("game_id", "task_id", "target_page_title", F.col("max_steps").cast("long").alias("max_steps"), "players")
    rows = made.unionByName(tries.select("game_id", F.col("turn").cast("long").alias("turn"), F.col("attempt").cast("long").alias("attempt"), "to_page_title", "error"), allowMissingColumns=True)
    path = f"{shared_dir(spark)}/navgraph/attempts-{uuid.uuid4().hex}"
    files = max(1, spark.sparkContext.defaultParallelism)
    rows.repartition(parts * files, F.xxhash64("game_id", "turn", "attempt")).write.parquet(path)
    S.use_rocksdb(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    return E.run_through(S.played(stream), "append")


@query(VIEWS + _ATTEMPTS)
def streamed_outcomes(spark, sf_dir):
    """As ``game_outcomes``, by a stream of attempts."""
    found = _played(spark, sf_dir).filter("game_id IS NOT NULL")
    last = found.groupBy("game_id").agg(F.max_by(F.struct("steps", "status"), F.struct("_batch", "steps", (F.col("type") == "game_ended"))).alias("s"))
    return last.select("game_id", "s.steps", "s.status")


@query(VIEWS + _ATTEMPTS.replace("SELECT c.game_id, CASE", ", o AS (SELECT c.game_id, CASE", 1) + f""")
SELECT {TASK} AS task_id, count(*) AS games, count(*) FILTER (o.status NOT IN ('not_started', 'in_progress')) AS finished, bool_and(o.status NOT IN ('not_started', 'in_progress')) AS complete
FROM v_games g JOIN o ON o.game_id = g.game_id GROUP BY 1""")
def streamed_tasks(spark, sf_dir):
    """How many games of each task are over, and whether its task_ended was sent, by the same stream."""
    found = _played(spark, sf_dir).filter("game_id IS NULL")
    return found.groupBy("task_id").agg(F.max("games").alias("games"), F.max("finished").alias("finished"), F.bool_or(F.col("type") == "task_ended").alias("complete"))
