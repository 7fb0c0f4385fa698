"""Games: turns and their outcomes, results, retention and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navgraph.functions.titles import task_id

# Errors after which a turn may be tried again, and how often.
RETRY_ERRORS = ("model_no_tool_call", "model_invalid_tool", "model_invalid_link", "app_navigation_error")
MAX_ATTEMPTS = 2
#: Statuses of finished games.
FINISHED = ("won", "lost_max_steps", "lost_invalid_move", "error")


def numbered_moves(moves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Moves with step from 1 in each game."""
    return moves.withColumn("step", F.row_number().over(Window.partitionBy("game_id").orderBy(*order)))


def outcomes(attempts: DataFrame, configs: DataFrame) -> DataFrame:
    """game_id, steps, status of games replayed from attempts.

    ``attempts`` has game_id, turn, attempt, to_page_title and error (null: the
    page was reached); ``configs`` target_page_title and max_steps. Turns count
    until the one that ends the game: an attempt with an error that allows no
    other try ends it as ``error``; so many failed ones as there may be as
    ``lost_invalid_move``; reaching the target as ``won``, which is tested before
    the number of steps (``lost_max_steps``). Without an end: ``in_progress``,
    and without an attempt ``not_started``. Ends are found by one window a game.
    """
    fatal = F.col("error").isNotNull() & ~F.col("error").isin(*RETRY_ERRORS)
    turns = attempts.groupBy("game_id", "turn").agg(
        F.max(F.when(fatal, 1).otherwise(0)).alias("fatal"),
        F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("failed"),
        F.max(F.when(F.col("error").isNull(), F.col("to_page_title"))).alias("reached"),
    )
    upto = Window.partitionBy("game_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = turns.join(configs.select("game_id", "target_page_title", "max_steps"), "game_id")
    known = known.withColumn("steps", F.count("reached").over(upto))
    end = (
        F.when(F.col("fatal") == 1, "error")
        .when(F.col("reached").isNull() & (F.col("failed") >= MAX_ATTEMPTS), "lost_invalid_move")
        .when(F.col("reached") == F.col("target_page_title"), "won")
        .when(F.col("reached").isNotNull() & (F.col("steps") >= F.col("max_steps")), "lost_max_steps")
    )
    ended = known.withColumn("end", end)
    first = ended.groupBy("game_id").agg(F.min(F.when(F.col("end").isNotNull(), F.struct("turn", "end", "steps"))).alias("e"), F.max("steps").alias("made"))
    started = configs.select("game_id").join(first, "game_id", "left")
    status = F.when(F.col("made").isNull(), "not_started").otherwise(F.coalesce("e.end", F.lit("in_progress")))
    return started.select("game_id", F.coalesce("e.steps", "made", F.lit(0)).cast("long").alias("steps"), status.alias("status"))


def metrics(messages: DataFrame) -> DataFrame:
    """game_id and sums over its assistant messages that have metrics; nulls count as 0, and no calls give an average of 0."""
    calls = messages.filter((F.col("role") == "assistant") & (F.coalesce("input_tokens", "output_tokens", "cost", "response_ms").isNotNull()))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.groupBy("game_id").agg(
        n("input_tokens").alias("total_input_tokens"),
        n("output_tokens").alias("total_output_tokens"),
        (n("input_tokens") + n("output_tokens")).alias("total_tokens"),
        n("cost").alias("total_cost"),
        n("response_ms").alias("total_time_ms"),
        (n("response_ms") / F.count("*")).alias("average_time_ms"),
        F.count("*").alias("calls"),
    )


def storable(status: Column, move_errors: Column, store_finished: bool = True, store_failed: bool = True, excluded: Sequence[str] = ()) -> Column:
    """Whether a game is kept: won and lost by steps by one flag, failed ones by the other unless a move has an excluded error."""
    clear = ~F.coalesce(F.arrays_overlap(move_errors, F.array(*[F.lit(e) for e in excluded]).cast("array<string>")), F.lit(False))
    return F.when(status.isin("won", "lost_max_steps"), F.lit(store_finished)).when(status.isin("error", "lost_invalid_move"), F.lit(store_failed) & clear).otherwise(F.lit(False))


def latest(games: DataFrame, order: str) -> DataFrame:
    """Of rows with one game_id the last by ``order``."""
    rank = F.row_number().over(Window.partitionBy("game_id").orderBy(F.col(order).desc()))
    return games.withColumn("_n", rank).filter("_n = 1").drop("_n")


def with_task(games: DataFrame) -> DataFrame:
    return games.withColumn("task_id", task_id(F.col("start_page_title"), F.col("target_page_title")))


def run_summary(games: DataFrame, *by: str) -> DataFrame:
    """total, successes, success_rate; average, least and most steps of the successes; by groups or in one row."""
    won = F.when(F.col("status") == "won", F.col("steps"))
    return games.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count(won).alias("successes"),
        (F.count(won) / F.count("*")).alias("success_rate"),
        F.avg(won).alias("avg_length"),
        F.min(won).alias("min_length"),
        F.max(won).alias("max_length"),
    )


def task_completion(games: DataFrame) -> DataFrame:
    """task_id, games, finished, complete: whether all games of a task are over."""
    over = F.col("status").isin(*FINISHED)
    return with_task(games).groupBy("task_id").agg(F.count("*").alias("games"), F.count_if(over).alias("finished"), F.bool_and(over).alias("complete"))


def connection_rollup(links: DataFrame) -> DataFrame:
    """task_id, connections, connected, failed, status, for rows (task_id, state: connected, connecting, error or disconnected)."""
    of = lambda s: F.count_if(F.col("state") == s)
    counts = links.groupBy("task_id").agg(F.count("state").alias("connections"), of("connected").alias("connected"), of("error").alias("failed"), of("connecting").alias("connecting"))
    status = (
        F.when(F.col("connections") == 0, "disconnected")
        .when(F.col("connected") == F.col("connections"), "connected")
        .when(F.col("connecting") > 0, "connecting")
        .when(F.col("connected") > 0, "partial")
        .when(F.col("failed") > 0, "error")
        .otherwise("disconnected")
    )
    return counts.select("task_id", "connections", "connected", "failed", status.alias("status"))
