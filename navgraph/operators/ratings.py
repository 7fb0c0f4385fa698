"""Ratings of models from games on the same tasks: pairwise wins, Bradley-Terry strengths, Elo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navgraph.operators.games import with_task
from navgraph.session import materialize

#: Models up to which their strengths are broadcast to the pairs.
MAX_BROADCAST_MODELS = 1_000_000


def per_task(games: DataFrame) -> DataFrame:
    """task_id, model_id, steps, n: games by task, alike ones counted. Pairs are made of these, not of the games."""
    return with_task(games).groupBy("task_id", "model_id", "steps").agg(F.count("*").alias("n"))


def comparisons(counted: DataFrame) -> DataFrame:
    """task_id, model_a < model_b, a_wins, b_wins, ties: how often games of two models on a task compare so.

    Fewer steps win, whatever the status. Each model's steps on a task are a
    short histogram; a pair of games is a product of two of its counts.
    """
    x = counted.select("task_id", F.col("model_id").alias("model_a"), F.col("steps").alias("sa"), F.col("n").alias("na"))
    y = counted.select("task_id", F.col("model_id").alias("model_b"), F.col("steps").alias("sb"), F.col("n").alias("nb"))
    pairs = x.join(y, "task_id").filter("model_a < model_b")
    games = F.col("na") * F.col("nb")
    part = lambda when: F.sum(F.when(when, games).otherwise(0))
    return pairs.groupBy("task_id", "model_a", "model_b").agg(part(F.col("sa") < F.col("sb")).alias("a_wins"), part(F.col("sa") > F.col("sb")).alias("b_wins"), part(F.col("sa") == F.col("sb")).alias("ties"))


def win_matrix(compared: DataFrame) -> DataFrame:
    """model, opponent, wins: a win counts 1 and a tie 0.5 for both; pairs of models that met have both rows."""
    total = compared.groupBy("model_a", "model_b").agg(F.sum("a_wins").alias("a"), F.sum("b_wins").alias("b"), F.sum("ties").alias("t"))
    row = lambda m, o, w: F.struct(F.col(m).alias("model"), F.col(o).alias("opponent"), (F.col(w) + F.col("t") * 0.5).alias("wins"))
    return total.select(F.explode(F.array(row("model_a", "model_b", "a"), row("model_b", "model_a", "b"))).alias("r")).select("r.*")


def strengths(matrix: DataFrame, iterations: int = 20) -> DataFrame:
    """model, strength: the Bradley-Terry fixed point from 1.0, each round from the last one's values, scaled to a mean of 1.

    The table has one row for each pair of models, however many games there
    were. A model with nothing to divide by keeps its strength if it won
    nothing, else gets 1.
    """
    back = matrix.select(F.col("model").alias("opponent"), F.col("opponent").alias("model"), F.col("wins").alias("lost"))
    pairs = materialize(matrix.join(back, ["model", "opponent"]).withColumn("met", F.col("wins") + F.col("lost")), "pairs")
    current = materialize(pairs.select("model").distinct().withColumn("p", F.lit(1.0)), "strengths")
    # Strengths have a row for each model, in every round as many as in the first.
    sent = F.broadcast if current.count() <= MAX_BROADCAST_MODELS else lambda df: df
    for step in range(iterations):
        both = pairs.join(sent(current), "model").join(sent(current.select(F.col("model").alias("opponent"), F.col("p").alias("q"))), "opponent")
        sums = both.groupBy("model").agg(F.sum("wins").alias("w"), F.sum(F.when(F.col("p") + F.col("q") > 0, F.col("met") / (F.col("p") + F.col("q"))).otherwise(0.0)).alias("d"), F.first("p").alias("p"))
        p = F.when(F.col("d") > 0, F.col("w") / F.col("d")).when(F.col("w") == 0, F.col("p")).otherwise(1.0)
        raw = sums.select("model", p.alias("raw"))
        mean = F.avg("raw").over(Window.partitionBy(F.lit(0)))
        current = raw.select("model", F.when(mean > 0, F.col("raw") / mean).otherwise(F.col("raw")).alias("p"))
        if step % 2 == 1 or step == iterations - 1:
            current = materialize(current, "strengths")
    return current.withColumnRenamed("p", "strength")


def elo(strength: DataFrame, base: int = 1200) -> DataFrame:
    """model, rating: base + 400 * log10(strength), rounded half to even; no strength counts as 1e-9."""
    value = F.log10(F.when(F.col("strength") > 0, F.col("strength")).otherwise(F.lit(1e-9)))
    return strength.select("model", F.bround(base + 400 * value, 0).cast("long").alias("rating"))


def leaderboard(games: DataFrame, iterations: int = 20, base: int = 1200) -> DataFrame:
    """model, rating, best first; only models that met another on some task."""
    found = strengths(win_matrix(comparisons(per_task(games))), iterations)
    return elo(found, base).orderBy(F.col("rating").desc(), "model")
