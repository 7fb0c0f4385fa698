"""Connected components of a graph of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.llm.common import materialize


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): the smallest node that is reachable.

    Each round takes the smallest root among a node's neighbours and then the
    root's root, so paths shorten by half or more; rounds end when nothing
    changes. Roots are joined, never collected; a node with very many links is
    a skewed join key, which adaptive execution splits.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = materialize(both.distinct(), "links")
    roots = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    for _ in range(max_rounds):
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("next"))
        above = roots.select(F.col("node").alias("next"), F.col("root").alias("above"))
        jumped = materialize(lower.join(above, "next").select("node", "old", F.least("next", "above").alias("root")), "roots")
        roots = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
