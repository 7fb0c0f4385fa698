"""Operator 11: hard negatives, by vantage-point trees over norm-augmented vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navgraph.llm.common import materialize
from navgraph.llm.vantage import Tree, grow, nearest_first

#: Rows of a block, that one task searches at a time, about, and anchors that are searched for there together.
BLOCK_ROWS, ANCHOR_ROWS = 4096, 8192
#: Rows of a leaf within a block.
LEAF_ROWS = 256
#: The upper tree is grown over a sample of so many components at most, and has so many leaves at most.
SAMPLE_CELLS, MAX_LEAVES = 1 << 20, 1024
#: Squared norms from here on have inner products that a double doesn't hold exactly.
MAX_NORM = 1 << 53

FOUND = "anchor long, win int, row long, vec_id long, score long"


def prepared(rows: DataFrame, scale: int = 256) -> DataFrame:
    """row (a number of its own), vec_id, label, v (integers) and norm of the rows that take part, in the shared folder.

    Rows take no part with a null label, vector or component, with one that
    isn't finite, or with a squared norm of ``MAX_NORM`` or more after scaling,
    whose scores no double holds.
    """
    small = math.sqrt(MAX_NORM) / scale
    fit = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < small), F.lit(False))), F.lit(False))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    out = rows.filter(fit).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    return materialize(out.withColumn("norm", norm).filter(F.col("norm") < MAX_NORM), "negatives-rows")


def matrix(v: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of ``dim`` components; shorter ones end in zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = np.diff(v.offsets.to_numpy())
    values = v.flatten().to_numpy()
    if (size == dim).all():
        return values.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(v), dim))
    out[np.repeat(np.arange(len(v)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def upper_tree(rows: DataFrame, count: int, dim: int, most: float) -> Tree:
    """A tree over a sample of at most ``SAMPLE_CELLS`` components, the first rows by a hash; all rows are dealt by it, so it decides where a row is, not whether."""
    leaves = min(MAX_LEAVES, 1 << max(0, math.ceil(math.log2(max(1, count / BLOCK_ROWS)))))
    if leaves == 1:
        return grow(np.zeros((1, dim)), most, 1, closed=False)
    n = max(2 * leaves, SAMPLE_CELLS // max(1, dim))
    sample = rows.select(F.xxhash64("v", "row").alias("h"), "v").orderBy("h").limit(n).select("v").toArrow()
    x = matrix(sample["v"], dim)
    return grow(x, most, max(1, -(-len(x) // leaves)), closed=False)


class Index:
    """All rows in blocks by the leaves of the upper tree; a leaf with more rows than a block has, as of many copies of one vector, is several."""

    def __init__(self, rows: DataFrame) -> None:
        n, dim, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
        self.count, self.dim, self.most = int(n), max(1, int(dim or 0)), float(most or 0)
        self.tree = tree = upper_tree(rows, self.count, self.dim, self.most)
        dims = self.dim

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = tree.leaf_of(matrix(b["v"], dims))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in ("row", "vec_id", "label", "v")), pa.array(leaf, pa.int64())], ["row", "vec_id", "label", "v", "leaf"])

        self.rows = materialize(rows.select("row", "vec_id", "label", "v").mapInArrow(dealt, "row long, vec_id long, label long, v array<int>, leaf long"), "negatives-blocks")
        chunks = F.ceil(F.count("*") / BLOCK_ROWS).cast("int")
        self.chunks = materialize(self.rows.groupBy("leaf").agg(chunks.alias("chunks")), "negatives-leaves")

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, win, row, vec_id, score): of each block the ``k`` best rows of each window of each query, so all that can be among the best of all blocks.

        ``asked`` has anchor (a row's number), v, label and arrays low and high:
        windows of scores; and optionally leaf (only there), or but (not there).
        ``same`` looks for other rows of the anchor's label, else for those of
        other labels. A query goes to the blocks of the leaves that its windows'
        annuli meet, in groups of about ``ANCHOR_ROWS`` queries a block.
        """
        tree, dim, most = self.tree, self.dim, self.most
        ways = max(1, -(-asked.count() // ANCHOR_ROWS))
        only = [c for c in ("leaf", "but") if c in asked.columns]

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                top, bottom = tree.score_bounds(matrix(b["v"], dim))
                low, high = (np.array([f(x) for x in b[c].to_pylist()]) for c, f in (("low", min), ("high", max)))
                meet = (top >= low[:, None]) & (bottom <= high[:, None])
                for c in only:
                    here = np.arange(meet.shape[1]) == b[c].to_numpy()[:, None]
                    meet &= here if c == "leaf" else ~here
                i, leaf = np.nonzero(meet)
                for at in range(0, len(i), 4096):
                    part = pa.array(i[at : at + 4096])
                    yield pa.RecordBatch.from_arrays([*(b[c].take(part) for c in ("anchor", "v", "label", "low", "high")), pa.array(leaf[at : at + 4096], pa.int64())], ["anchor", "v", "label", "low", "high", "leaf"])

        def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], ["anchor", "win", "row", "vec_id", "score"])
            x, q = matrix(left["v"], dim), matrix(right["v"], dim)
            row, label = left["row"].to_numpy(), left["label"].to_numpy()
            ids = left["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            order = np.empty(len(ids), np.int64)
            order[np.lexsort((row, ids))] = np.arange(len(ids))
            own, anchor = right["label"].to_numpy(), right["anchor"].to_numpy()
            low, high = (np.array(right[c].to_pylist(), np.float64) for c in ("low", "high"))

            def fits(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
                equal = own[who, None] == label[rows]
                return equal & (anchor[who, None] != row[rows]) if same else ~equal

            local = grow(x, most, LEAF_ROWS)
            who, win, hit, score = nearest_first(local, x, order, fits, q, low, high, k)
            hits = left.select(["row", "vec_id"]).take(pa.array(hit))
            return pa.table([pa.array(anchor[who]), pa.array(win.astype(np.int32)), hits["row"], hits["vec_id"], pa.array(score.astype(np.int64))], ["anchor", "win", "row", "vec_id", "score"])

        kinds = "anchor long, v array<int>, label long, low array<double>, high array<double>"
        sent = asked.select("anchor", "v", "label", "low", "high", *only).mapInArrow(visits, f"{kinds}, leaf long")
        way = F.pmod(F.xxhash64("anchor"), F.lit(ways))
        # One row a leaf, at most MAX_LEAVES.
        chunks = F.broadcast(self.chunks)
        sent = sent.join(chunks, "leaf").select("anchor", "v", "label", "low", "high", "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), way.alias("way"))
        rows = self.rows.join(chunks, "leaf").select("row", "vec_id", "label", "v", "leaf", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int").alias("chunk"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).alias("way"))
        key = ["leaf", "chunk", "way"]
        return rows.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(best, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each anchor's window, with ``rank`` from 1."""
    order = Window.partitionBy("anchor", "win").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor and each of its positives, rows of other labels that score a bit less than the positive.

    ``rows`` has vec_id, label and embedding; ``is_anchor`` is an expression on
    vec_id. Components count as floor(scale * x), and a row's score with an
    anchor is their integer inner product; higher ones come first, ties by
    smaller vec_id (null last). An anchor's positives are its first
    ``positives`` other rows of its label; negatives of a pair are the first
    ``negatives`` rows of other labels with a score from ``least`` to ``most``
    percent of the positive's. The result has anchor_id, positive_id, rank (from
    1), negative_id, positive_score, negative_score. What takes no part is told
    at ``prepared``. Rows with one vec_id are rows of their own, as anchors too;
    vectors of unlike lengths are taken to end in zeros. No rows: no result.

    Vectors get one component more, which makes them all equally long; scores
    are then distances turned round, a window of scores is an annulus about the
    anchor, and vantage-point trees bound the distances of their leaves. The
    upper tree deals rows to blocks and leaves out those that an annulus does
    not meet; a tree within each block is searched from the inside of the
    annulus outwards. Nothing is approximate: bounds hold for all rows.
    Positives are looked for in an anchor's own leaf first; the worst that is
    found there bounds the search in the others.
    """
    index = Index(prepared(rows, scale))
    anchors = index.rows.filter(is_anchor).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "v", "label", "leaf")
    low, high = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    near = materialize(index.search(anchors.withColumns({"low": low, "high": high}), positives, True), "negatives-near")
    if len(index.tree.members) > 1:
        worst = first(near, positives).groupBy("anchor").agg(F.when(F.count("*") == positives, F.min("score").cast("double")).alias("worst"))
        far = anchors.join(worst, "anchor", "left").withColumns({"low": F.array(F.coalesce("worst", F.lit(float("-inf")))), "high": high}).withColumnRenamed("leaf", "but")
        near = near.unionByName(materialize(index.search(far, positives, True), "negatives-far"))
    pairs = first(near, positives).join(anchors.select("anchor", "anchor_id"), "anchor")
    pairs = materialize(pairs.select("anchor", "anchor_id", (F.col("rank") - 1).alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-pairs")

    percent = lambda p: F.expr(f"(positive_score * {p} - pmod(positive_score * {p}, 100)) div 100")  # noqa: E731  (rounded down)
    up = F.expr(f"-((-positive_score * {least} - pmod(-positive_score * {least}, 100)) div 100)")
    bounds = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("win", up.cast("double").alias("low"), percent(most).cast("double").alias("high")))).alias("w"))
    windows = anchors.drop("leaf", "anchor_id").join(bounds.select("anchor", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "anchor")
    found = first(index.search(windows, negatives, False), negatives)
    found = found.select("anchor", "win", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["anchor", "win"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10"""
