"""Operator 10: shards of equal bytes as the leaves of a k-d tree."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navgraph.llm.common import documents, materialize, text_of

#: Bins a histogram has for each node; so many rows a node at most reach the driver.
BINS = 1024
#: Rows of a (shard, bucket) that are numbered together, about.
SLOT_ROWS = 50_000
DIMENSIONS = ("d_size", "d_lang", "d_source", "d_id")
#: ``u`` breaks ties along a dimension: 62 bits, the upper half a hash of what a row holds, the lower of where it stands.
U_BITS = 62


@dataclass
class Node:
    """A split sends rows left with key < lo, or key < hi and u < cut."""

    leaves: int
    first: int
    dim: str = ""
    lo: int = 0
    hi: int = 0
    cut: int = 0
    kids: list[Node] = field(default_factory=list)


def placed_rows(docs: DataFrame) -> tuple[DataFrame, Column]:
    """The rows as files hold them, and a hash of a row's file and place there: the one thing in which repeated rows differ. Rows that are in no file are written first."""
    try:
        own = docs.metadataColumn("_metadata")
        docs.select(own["row_index"])
    except AnalysisException:
        docs = materialize(docs, "shard-rows")
        own = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(own["file_path"], own["row_index"])


def dimensions(row: Column | None = None) -> dict[str, Column]:
    """Integer metadata dimensions; text values count by their CRC, nulls as empty or 0."""
    half = U_BITS // 2
    part = lambda h: F.shiftrightunsigned(h, 64 - half)
    code = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary"))
    size = (F.octet_length(text_of()) + F.lit(8)).cast("long")
    crc = F.crc32(text_of().cast("binary"))
    return {
        "size": size,
        "text_crc32": crc,
        "d_size": F.floor(F.log2(size.cast("double")) * F.lit(float(1 << 32))).cast("long"),
        "d_lang": code("lang"),
        "d_source": code("source"),
        "d_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")),
        "u": F.shiftleft(part(F.xxhash64(F.lit(10), F.col("doc_id"), crc, F.col("source"), F.col("lang"))), half).bitwiseOR(part(F.lit(0).cast("long") if row is None else row)),
    }


def side(node: Node) -> Column:
    """Whether a row goes left."""
    key = F.col(node.dim)
    return (key < node.lo) | ((key < node.hi) & (F.col("u") < node.cut))


def leaf(node: Node) -> Column:
    """The number of the open node or leaf a row falls in: nested conditions, no join."""
    return F.when(side(node), leaf(node.kids[0])).otherwise(leaf(node.kids[1])) if node.kids else F.lit(node.first)


def _narrow(rows: DataFrame, at: dict[int, dict], key: str) -> None:
    """One histogram pass: in each node, find the bin in which the running bytes pass the wanted share.

    ``at`` maps a node's number to its state: interval [lo, hi) of ``key``, bytes
    ``before`` it and bytes ``want``. All nodes are served by one aggregate of at
    most BINS rows each.
    """
    lo, width, inside = F.lit(None).cast("long"), F.lit(1).cast("long"), F.lit(False)
    for n, s in at.items():
        here = F.col("node") == n
        value = F.col(s["dim"]) if key == "dim" else F.col("u")
        within = (value >= s["lo"]) & (value < s["hi"])
        if key == "u":
            within &= (F.col(s["dim"]) >= s["dim_lo"]) & (F.col(s["dim"]) < s["dim_hi"])
        s["width"] = max(1, -(-(s["hi"] - s["lo"]) // BINS))
        lo, width, inside = F.when(here, value - F.lit(s["lo"]).cast("long")).otherwise(lo), F.when(here, F.lit(s["width"]).cast("long")).otherwise(width), F.when(here, within).otherwise(inside)
    found = rows.filter(inside).withColumn("off", lo).withColumn("width", width).groupBy("node", F.expr("off div width").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    for n, s in at.items():
        start, chosen = s["lo"], None
        for b in sorted((r for r in found if r["node"] == n), key=lambda r: r["bin"]):
            chosen = b
            if s["before"] + b["bytes"] >= s["want"]:
                break
            s["before"] += b["bytes"]
        if chosen is not None:
            full = s["before"] + chosen["bytes"] < s["want"]
            s["before"] -= chosen["bytes"] if full else 0
            s["lo"] = start + chosen["bin"] * s["width"]
            s["hi"] = min(s["hi"], s["lo"] + s["width"])
            s["rows"], s["bytes"] = chosen["n"], chosen["bytes"]


def fit_tree(rows: DataFrame, leaves: int) -> Node:
    """A tree whose leaves hold near equal bytes.

    A node of k leaves is cut at the weighted quantile k//2 : k - k//2 along the
    dimension that is widest in it (as a part of the whole table's width). The
    quantile is found by histograms over all rows, each within a bin of the one
    before; rows that share the last bin along the dimension are cut by ``u``.
    All nodes of a level are split in the same passes.
    """
    root, open_nodes = Node(leaves, 0), []
    open_nodes = [root] if leaves > 1 else []
    spread: dict[str, float] = {}
    while open_nodes:
        placed = rows.withColumn("node", leaf(root))
        extents = [f(c).alias(f"{k}_{c}") for c in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max))]
        seen = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *extents).collect()}
        if not seen:
            return root
        wide = lambda r, c: r[f"hi_{c}"] - r[f"lo_{c}"]
        spread = spread or {c: max(1, max(wide(r, c) for r in seen.values())) for c in DIMENSIONS}
        at: dict[int, dict] = {}
        for node in open_nodes:
            left = node.leaves // 2
            if (r := seen.get(node.first)) is None:  # an empty node: any cut does
                node.dim, at[node.first] = DIMENSIONS[0], {}
            else:
                node.dim = max(DIMENSIONS, key=lambda c: wide(r, c) / spread[c])
                at[node.first] = {"dim": node.dim, "lo": r[f"lo_{node.dim}"], "hi": r[f"hi_{node.dim}"] + 1, "before": 0, "want": r["bytes"] * left / node.leaves, "rows": 2}
        live = {n: s for n, s in at.items() if s}
        for _ in range(4):
            if todo := {n: s for n, s in live.items() if s["hi"] - s["lo"] > 1 and s["rows"] > 1}:
                _narrow(placed, todo, "dim")
        for s in live.values():
            s |= {"dim_lo": s["lo"], "dim_hi": s["hi"], "lo": 0, "hi": 1 << U_BITS, "rows": 2}
        for k in range(math.ceil(U_BITS / math.log2(BINS))):
            if todo := {n: s for n, s in live.items() if s["rows"] > 1 or not k}:
                _narrow(placed, todo, "u")
        following = []
        for node in open_nodes:
            left = node.leaves // 2
            if s := at[node.first]:
                node.lo, node.hi = s["dim_lo"], s["dim_hi"]
                node.cut = s["hi"] if s["want"] - s["before"] > s["bytes"] / 2 else s["lo"]
            node.kids = [Node(left, node.first), Node(node.leaves - left, node.first + left)]
            following += [k for k in node.kids if k.leaves > 1]
        open_nodes = following
    return root


def shard(docs: DataFrame, keep: Sequence[str], shards: int = 24) -> DataFrame:
    """Each document's shard, size and slot, by the law ``bytes``: sizes near equal.

    ``docs`` has doc_id, text, lang and source. The result has ``doc`` (a struct
    of the columns in ``keep``), size (UTF-8 bytes plus 8; null text: 8),
    text_crc32, shard (0 to ``shards`` - 1) and slot (0, 1, .. in each shard).

    The tree is fitted on one slim table of integers in the shared folder and
    applied as an expression, so texts are not shuffled to be placed. A tie
    along every dimension is cut by a hash of the row, and rows equal in id,
    text, source and language by a hash of where they stand in their file; one
    document is never split, so shards differ by about one document a level. No
    rows: no result rows.

    Slots follow hash buckets of about ``SLOT_ROWS`` rows, then the order inside.
    """
    docs, row = placed_rows(docs)
    columns = dimensions(row)
    slim = materialize(docs.select(*[c.alias(k) for k, c in columns.items()]), "shard-keys")
    root = fit_tree(slim, shards)
    buckets = max(16, math.ceil(slim.count() / (SLOT_ROWS * shards)))
    bucket = F.pmod(F.col("u"), F.lit(buckets)).alias("bucket")
    counts = slim.select(leaf(root).alias("shard"), bucket).groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "shard-slots")

    placed = docs.select(F.struct(*keep).alias("doc"), *[c.alias(k) for k, c in columns.items()])
    placed = placed.select("doc", "size", "text_crc32", "u", leaf(root).alias("shard"), bucket)
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("u"))
    numbered = placed.withColumn("inside", inside).join(F.broadcast(offsets) if shards * buckets <= 1_000_000 else offsets, ["shard", "bucket"])
    return numbered.select("doc", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("inside") - 1).alias("slot"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    placed = shard(docs, keep=["doc_id"])
    return placed.select("doc.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
