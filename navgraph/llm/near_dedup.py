"""Operator 2: near-duplicate documents by bottom-k sketches of one hash function."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navgraph.llm.common import broadcast_up_to, documents, materialize
from navgraph.llm.components import components
from navgraph.llm.hashing import as_bytes, lists, shingle_sets, slices

#: Values that a sketch retains, and the most that the probabilities may be with which a pair right at the
#: threshold shares fewer of them than inverted lists ask for, and than the estimate asks for.
K, LIST_ERROR, ESTIMATE_ERROR = 64, 1e-10, 1e-6
#: Inverted lists up to this length give all their pairs; longer ones are worked off by pivots.
SMALL_LIST = 16
#: Pivots of a list in its first round and at most; so few are found without sorting whole lists.
PIVOTS, MAX_PIVOTS = 4, 1000
MAX_BROADCAST_ROWS = 300_000


def sure_hits(percent: int, error: float) -> int:
    """How many of the union's K smallest values two sets of Jaccard ``percent`` share, but with a probability of ``error`` at most.

    Each is in both sets with probability ``percent`` / 100, so their number is
    binomial. Of 80 %, 28 for LIST_ERROR and 34 for ESTIMATE_ERROR (3.2e-7).
    """
    p, below = percent / 100, 0.0
    for hits in range(K + 1):
        below += math.comb(K, hits) * p**hits * (1 - p) ** (K - hits)
        if below > error:
            return max(1, hits)
    return K


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, and sketch: its K smallest hashes."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, sketch = [], [], []
            for s in shingle_sets(as_bytes(batch["text"]), width):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketch.append(s[:K])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists(sketch, pa.int64())], ["doc_id", "n_shingles", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(signed, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and the whole set of shingle hashes, for the documents in ``nodes``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["node"], lists(list(shingle_sets(as_bytes(batch["text"]), width)), pa.int64())], ["node", "set"])

    some = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(broadcast_up_to(nodes, MAX_BROADCAST_ROWS), "node", "left_semi")
    return materialize(some.mapInArrow(hashed, "node long, set array<long>"), "near-sets")


def least_shared(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection with which sets of n and m shingles reach ``percent``."""
    return F.ceil((n + m) * percent / (100 + percent) - 1e-9)


def inverted(values: DataFrame, prefix: Column) -> DataFrame:
    """Postings (value, node, n, pos) that can be the first one that two linked sets share.

    ``values`` has node, n, k (values of the node) and value. Values are ordered
    by how many nodes have them, rare ones first. If two nodes must share c of
    their values, each has one of the other's among its first k - c + 1, so only
    those (``prefix``) are kept; pos counts from 1. A passage that many nodes
    share thus counts only in nodes that hold little else.
    """
    common = values.groupBy("value").agg(F.count("*").alias("held")).filter("held > 1")
    shared = values.join(common, "value")
    own = Window.partitionBy("node")
    ranked = shared.withColumn("pos", F.row_number().over(own.orderBy("held", "value")) + F.col("k") - F.count("*").over(own))
    kept = materialize(ranked.filter(F.col("pos") <= prefix).select("value", "node", "n", F.col("pos").cast("long").alias("pos")), "postings")
    lengths = kept.groupBy("value").agg(F.count("*").alias("length"), F.min("n").alias("smallest")).filter("length > 1")
    return materialize(kept.join(lengths, "value"), "inverted")


def list_pairs(postings: DataFrame, percent: int, positions: bool) -> DataFrame:
    """All pairs within the short lists whose sizes (and positions) allow a link."""
    short = postings.filter(F.col("length") <= SMALL_LIST)
    x = short.select("value", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    y = short.select("value", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    if positions:
        fits &= F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1 >= least_shared(F.col("na"), F.col("nb"), percent)
    return x.join(y, "value").filter(fits).select("a", "b").distinct()


def estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union sketch does not rule a link out; one right at ``percent`` is lost with ESTIMATE_ERROR at most."""
    x = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    y = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    both = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return pairs.join(x, "a").join(y, "b").filter(both >= F.size(union) * (sure_hits(percent, ESTIMATE_ERROR) / K)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach ``percent``: 100 * intersection >= percent * union."""
    x = sets.select(F.col("node").alias("a"), F.col("set").alias("xs"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys"))
    joined = pairs.join(x, "a").join(y, "b").withColumn("both", both)
    return joined.filter(F.col("both") * 100 >= (F.size("xs") + F.size("ys") - F.col("both")) * percent).select("a", "b").distinct()


def pivot_links(postings: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` with those that the long lists add, up to what components need.

    In each round a list compares some of its members, the pivots, with all that
    are in other components: those of its smallest components first, and of
    them the ones with the fewest rarer values before the list's. Then the
    pivots leave the list, as all their pairs in it are seen. So do members
    that can no longer reach the shared count with any size in the list, and the
    list ends when its members are all in one component. Rounds go on until no
    list is left: no pair that could add a connection is skipped. Each round
    takes four times as many pivots as the one before, so long lists of unlike
    texts end as well.
    """
    live = postings.filter(F.col("length") > SMALL_LIST).select("value", "node", "n", "pos")
    live = materialize(live.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "live")
    pivots, parts = PIVOTS, [links]
    while True:
        sizes = live.groupBy("value", "root").agg(F.count("*").alias("alike"), F.min("n").alias("smallest"))
        spans = sizes.groupBy("value").agg(F.min("smallest").alias("least"), F.count("*").alias("roots")).filter("roots > 1").select("value", "least")
        partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100 - 1e-9))
        able = F.col("n") - F.col("pos") + 1 >= least_shared(F.col("n"), partner, percent)
        ranked = live.join(spans, "value").filter(able).join(sizes.select("value", "root", "alike"), ["value", "root"])
        live = materialize(ranked.select("value", "node", "n", "pos", "root", "alike"), "live")
        if live.isEmpty():
            return materialize(reduce(DataFrame.union, parts), "all-links")
        # The filter on the number limits each task's part of a list before the shuffle: no list is gathered whole.
        first = F.row_number().over(Window.partitionBy("value").orderBy("alike", "pos", "node"))
        chosen = materialize(live.withColumn("order", first).filter(F.col("order") <= pivots).drop("order"), "pivots")
        p = chosen.select("value", F.col("node").alias("p"), F.col("n").alias("np"), F.col("pos").alias("pp"), F.col("root").alias("rp"))
        fits = (F.col("rp") != F.col("root")) & (F.least("n", "np") * 100 >= F.greatest("n", "np") * percent)
        fits &= F.least(F.col("n") - F.col("pos"), F.col("np") - F.col("pp")) + 1 >= least_shared(F.col("n"), F.col("np"), percent)
        pairs = live.join(p, "value").filter(fits).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        found = materialize(verified(pairs, sets, percent), "pivot-links")
        rest = live.drop("alike").join(chosen.select("value", "node"), ["value", "node"], "left_anti")
        if not found.isEmpty():
            parts.append(found)
            root = live.select("node", "root").distinct()
            joined = found.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            merged = broadcast_up_to(components(joined).toDF("root", "merged"), MAX_BROADCAST_ROWS)
            rest = rest.join(merged, "root", "left").withColumn("root", F.coalesce("merged", "root")).drop("merged")
        live = materialize(rest, "live")
        pivots = min(4 * pivots, MAX_PIVOTS)


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """Each document's set size and component: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of ``width``-word shingles (A-Z in lower
    case) have 100 * intersection >= ``percent`` * union. component_id is the
    smallest doc_id that can be reached, and kept says that it is the document's own.

    Documents with equal sets are one class, worked on as its smallest id. Sketches
    of classes give inverted lists; short lists give pairs, which the union
    sketch filters and whole sets confirm. The classes of long lists, of which
    few are left after the rare-first order, are listed again with their whole
    sets, where the shared count is exact, and worked off by pivots.

    Null and empty texts have empty sets and are alone. So are rows without
    doc_id, whose component is null and which are kept. Rows with one id are one
    document. ``docs`` has doc_id and text.
    """
    signed = materialize(signatures(docs, width), "signatures")
    linked = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A table of its own, so that the join's sides are plain exchanges: adaptive execution then splits the rows of a digest that very many documents have.
    classes = materialize(linked.groupBy("digest").agg(F.min("doc_id").alias("node")), "digests")
    tagged = materialize(linked.join(classes, "digest").select("doc_id", "n_shingles", "node", F.when(F.col("doc_id") == F.col("node"), F.col("sketch")).alias("sketch")), "classes")
    sketches = tagged.filter("sketch IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node", "n"])

    k = F.least(F.col("n"), F.lit(K))
    shared = F.when(F.col("n") * 100 <= K * percent, F.ceil(F.col("n") * percent / 100 - 1e-9)).otherwise(F.lit(sure_hits(percent, LIST_ERROR)))
    postings = inverted(sketches.select("node", "n", k.alias("k"), F.explode("sketch").alias("value")), F.col("k") - shared + 1)
    pairs = materialize(estimated(list_pairs(postings, percent, False), sketches, percent), "pairs")
    crowd = materialize(postings.filter(F.col("length") > SMALL_LIST).select("node").distinct(), "crowd")
    needed = materialize(crowd.union(pairs.select("a")).union(pairs.select("b")).distinct(), "needed")
    sets = full_sets(docs, needed, width)
    links = materialize(verified(pairs, sets, percent), "links")

    size = F.size("set").cast("long")
    whole = sets.join(crowd, "node", "left_semi").select("node", size.alias("n"), size.alias("k"), F.explode("set").alias("value"))
    dense = inverted(whole, F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1)
    more = verified(list_pairs(dense, percent, True), sets, percent)
    links = pivot_links(dense, sets, materialize(links.union(more).distinct(), "links"), percent)

    roots = components(links)
    member = tagged.select("doc_id", "n_shingles", "node").join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id, all columns as they are.

    Rows without doc_id stay. Rows that repeat an id and its text are one row
    afterwards; rows with one id and unlike texts are one document and stay or
    go together.
    """
    found = materialize(near_duplicates(docs.select("doc_id", "text"), width, percent).select("doc_id", "kept"), "near-duplicates")
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    twice = materialize(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    rest = docs.join(broadcast_up_to(gone, MAX_BROADCAST_ROWS), "doc_id", "left_anti")
    few = broadcast_up_to(twice, MAX_BROADCAST_ROWS)
    again = rest.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(few, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
