"""Breadth-first search over an edge table for many queries at once, and all shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from navgraph.session import broadcast_up_to, materialize, numbered

#: Frontiers of up to so many rows are sent to the edges; larger ones are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000


def _next(frontier: DataFrame, edges: DataFrame, here: str, there: str) -> DataFrame:
    """query_id, node: the distinct neighbours of a frontier."""
    steps = edges.select(F.col(here).alias("node"), F.col(there).alias("next"))
    return broadcast_up_to(frontier.select("query_id", "node"), MAX_BROADCAST_ROWS).join(steps, "node").select("query_id", F.col("next").alias("node")).distinct()


def levels(edges: DataFrame, starts: DataFrame, backward: bool = False, max_levels: int | None = None) -> DataFrame:
    """query_id, node, level: the least number of edges from (``backward``: to) each query's start.

    One join of the frontier with the edges and one anti-join with what is
    reached, for all queries together; each level is written, so lineage and
    memory don't grow with depth.
    """
    here, there = ("dst_id", "src_id") if backward else ("src_id", "dst_id")
    reached = materialize(starts.select("query_id", "node", F.lit(0).alias("level")).distinct(), "level")
    frontier, level = reached, 0
    while max_levels is None or level < max_levels:
        level += 1
        new = _next(frontier, edges, here, there).join(reached.select("query_id", "node"), ["query_id", "node"], "left_anti")
        frontier = materialize(new.withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


#: Queries of a word: a search holds a bit for each of them.
BITS = 64
#: Words up to which the driver tells a search which of its queries still look for something; else a join does.
TOLD_WORDS = 64


def bit_levels(edges: DataFrame, starts: DataFrame, wanted: DataFrame | None = None, backward: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """query_id, node, level as ``levels`` finds them, by one search for all queries, whose frontier is bits.

    Queries are numbered, and 64 of them share a word. A row of the search is a
    node and a word, with the queries that have reached the node and those that
    did so last, so a level is one join of such rows with the edges and one
    aggregate that ORs bits, however many queries pass through a node.

    ``wanted`` (query_id, node) asks for these nodes only. A query leaves the
    search as soon as all of its wanted nodes are reached, and no row is made
    for another node in the result; nodes that can't be reached are left out, as
    they are where all are asked for. Wanted nodes that no edge leaves (or
    enters, forward) are known to be out of reach without a search; ``ends`` has
    the others (node), if it is known beforehand.
    """
    known, numbers, count = numbered_queries(starts.select("query_id"))
    bits = lambda df: df.select("query_id", "node").join(known, "query_id").groupBy("node", "word").agg(F.bit_or("bit").alias("bits"))
    rows = bit_rows(edges, bits(starts), None if wanted is None else bits(wanted), -(-count // BITS), backward, ends)
    each = rows.select("node", "level", "word", F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), b -> getbit(bits, b) = 1)")).alias("b"))
    back = broadcast_up_to(numbers.select("query_id", F.col("number").cast("long").alias("number")), MAX_BROADCAST_ROWS)
    return each.select("node", "level", (F.col("word") * BITS + F.col("b") + 1).alias("number")).join(back, "number").select("query_id", "node", "level")


def numbered_queries(ids: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of a column of queries: query_id, word, bit (to be joined with); query_id, number; and how many there are."""
    queries = materialize(ids.toDF("query_id").distinct(), "search-queries")
    count = queries.count()
    if count <= MAX_BROADCAST_ROWS:
        numbers = queries.select("query_id", F.row_number().over(Window.orderBy("query_id")).alias("number"))
    else:
        numbers = materialize(numbered(queries, ["query_id"], "number"), "search-numbers")
    bit = F.expr(f"shiftleft(1L, CAST((number - 1) % {BITS} AS INT))")
    known = broadcast_up_to(numbers.select("query_id", F.expr(f"CAST((number - 1) div {BITS} AS BIGINT)").alias("word"), bit.alias("bit")), MAX_BROADCAST_ROWS)
    return known, numbers, count


def bit_rows(edges: DataFrame, starts: DataFrame, wanted: DataFrame | None, words: int, backward: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """node, word, bits, level: the search of ``bit_levels`` from and for rows of node, word and bits, which are one a node and word."""
    here, there = ("dst_id", "src_id") if backward else ("src_id", "dst_id")
    none = F.lit(0).cast("long")
    state = starts.select("node", "word", F.col("bits").alias("seen"), F.col("bits").alias("fresh"), none.alias("want"))
    if wanted is not None:
        out_of = ends.select("node") if ends is not None else edges.select(F.col(there).alias("node")).distinct()
        asked = wanted.join(out_of.unionByName(starts.select("node")), "node", "left_semi")
        state = state.unionByName(asked.select("node", "word", none.alias("seen"), none.alias("fresh"), F.col("bits").alias("want")))
        state = state.groupBy("node", "word").agg(*[F.bit_or(c).alias(c) for c in ("seen", "fresh", "want")])
    steps, level, found = edges.select(F.col(here).alias("node"), F.col(there).alias("next")), 0, []
    told = [f"w{k}" for k in range(words)] if wanted is not None and words <= TOLD_WORDS else []
    kept = "fresh" if wanted is None else "fresh & want"
    while True:
        news = Observation()
        counts = [F.count_if(F.expr("fresh <> 0")).alias("fresh"), F.count_if(F.expr("want & ~seen <> 0")).alias("missing")]
        counts += [F.bit_or(F.expr(f"CASE WHEN word = {k} THEN want & ~seen END")).alias(c) for k, c in enumerate(told)]
        state = materialize(state.observe(news, *counts), "search")
        found.append(state.filter(F.expr(f"{kept} <> 0")).select("node", "word", F.expr(kept).alias("bits"), F.lit(level).alias("level")))
        if not news.get["fresh"] or (wanted is not None and not news.get["missing"]):
            break
        front = state.filter("fresh <> 0").select("node", "word", "fresh")
        if told:
            live = F.element_at(F.array(*[F.lit(news.get[c] or 0).cast("long") for c in told]), (F.col("word") + 1).cast("int"))
            front = front.select("node", "word", F.col("fresh").bitwiseAND(live).alias("fresh")).filter("fresh <> 0")
        elif wanted is not None:
            live = state.filter("want & ~seen <> 0").groupBy("word").agg(F.bit_or(F.expr("want & ~seen")).alias("live"))
            front = front.join(live, "word").select("node", "word", F.expr("fresh & live").alias("fresh")).filter("fresh <> 0")
        came = front.join(steps, "node").select(F.col("next").alias("node"), "word", F.col("fresh").alias("came"), none.alias("seen"), none.alias("want"))
        both = came.unionByName(state.select("node", "word", none.alias("came"), "seen", "want")).groupBy("node", "word").agg(*[F.bit_or(c).alias(c) for c in ("came", "seen", "want")])
        level += 1
        state = both.select("node", "word", F.expr("seen | came").alias("seen"), F.expr("came & ~seen").alias("fresh"), "want")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def meet(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bidirectional search for ``pairs`` (query_id, src_id, dst_id): forward levels, backward levels, and query_id, a, b.

    Each query expands its smaller frontier, the backward one on ties, until the
    two meet or one is empty. As levels are whole before they are tested, every
    shortest path has a edges up to the forward level a and b after it.
    """
    fwd = materialize(pairs.select("query_id", F.col("src_id").alias("node"), F.lit(0).alias("level")), "forward")
    bwd = materialize(pairs.select("query_id", F.col("dst_id").alias("node"), F.lit(0).alias("level")), "backward")
    state = materialize(pairs.select("query_id", F.lit(0).alias("a"), F.lit(0).alias("b")), "state")
    done = None
    front, back = fwd, bwd
    while True:
        touching = front.select("query_id", "node").join(back.select("query_id", "node"), ["query_id", "node"], "left_semi").select("query_id").distinct()
        met = materialize(state.join(touching, "query_id", "left_semi"), "met")
        done = met if done is None else done.unionByName(met)
        size = lambda f, n: f.groupBy("query_id").agg(F.count("*").alias(n))
        live = state.join(met, "query_id", "left_anti").join(size(front, "nf"), "query_id").join(size(back, "nb"), "query_id")
        live = materialize(live.withColumn("backward", F.col("nb") <= F.col("nf")), "live")
        if live.isEmpty():
            return fwd, bwd, done
        turn = lambda f, flag: f.join(live.filter(F.col("backward") == flag).select("query_id"), "query_id", "left_semi")
        depth = lambda c: live.select("query_id", (F.col(c) + 1).alias("level"))
        new_f = _next(turn(front, False), edges, "src_id", "dst_id").join(fwd.select("query_id", "node"), ["query_id", "node"], "left_anti").join(depth("a"), "query_id")
        new_b = _next(turn(back, True), edges, "dst_id", "src_id").join(bwd.select("query_id", "node"), ["query_id", "node"], "left_anti").join(depth("b"), "query_id")
        new_f, new_b = materialize(new_f, "forward"), materialize(new_b, "backward")
        fwd, bwd = fwd.unionByName(new_f), bwd.unionByName(new_b)
        front, back = new_f.unionByName(turn(front, True)), new_b.unionByName(turn(back, False))
        state = live.select("query_id", (F.col("a") + (~F.col("backward")).cast("int")).alias("a"), (F.col("b") + F.col("backward").cast("int")).alias("b"))


def path_lengths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, length; queries without a path have no row."""
    return meet(edges, pairs)[2].select("query_id", (F.col("a") + F.col("b")).alias("length"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_paths: int | None = None) -> DataFrame:
    """query_id, length, path (array of nodes): all shortest paths of each query; the same node: one path of it alone.

    Paths are walked from the nodes in the middle, only along edges between
    neighbouring levels. ``max_paths`` keeps so many paths of each query, after
    each step: as every part of a path goes on to both ends, none is missed that
    is needed to reach that number.
    """

    def kept(paths: DataFrame) -> DataFrame:
        if max_paths is None:
            return paths
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("path"))
        return paths.withColumn("_n", nth).filter(F.col("_n") <= max_paths).drop("_n")

    fwd, bwd, done = meet(edges, pairs)
    middle = done.join(fwd.withColumnRenamed("level", "fl"), "query_id").filter("fl = a").join(bwd.withColumnRenamed("level", "bl"), ["query_id", "node"]).filter("bl = b")
    paths = materialize(kept(middle.select("query_id", "a", "b", F.array("node").alias("path"))), "paths")
    for reach, side, here, there in ((fwd, "a", "dst_id", "src_id"), (bwd, "b", "src_id", "dst_id")):
        steps = edges.select(F.col(here).alias("node"), F.col(there).alias("next"))
        while True:
            open_ = paths.filter(F.col(side) > 0)
            if open_.isEmpty():
                break
            end = F.element_at("path", 1 if side == "a" else -1)
            longer = F.concat(F.array("next"), "path") if side == "a" else F.concat("path", F.array("next"))
            known = reach.select("query_id", F.col("node").alias("next"), "level")
            grown = broadcast_up_to(open_.withColumn("node", end), MAX_BROADCAST_ROWS).join(steps, "node").withColumn("level", F.col(side) - 1).join(known, ["query_id", "next", "level"])
            grown = grown.select("query_id", *[(F.col(c) - 1).alias(c) if c == side else F.col(c) for c in ("a", "b")], longer.alias("path"))
            paths = materialize(kept(paths.filter(F.col(side) <= 0).unionByName(grown)), "paths")
    return paths.select("query_id", (F.size("path") - 1).alias("length"), "path").distinct()


def single_paths(edges: DataFrame, pairs: DataFrame, max_expansions: int = 10) -> DataFrame:
    """query_id, length, path: one shortest path of each of ``pairs`` (query_id, src_id, dst_id), for queries that meet within ``max_expansions`` levels of both sides together.

    Every node that is reached keeps one parent, the least of those that reach
    it, so the search is a tree from each end. Each round expands the smaller
    frontier of a query, the forward one on ties. The path goes through the
    least node of those where the trees meet, and is read off by walking
    parents, one step of all queries a round; nothing is enumerated.
    """
    grown = lambda f, here, there: broadcast_up_to(f.select("query_id", "node"), MAX_BROADCAST_ROWS).join(edges.select(F.col(here).alias("node"), F.col(there).alias("next")), "node").groupBy("query_id", F.col("next").alias("node")).agg(F.min("node").alias("parent"))
    root = lambda c: pairs.select("query_id", F.col(c).alias("node"), F.lit(None).cast("long").alias("parent"))
    trees = {"src_id": materialize(root("src_id"), "tree"), "dst_id": materialize(root("dst_id"), "tree")}
    fronts, open_, met, expansions = dict(trees), pairs.select("query_id"), None, 0
    while True:
        # The last level of one side may touch any level of the other, as only one of them grew.
        both = materialize(open_.join(trees["src_id"].select("query_id", "node"), "query_id").join(trees["dst_id"].select("query_id", "node"), ["query_id", "node"]).groupBy("query_id").agg(F.min("node").alias("node")), "meeting")
        met = both if met is None else met.unionByName(both)
        size = {c: f.groupBy("query_id").agg(F.count("*").alias(c)) for c, f in fronts.items()}
        open_ = materialize(open_.join(both, "query_id", "left_anti").join(size["src_id"], "query_id").join(size["dst_id"], "query_id").select("query_id", (F.col("src_id") <= F.col("dst_id")).alias("forward")), "open")
        if expansions == max_expansions or open_.isEmpty():
            break
        expansions += 1
        for side, other, flag in (("src_id", "dst_id", True), ("dst_id", "src_id", False)):
            turn = open_.filter(F.col("forward") == flag).select("query_id")
            here = fronts[side].join(turn, "query_id", "left_semi")
            new = materialize(grown(here, side, other).join(trees[side].select("query_id", "node"), ["query_id", "node"], "left_anti"), "tree")
            trees[side] = trees[side].unionByName(new)
            fronts[side] = fronts[side].join(turn, "query_id", "left_anti").unionByName(new)
        open_ = open_.select("query_id")
    paths = materialize(met.select("query_id", F.array("node").alias("path"), F.col("node").alias("end")), "path")
    for side in ("src_id", "dst_id"):
        while True:
            up = paths.join(trees[side].select("query_id", F.col("node").alias("end"), "parent"), ["query_id", "end"])
            longer = F.concat(F.array("parent"), "path") if side == "src_id" else F.concat("path", F.array("parent"))
            stepped = up.select("query_id", F.when(F.col("parent").isNull(), F.col("path")).otherwise(longer).alias("path"), F.coalesce("parent", "end").alias("end"), F.col("parent").isNotNull().alias("moved"))
            stepped = materialize(stepped, "path")
            paths = stepped.drop("moved")
            if stepped.filter("moved").isEmpty():
                break
        paths = paths.select("query_id", "path", F.element_at("path", -1).alias("end"))
    return paths.select("query_id", (F.size("path") - 1).alias("length"), "path")


def connected(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The given rows (query_id, path) with ``connected``: whether every two neighbours on the path are an edge.

    Few steps are sent to the edges, which then needn't be dealt.
    """
    keyed = paths.withColumn("_key", F.xxhash64("query_id", "path"))
    steps = keyed.select("_key", F.explode(F.expr("transform(sequence(1, greatest(size(path) - 1, 1)), i -> struct(get(path, i - 1) AS src_id, get(path, i) AS dst_id))")).alias("s")).select("_key", "s.*").filter("dst_id IS NOT NULL")
    there = edges.select("src_id", "dst_id").join(broadcast_up_to(steps.select("src_id", "dst_id").distinct(), MAX_BROADCAST_ROWS), ["src_id", "dst_id"]).distinct()
    broken = steps.join(there, ["src_id", "dst_id"], "left_anti").select("_key").distinct()
    return keyed.join(broken.withColumn("_broken", F.lit(True)), "_key", "left").withColumn("connected", F.col("_broken").isNull()).drop("_key", "_broken")


def titled(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """Paths as titles; a path through a page without title is dropped."""
    key = F.xxhash64("query_id", "path")
    long = paths.withColumn("_key", key).select("_key", "query_id", "length", "path", F.posexplode("path").alias("at", "page_id"))
    named = long.join(pages.select("page_id", "title"), "page_id").groupBy("_key", "query_id", "length", "path").agg(F.sort_array(F.collect_list(F.struct("at", "title"))).alias("t"))
    return named.filter(F.size("t") == F.size("path")).select("query_id", "length", F.col("t.title").alias("titles"))


def solve(edges: DataFrame, pages: DataFrame, tasks: DataFrame, resolve) -> DataFrame:
    """query_id, status (ok, start_not_found, target_not_found, no_path), length, titles, for ``tasks`` (query_id, start, target).

    ``resolve`` maps a DataFrame of (query_id, title) to (query_id, page_id).
    """
    ids = lambda c, out: resolve(tasks.select("query_id", F.col(c).alias("title"))).select("query_id", F.col("page_id").alias(out))
    known = tasks.select("query_id").join(ids("start", "src_id"), "query_id", "left").join(ids("target", "dst_id"), "query_id", "left")
    known = materialize(known, "tasks")
    found = titled(shortest_paths(edges, known.filter("src_id IS NOT NULL AND dst_id IS NOT NULL")), pages)
    status = F.when(F.col("src_id").isNull(), "start_not_found").when(F.col("dst_id").isNull(), "target_not_found").when(F.col("length").isNull(), "no_path").otherwise("ok")
    return known.join(found, "query_id", "left").select("query_id", status.alias("status"), "length", "titles")
