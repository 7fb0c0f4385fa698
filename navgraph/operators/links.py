"""From dump tables to a clean graph: redirects, link resolution, pruning and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.session import materialize


def redirect_ids(redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """source_id, target_id: redirect targets by title alone; sources must exist.

    Of several pages with the title, and of several redirects of a source, the
    last one counts. Which is last tells the column ``_order``, where it is
    there (``sources.dumps.in_order``); else the greatest id is.
    """
    last = lambda df, key, value: df.groupBy(key).agg((F.max_by(value, "_order") if "_order" in df.columns else F.max(value)).alias("target_id"))
    by_title = last(pages, "title", "page_id")
    known = redirects.join(pages.select(F.col("page_id").alias("source_id")).distinct(), "source_id", "left_semi")
    found = known.join(by_title, known["target_title"] == by_title["title"]).select("source_id", F.col("target_id").alias("found"), *[c for c in ("_order",) if c in redirects.columns])
    return last(found, "source_id", "found")


def resolve_redirects(direct: DataFrame, max_hops: int = 100) -> DataFrame:
    """source_id, target_id after following chains; cycles and chains of more than ``max_hops`` further hops are dropped.

    Pointer doubling: each round joins the table with itself, so chains of any
    length up to the limit take a logarithmic number of joins.
    """
    jumps = materialize(direct.select("source_id", F.col("target_id").alias("to"), F.lit(0).cast("long").alias("hops")), "redirects")
    reach = 1
    while reach <= max_hops:
        further = jumps.select(F.col("source_id").alias("to"), F.col("to").alias("then"), (F.col("hops") + 1).alias("more"))
        stepped = jumps.join(further, "to", "left").select("source_id", F.coalesce("then", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("then").isNotNull().alias("moved"))
        stepped = materialize(stepped, "redirects")
        jumps, reach = stepped.drop("moved"), 2 * reach
        if stepped.filter("moved").isEmpty():
            break
    ended = jumps.join(direct.select(F.col("source_id").alias("to")), "to", "left_anti")
    return ended.filter(F.col("hops") <= max_hops).select("source_id", F.col("to").alias("target_id"))


def pruned_pages(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pages without the redirects that lead nowhere."""
    known = resolved.select(F.col("source_id").alias("page_id"), F.lit(True).alias("_known"))
    return pages.join(known, "page_id", "left").filter(~F.col("is_redirect") | F.col("_known")).drop("_known")


def link_targets(linktargets: DataFrame, pages: DataFrame) -> DataFrame:
    """lt_id, page_id: targets by namespace and title."""
    return linktargets.join(pages.select("page_id", "namespace", "title"), ["namespace", "title"]).select("lt_id", "page_id")


def edges_by_id(links: DataFrame, linktargets: DataFrame, pages: DataFrame) -> DataFrame:
    """src_id, dst_id of all links whose target is a page; repeats stay. The large table meets one small map."""
    found = links.join(link_targets(linktargets, pages), links["pl_target_id"] == F.col("lt_id"))
    return found.select(F.col("pl_from").alias("src_id"), F.col("page_id").alias("dst_id"))


def skip_reasons(links: DataFrame, linktargets: DataFrame, pages: DataFrame) -> DataFrame:
    """reason, n: how many links lead to an edge (ok), are no whole line (malformed), come from no page, have no link target, or no page (red).

    A link is malformed where pl_from or pl_target_id is null, as lines of too
    few or unfit fields are read. All are counted in one pass over the links.
    """
    lt = linktargets.select("lt_id", F.col("namespace").alias("ns"), F.col("title").alias("t"))
    there = lt.join(pages.select(F.col("namespace").alias("ns"), F.col("title").alias("t"), F.lit(True).alias("page")).distinct(), ["ns", "t"], "left").select("lt_id", "page")
    source = pages.select(F.col("page_id").alias("pl_from"), F.lit(True).alias("source"))
    all_links = links.join(source, "pl_from", "left").join(there, F.col("pl_target_id") == F.col("lt_id"), "left")
    fit = F.col("pl_from").isNotNull() & F.col("pl_target_id").isNotNull()
    reason = F.when(~fit, "malformed").when(F.col("source").isNull(), "missing_source").when(F.col("lt_id").isNull(), "unknown_target").when(F.col("page").isNull(), "red_link").otherwise("ok")
    return all_links.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def resolved_edges(links: DataFrame, linktargets: DataFrame, pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """The graph: distinct src_id, dst_id after redirects, both ends pages, no self-links."""
    return linked(links, linktargets, pages, resolved).distinct()


def linked(links: DataFrame, linktargets: DataFrame, pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """The graph's edges as ``resolved_edges`` has them, with repeats.

    Redirects are applied to the maps of targets and sources, which have one row
    for each page, so the links themselves are joined twice and no more.
    """
    final = pages.select("page_id").join(resolved.withColumnRenamed("source_id", "page_id"), "page_id", "left").select("page_id", F.coalesce("target_id", "page_id").alias("final"))
    ends = link_targets(linktargets, pages).join(final, "page_id").select("lt_id", F.col("final").alias("dst_id"))
    starts = final.select(F.col("page_id").alias("pl_from"), F.col("final").alias("src_id"))
    found = links.join(ends, links["pl_target_id"] == F.col("lt_id")).join(starts, "pl_from")
    return found.filter("src_id <> dst_id").select("src_id", "dst_id")


def grouped(edges: DataFrame, by: str, other: str) -> DataFrame:
    """page_id and the sorted ids on the other end."""
    return edges.groupBy(F.col(by).alias("page_id")).agg(F.sort_array(F.collect_list(other)).alias("ids"))


def adjacency(edges: DataFrame) -> DataFrame:
    """page_id, outgoing, incoming and their counts, for pages with any link."""
    out, into = grouped(edges, "src_id", "dst_id").withColumnRenamed("ids", "outgoing"), grouped(edges, "dst_id", "src_id").withColumnRenamed("ids", "incoming")
    none = F.expr("CAST(array() AS array<bigint>)")
    both = out.join(into, "page_id", "full_outer").select("page_id", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"))
    return both.withColumns({"outgoing_count": F.size("outgoing"), "incoming_count": F.size("incoming")})


def degrees(edges: DataFrame) -> DataFrame:
    """page_id, outgoing_count, incoming_count in one aggregate over both ends of each edge, without lists."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_id").alias("page_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_id").alias("page_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.page_id").agg(F.sum("e.o").alias("outgoing_count"), F.sum("e.i").alias("incoming_count"))
