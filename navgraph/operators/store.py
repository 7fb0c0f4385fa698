"""Lookups over the graph tables: titles, ids, neighbours and degrees, for one key or for many at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navgraph.functions.titles import fold, readable, sanitize
from navgraph.operators.links import degrees as count_degrees
from navgraph.session import broadcast_up_to
from navgraph.sources.tables import Kept


#: Keys of a lookup up to which the files that can hold them are chosen beforehand.
FEW_KEYS = 1000
#: Pages whose degrees are asked for that are sent to the edges; more are joined by a shuffle.
MAX_ASKED = 200_000


def few_values(column: DataFrame) -> list | None:
    """The values of a column of a few rows; None if there are more. Rows that are given by value take no job."""
    found = column.limit(FEW_KEYS + 1).collect()
    return [r[0] for r in found] if len(found) <= FEW_KEYS else None


class GraphStore:
    """pages (page_id, namespace, title, is_redirect; folded, where the title is kept in lower case too), resolved redirects (source_id, target_id) and edges (src_id, dst_id).

    Edges may be given as functions, which are called when edges are first
    needed; ``incoming`` has the same edges laid out by dst_id, ``degrees`` the
    number of links of each page that has any. ``by_title`` and ``by_id`` (a
    function) are pages kept by folded title and by id: lookups of a few keys
    then read only the files that can hold them.
    """

    def __init__(
        self, pages: DataFrame, redirects: DataFrame, edges: DataFrame | Callable[[], DataFrame], incoming: DataFrame | Callable[[], DataFrame] | None = None,
        degrees: DataFrame | Callable[[], DataFrame] | None = None, by_title: Kept | None = None, by_id: Callable[[], Kept] | None = None,
    ) -> None:
        self.pages, self.redirects, self._edges, self._incoming = pages, redirects, edges, incoming if incoming is not None else edges
        self._degrees, self._by_title, self._by_id = degrees if degrees is not None else lambda: count_degrees(self.edges), by_title, by_id

    @property
    def degrees(self) -> DataFrame:
        """page_id, outgoing_count, incoming_count."""
        if callable(self._degrees):
            self._degrees = self._degrees()
        return self._degrees

    def degrees_of(self, ids: DataFrame) -> DataFrame:
        """``degrees`` of the given page_ids (distinct), counted on their edges alone: few ids are sent to the edges, and no table of all degrees is made."""
        asked = broadcast_up_to(ids.select("page_id"), MAX_ASKED)
        ends = lambda c, out, into: self.edges.select(F.col(c).alias("page_id")).join(asked, "page_id", "left_semi").select("page_id", F.lit(out).alias("o"), F.lit(into).alias("i"))
        return ends("src_id", 1, 0).unionByName(ends("dst_id", 0, 1)).groupBy("page_id").agg(F.sum("o").alias("outgoing_count"), F.sum("i").alias("incoming_count"))

    def pages_titled(self, titles: DataFrame) -> DataFrame:
        """Pages among which are all that have one of the given folded titles (the only column)."""
        few = few_values(titles) if self._by_title else None
        return self.pages if few is None else self._by_title.holding(few)

    def pages_with(self, ids: DataFrame) -> DataFrame:
        """Pages among which are all that have one of the given ids (the only column)."""
        few = few_values(ids) if self._by_id else None
        return self.pages if few is None else self._by_id().holding(few)

    @property
    def edges(self) -> DataFrame:
        if callable(self._edges):
            self._edges = self._edges()
        return self._edges

    @property
    def incoming(self) -> DataFrame:
        if callable(self._incoming):
            self._incoming = self._incoming()
        return self._incoming

    def _folded(self) -> Column:
        return F.col("folded") if "folded" in self.pages.columns else fold(F.col("title"))

    def by_title(self, title: str, namespace: int = 0) -> DataFrame:
        """The rows of a title in any case; namespace -1 is any."""
        wanted = fold(sanitize(F.lit(title)))
        near = self.pages_titled(self.pages.sparkSession.sql("SELECT * FROM VALUES (1) AS t(one)").select(wanted))
        found = near.filter(self._folded() == wanted).drop("folded")
        return found if namespace == -1 else found.filter(F.col("namespace") == namespace)

    def resolve(self, titles: DataFrame, namespace: int = 0) -> DataFrame:
        """The given rows (with ``title``) with page_id, null if there is none.

        Of the pages that match in any case: a page that is no redirect and has
        the exact title; else any that is no redirect; else the redirect target
        of the first. Ties go to the smallest id.
        """
        wanted = sanitize(F.col("title"))
        pages = self.pages_titled(titles.select(fold(wanted)))
        pages = pages if namespace == -1 else pages.filter(F.col("namespace") == namespace)
        pages = pages.select("page_id", F.col("title").alias("_title"), "is_redirect", self._folded().alias("_fold"))
        pages = pages.join(self.redirects.withColumnRenamed("source_id", "page_id"), "page_id", "left")
        rank = F.when(~F.col("is_redirect") & (F.col("_title") == F.col("_wanted")), 0).when(~F.col("is_redirect"), 1).otherwise(2)
        found = titles.select("title", wanted.alias("_wanted")).distinct().join(pages, fold(F.col("_wanted")) == F.col("_fold"))
        best = found.groupBy(F.col("title").alias("_asked")).agg(F.min(F.struct(rank.alias("rank"), "page_id", "target_id")).alias("b"))
        page_id = F.when(F.col("b.rank") < 2, F.col("b.page_id")).otherwise(F.col("b.target_id"))
        return titles.join(best.select("_asked", page_id.alias("page_id")), F.col("title") == F.col("_asked"), "left").drop("_asked")

    def titles(self, ids: DataFrame) -> DataFrame:
        """The given rows (with page_id) with the readable title, null if there is none; every repeat is filled."""
        pages = self.pages_with(ids.select("page_id"))
        return ids.join(pages.select("page_id", readable(F.col("title")).alias("title")), "page_id", "left")

    def exists(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.pages_with(ids.select("page_id")).select("page_id"), "page_id", "left_semi")

    def neighbours(self, ids: DataFrame, incoming: bool = False) -> DataFrame:
        """The given rows (with page_id) with ``links``, sorted; none: an empty array."""
        here, there = ("dst_id", "src_id") if incoming else ("src_id", "dst_id")
        near = (self.incoming if incoming else self.edges).join(ids.select(F.col("page_id").alias(here)), here, "left_semi")
        lists = near.groupBy(F.col(here).alias("page_id")).agg(F.sort_array(F.collect_list(there)).alias("links"))
        return ids.join(lists, "page_id", "left").withColumn("links", F.coalesce("links", F.expr("CAST(array() AS array<bigint>)")))

    def stats(self) -> DataFrame:
        """pages and links, in one row."""
        return self.pages.agg(F.count("*").alias("pages")).crossJoin(self.edges.agg(F.count("*").alias("links")))

    def link_sum(self, ids: DataFrame, incoming: bool = False) -> DataFrame:
        """total_links of the distinct given page_ids; none: 0."""
        here = "dst_id" if incoming else "src_id"
        near = (self.incoming if incoming else self.edges).join(ids.select(F.col("page_id").alias(here)), here, "left_semi")
        return near.agg(F.count("*").alias("total_links"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many nulls each column has."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])


def seeded_sample(pages: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows in an order that seed and page_id decide."""
    return pages.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("page_id").cast("string"))), "page_id").limit(n)


def pick_link(links: Column, seed: int, *key: Column) -> Column:
    """A uniform choice from an array that seed and key (texts) decide, the same in every engine; null from an empty one."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *key)), 1, 8), 16, 10).cast("long")
    return F.when(F.size(links) > 0, F.element_at(links, (drawn % F.greatest(F.size(links), F.lit(1)) + 1).cast("int")))
