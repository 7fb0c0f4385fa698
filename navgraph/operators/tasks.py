"""Choosing tasks, and the catalogue of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navgraph.functions.titles import fold, usable

# Icon names of providers that differ from the provider's name.
ICONS = {"anthropic": "claude", "google": "gemini", "mistralai": "mistral", "meta-llama": "meta", "moonshotai": "moonshot", "amazon": "nova", "x-ai": "grok"}


#: Fixed value: articles where their number isn't known.
FALLBACK_ARTICLES = 7_000_000


def seeded(seed: int, key: Column) -> Column:
    """An order that seed and key decide, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def candidates(pages: DataFrame, n: int, seed: int) -> DataFrame:
    """pos, page_id, title: ``n`` pages of the main namespace that are no redirects, in seeded order."""
    fit = pages.filter((F.col("namespace") == 0) & ~F.col("is_redirect")).select("page_id", "title", seeded(seed, F.col("page_id")).alias("pos"))
    return fit.orderBy("pos", "page_id").limit(n)


def random_task(pages: DataFrame, degrees: DataFrame, seed: int, n: int = 20, min_out: int = 1, min_in: int = 1) -> DataFrame:
    """start_page_title, target_page_title of one task, or no row.

    The first usable candidate with links out is the start, the first other one
    with links in the target. ``degrees`` has page_id, outgoing_count, incoming_count.
    """
    fit = candidates(pages, n, seed).filter(usable(F.col("title"))).join(degrees, "page_id", "left")
    order = F.struct("pos", "page_id")
    start = fit.filter(F.coalesce("outgoing_count", F.lit(0)) >= min_out).agg(F.min_by("title", order).alias("start_page_title"))
    other = fit.filter(F.coalesce("incoming_count", F.lit(0)) >= min_in).join(F.broadcast(start), F.col("title") != F.col("start_page_title"))
    return other.groupBy("start_page_title").agg(F.min_by("title", order).alias("target_page_title"))


def custom_task(pages: DataFrame, degrees: DataFrame, seed: int, start: str | None = None, target: str | None = None, n: int = 20) -> DataFrame:
    """start_page_title, target_page_title of one task, or no row: a given page must exist and have links, an absent one is filled from the candidates."""
    known = pages.select("page_id", "title").join(degrees, "page_id", "left")
    fit = candidates(pages, n, seed).filter(usable(F.col("title"))).join(degrees, "page_id", "left")
    out, into = F.coalesce("outgoing_count", F.lit(0)) > 0, F.coalesce("incoming_count", F.lit(0)) > 0
    order = F.struct("pos", "page_id")
    first = known.filter((F.col("title") == start) & out).agg(F.min("title").alias("s")) if start else fit.filter(out & (F.col("title") != F.lit(target or ""))).agg(F.min_by("title", order).alias("s"))
    first = F.broadcast(first)
    if target:
        pairs = known.filter((F.col("title") == target) & into).agg(F.min("title").alias("t")).join(first, F.col("s") != F.col("t"))
        return pairs.select(F.col("s").alias("start_page_title"), F.col("t").alias("target_page_title"))
    other = fit.filter(into).join(first, F.col("title") != F.col("s"))
    return other.groupBy(F.col("s").alias("start_page_title")).agg(F.min_by("title", order).alias("target_page_title"))


def check_pairs(pairs: DataFrame, pages: DataFrame, degrees: DataFrame, min_out: int = 1, min_in: int = 1) -> DataFrame:
    """The pairs (start, target) with ``verdict``: same_page, no_start, no_target, no_outgoing, no_incoming or ok."""
    known = pages.select("page_id", F.col("title").alias("t")).join(degrees, "page_id", "left")
    s = known.select(F.col("t").alias("start"), F.col("page_id").alias("s"), F.coalesce("outgoing_count", F.lit(0)).alias("o"))
    e = known.select(F.col("t").alias("target"), F.col("page_id").alias("e"), F.coalesce("incoming_count", F.lit(0)).alias("i"))
    verdict = (
        F.when(F.trim("start") == F.trim("target"), "same_page")
        .when(F.col("s").isNull(), "no_start")
        .when(F.col("e").isNull(), "no_target")
        .when(F.col("o") < min_out, "no_outgoing")
        .when(F.col("i") < min_in, "no_incoming")
        .otherwise("ok")
    )
    return pairs.join(s, "start", "left").join(e, "target", "left").select("start", "target", verdict.alias("verdict"))


def model_info(models: DataFrame) -> DataFrame:
    """id, name, provider, icon, created, prices for a million tokens; newest first, no date last."""
    provider = F.split_part("id", F.lit("/"), F.lit(1))
    icons = F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair])
    million = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * 1_000_000
    out = models.select("id", "name", provider.alias("provider"), F.coalesce(icons[F.lower(provider)], F.lower(provider)).alias("icon"), F.coalesce("created", F.lit(0)).alias("created"), million("prompt_price").alias("input_price"), million("completion_price").alias("output_price"))
    return out.orderBy(F.col("created").desc(), "id")


def search_models(models: DataFrame, text: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Models whose name, provider or id contains the text in any case, but those in ``without``."""
    t = F.lower(F.lit(text))
    hit = F.lower("name").contains(t) | F.lower("provider").contains(t) | F.lower("id").contains(t)
    return models.filter(hit & ~F.col("id").isin(*without)) if without else models.filter(hit)


def search_titles(pages: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Titles that begin with a text of two characters or more, in any case, without disambiguation pages."""
    hit = fold(F.col("title")).startswith(fold(F.lit(text))) & ~F.lower("title").contains("(disambiguation)") & F.lit(len(text) >= 2)
    return pages.filter(hit).select("page_id", "title").orderBy("title", "page_id").limit(limit)


def coverage(edges: DataFrame) -> DataFrame:
    """One row: pages with links out, pages with links in, links."""
    return edges.agg(F.countDistinct("src_id").alias("with_outgoing"), F.countDistinct("dst_id").alias("with_incoming"), F.count("*").alias("links"))


def timing_profile(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean and sample deviation of a measure by groups."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))


def task_space(pages: DataFrame) -> DataFrame:
    """articles (a fixed number where there are none), tasks (ordered pairs) and tasks as text."""
    n = pages.filter((F.col("namespace") == 0) & ~F.col("is_redirect")).agg(F.count("*").alias("articles"))
    n = n.select(F.when(F.col("articles") > 0, F.col("articles")).otherwise(F.lit(FALLBACK_ARTICLES)).cast("long").alias("articles"))
    return n.select("articles", (F.col("articles") * F.col("articles")).alias("tasks"), F.format_number(F.col("articles") * F.col("articles"), 0).alias("shown"))
