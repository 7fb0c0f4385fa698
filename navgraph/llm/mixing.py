"""Operator 9: mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navgraph.llm.common import GAP, broadcast_up_to, documents, materialize, row_numbers, text_of, words

#: Documents of one (source, bucket) that the boundary step sorts together, about.
BOUNDARY_ROWS = 50_000
MAX_BROADCAST_SOURCES = 20_000


def water_level(sources: DataFrame, total: int, max_epochs: int) -> Fraction:
    """The level L at which targets min(weight * L, max_epochs * size) add up to ``total``.

    Sources above their cap are clamped and the rest share what is left, until
    none is above; a source once clamped stays so, as the level only rises. Each
    round is one small aggregate, and only the level passes through the driver.
    """
    level = Fraction(0)
    wide = "decimal(38,0)"
    weight, cap = F.col("weight").cast(wide), (F.col("source_size") * max_epochs).cast(wide)
    while True:
        over = (weight * F.lit(level.numerator).cast(wide)) > (cap * F.lit(level.denominator).cast(wide))
        clamped, free = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, weight))).first()
        if not free:
            return level
        following = Fraction(total - int(clamped or 0), int(free))
        if following == level:
            return level
        level = following


def mix(docs: DataFrame, keep: Sequence[str], weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 9) -> DataFrame:
    """How many words of each document a mix takes.

    ``docs`` has doc_id, text and source. The result has ``doc`` (a struct of
    the columns in ``keep``), size, source, source_size, target, taken and whole.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    all words; a target stops at ``max_epochs`` times the source's size. Whole
    words T of a target are its floor, and one more for the sources with the
    largest remainders (the first in order among equal ones), so all T add up
    to all sizes. With size S, each document is taken T // S times (``whole``),
    and documents in seeded order once more until the rest of T is reached: the
    last of them in part. So each source's taken words are T exactly. The order
    is by md5 of seed and doc_id (of the text where doc_id is null), so reruns
    agree. No text: size 0. No rows: no result rows. Rows that repeat share
    their place in the order and are interchangeable.

    Sums per source and hash bucket are made before anything is sorted, so only
    the documents of one bucket per source, about ``BOUNDARY_ROWS``, are sorted.
    """
    digits = max(3, math.ceil(math.log(max(docs.count(), 1) / BOUNDARY_ROWS, 16)) + 1)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text_of())))
    sized = docs.select(
        F.struct(*keep).alias("doc"),
        F.col("source").alias("source"),
        F.size(words(text_of())).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), ident)).alias("u"),
    ).withColumn("bucket", F.substring("u", 1, digits))
    if "text" not in keep:
        sized = materialize(sized, "mix-sizes")

    sums = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    per_source = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    ranked = row_numbers(per_source, [F.col("source").asc_nulls_last()], "rank")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(ranked.select("source", "source_size", turn.cast("long").alias("weight")), "mix-sources")

    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, total, max_epochs)
    wide = "decimal(38,0)"
    parts, cap = F.col("weight").cast(wide) * F.lit(level.numerator).cast(wide), F.col("source_size") * max_epochs
    floor, left = F.expr(f"CAST(weight * CAST({level.numerator} AS {wide}) AS {wide}) div CAST({level.denominator} AS {wide})"), parts % F.lit(level.denominator).cast(wide)
    capped = parts >= cap.cast(wide) * F.lit(level.denominator).cast(wide)
    exact = sources.withColumns({"target": F.least(parts.cast("double") / F.lit(float(level.denominator)), cap.cast("double")), "floor": F.when(capped, cap).otherwise(floor), "left": F.when(capped, F.lit(0)).otherwise(left).cast(wide)})
    largest = row_numbers(exact, [F.col("left").desc(), F.col("source").asc_nulls_last()], "place")
    missing = total - int(exact.agg(F.sum("floor")).first()[0] or 0)
    targets = (
        largest.withColumn("words", F.col("floor") + (F.col("place") < missing).cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "rest")
    )

    # The bucket in which the running sum passes the rest: all before it get one more copy, none after it.
    running = Window.partitionBy("source").orderBy("bucket")
    passed = (
        sums.join(targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("upto", F.sum("bucket_size").over(running))
        .filter((F.col("upto") - F.col("bucket_size") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("bucket_size")).alias("before"))).alias("edge"))
    )
    plan = targets.join(passed.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = materialize(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest", F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before")), "mix-plan")

    planned = sized.join(broadcast_up_to(plan, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")))
    edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    clear = planned.filter(~edge).withColumn("extra", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    at_edge = planned.filter(edge).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - done)))
    columns = ["doc", "size", "source", "source_size", "target", "whole", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")]
    return clear.select(*columns).unionByName(at_edge.select(*columns))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    A copy taken in part holds the document's first words, joined by blanks;
    n_chars, where there is such a column, is then that copy's length.
    Documents without words are taken never.
    """
    mixed = mix(docs, keep=docs.columns, **options)
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    full = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0))
    copies = mixed.withColumn("_part", part).withColumn("_full", full).filter("_full + _part > 0")
    rows = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_full") + F.when(F.col("_part") > 0, 1).otherwise(0))))
    cut = F.col("_copy") > F.col("_full")
    text = F.when(cut, F.array_join(F.slice(words(F.coalesce(F.col("doc.text"), F.lit(""))), 1, F.col("_part").cast("int")), " ")).otherwise(F.col("doc.text"))
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return rows.select(*[out[c].alias(c) for c in docs.columns])


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select("doc.doc_id", "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '')) AS size,
         md5('9|' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(3 * source_size) OVER p - 3 * source_size AS caps, sum(w) OVER p - w AS ws,
         sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM s WINDOW p AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, w * (total - caps) > 3 * source_size * (all_w - ws) AS clamped FROM o),
f AS (
  SELECT any_value(total) - coalesce(sum(3 * source_size) FILTER (clamped), 0) AS num,
         sum(w) FILTER (NOT clamped) AS den FROM c),
t AS (
  SELECT source, source_size, total,
         least(CAST(w * (num // gcd(CAST(num AS BIGINT), CAST(den AS BIGINT))) AS DOUBLE) / (den // gcd(CAST(num AS BIGINT), CAST(den AS BIGINT))), CAST(3 * source_size AS DOUBLE)) AS target,
         CASE WHEN w * num >= 3 * source_size * den THEN 3 * source_size ELSE CAST((w * num) // den AS BIGINT) END AS low,
         CASE WHEN w * num >= 3 * source_size * den THEN 0 ELSE CAST((w * num) % den AS BIGINT) END AS over
  FROM c, f),
n AS (
  SELECT *, low + CASE WHEN row_number() OVER (ORDER BY over DESC, source NULLS LAST) <= total - sum(low) OVER () THEN 1 ELSE 0 END AS goal FROM t),
g AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS BIGINT) AS whole FROM n),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole,
         CAST(goal AS BIGINT) - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - done)) AS BIGINT) AS taken
FROM r"""
