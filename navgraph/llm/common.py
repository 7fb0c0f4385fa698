"""Expressions and small steps that several corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navgraph import session
from navgraph.session import broadcast_up_to, discard, release, shared_dir

__all__ = ["broadcast_up_to", "discard", "documents", "lower_az", "materialize", "release", "row_numbers", "shared_dir", "text_of", "words", "words_of"]

#: Corpus steps leave shuffle files as large as their tables, so each is cleaned up after at once.
materialize = partial(session.materialize, always=True)

#: Between words: the blank and the ASCII control characters tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def lower_az(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    Where bytes and characters are equally many the text is ASCII, and the
    built-in ``lower``, which is much faster, does the same.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null."""
    return F.array_remove(F.split(text, GAP), "")


def words_of(text: bytes) -> list[bytes]:
    """The same words of UTF-8 bytes: ``bytes.split`` knows exactly these six separators."""
    return text.split()


def row_numbers(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with gapless numbers from 0 in ``order``, without one task that sorts it all.

    Rows are range partitioned and written; counts of the partitions (one row
    each) give the offset of each, and rows are numbered inside their partition.
    """
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    kept = materialize(spread, "ranges")
    counts = kept.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.withColumn("_in", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_part", "_in", "_before")
