"""The corpus pipeline: documents through the stages of STAGES, each written and read again.

A stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm import decontam, mixing, near_dedup, quality, sharding
from navgraph.llm.common import documents, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and their posterior keep (operator 3)."""
    kept = quality.judge(docs, keep=docs.columns).filter("kept")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (operator 2, with shingles of five words as for all stages; only the query's contract asks for four)."""
    return near_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item (operator 4)."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (operator 9)."""
    return mixing.repeat(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, shard and slot (operator 10)."""
    out = sharding.shard(docs, keep=docs.columns)
    added = ["size", "text_crc32", "shard", "slot"]
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in added], *added)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("shard", deal_shards),
]

#: The stages fit models and draw samples, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
