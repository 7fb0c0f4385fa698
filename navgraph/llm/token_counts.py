"""Operator 7: token counts of documents in flat token files, by a scan for their separators."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navgraph.llm.common import documents, materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's tokenizer parts a text before merging; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The identifier that ends each document: the one after the vocabulary's last. Identifiers take two bytes.
SEPARATOR = 50_256
KIND = np.dtype("<u2")
#: Tokens of a block; blocks are cut without regard to documents.
BLOCK = 1 << 18
#: Blocks of a file that are scanned together; their sums are then scanned as one row.
STRETCH = 4096

BLOCKS = "file long, block long, tokens binary, first long, ids array<long>"


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Flat token files of ``docs`` (doc_id, text), one for each task, in the shared folder.

    A file is the tokens of its documents, each followed by SEPARATOR, without
    any index. It is kept as rows of BLOCK tokens (file, block, tokens), as a
    task can write them through Spark to any store. Rows of first and ids name
    the documents in the order of the file, and nothing about where they lie.
    Null and empty texts are a separator alone.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, block, first = encoding(vocabulary).encode_ordinary, TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        size = 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["file", "block", "tokens", "first", "ids"])

        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            yield rows([(file, None, None, first, ids)])
            first += len(ids)
            for text in batch["text"]:
                held.append(np.array([*encode(text.as_py() or ""), SEPARATOR], KIND))
                size += len(held[-1])
                if size >= BLOCK:
                    flat, full = np.concatenate(held), size // BLOCK
                    for k in range(full):
                        yield rows([(file, block + k, flat[k * BLOCK : (k + 1) * BLOCK].tobytes(), None, None)])
                    held, size, block = [flat[full * BLOCK :]], size - full * BLOCK, block + full
        if size:
            yield rows([(file, block, np.concatenate(held).tobytes(), None, None)])

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, BLOCKS), "tokens")


def read_flat(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK) -> DataFrame:
    """(file, block, tokens) of flat binary files of two-byte identifiers of any size at ``path``; file is the path.

    Spark lists the files; their blocks are rows that are dealt to tasks, and
    each task reads its byte ranges from the store that holds the files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    cuts = F.expr(f"sequence(0L, (size - 1) div {block_bytes})")
    blocks = files.filter("size > 0").select("file", "size", F.explode(cuts).alias("block")).repartition("file", "block")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, block in zip(*(batch[c].to_pylist() for c in ("file", "size", "block")), strict=True):
                store, place = fs.FileSystem.from_uri(file)
                with store.open_input_file(place) as f:
                    tokens = f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([tokens], pa.binary())], ["file", "block", "tokens"])

    return blocks.mapInArrow(ranges, "file string, block long, tokens binary")


def _scan(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """With first and carry: the separators of all rows before one in its group, and the tokens after the last of them (or all, if there is none)."""
    own = Window.partitionBy(*within).orderBy(order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    # Rows between two that hold separators are one run; the tail of the row that ends a run opens the next one.
    runs = rows.withColumns({"first": F.coalesce(F.sum("ends").over(before), F.lit(0)), "run": F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(before), F.lit(0)), "opened": F.lag(F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.lit(0)), 1, 0).over(own)})
    so_far = Window.partitionBy(*within, "run").orderBy(order)
    passed = F.sum("opened").over(so_far) + F.coalesce(F.sum(F.when(F.col("ends") > 0, F.lit(0)).otherwise(F.col("tail"))).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.withColumn("carry", passed).drop("run", "opened")


def carried(blocks: DataFrame) -> DataFrame:
    """Blocks (file, stretch, block, ends, head, tail) with first and carry over the whole file: a scan in each stretch, and one over what the stretches come to."""
    inside = _scan(blocks, ["file", "stretch"], "block")
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    sums = inside.groupBy("file", "stretch").agg(F.sum("ends").alias("ends"), F.max_by(left, "block").alias("tail"))
    outside = _scan(sums, ["file"], "stretch").select("file", "stretch", F.col("first").alias("_first"), F.col("carry").alias("_carry"))
    both = inside.join(outside, ["file", "stretch"])
    carry = F.col("carry") + F.when(F.col("first") == 0, F.col("_carry")).otherwise(F.lit(0))
    return both.withColumn("carry", carry).withColumn("first", F.col("first") + F.col("_first")).drop("_first", "_carry")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """The documents of flat token files: file, ordinal (from 0, in the file's order), n_tokens (without separator), ended.

    ``blocks`` has file, block (its order in the file) and tokens. Each block is
    searched on its own; what it knows is its inner documents' lengths, the
    tokens before its first separator and those after its last. A scan over a
    file's blocks, one small row each, adds up the separators before a block
    and the tokens carried into it since the last separator; it goes over
    stretches of a file's blocks first, and over the stretches' sums then, so no
    task has all blocks of a file. A document may span any number of blocks. Tokens after a file's last separator are a
    document that is not ended. A file without tokens has no documents.
    """
    kind = blocks.schema["file"].dataType

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, head, tail, inner = [], [], [], []
            for b in batch["tokens"]:
                t = np.frombuffer(b.as_py(), KIND)
                at = np.flatnonzero(t == separator)
                ends.append(len(at))
                head.append(int(at[0]) if len(at) else 0)
                tail.append(len(t) - 1 - int(at[-1]) if len(at) else len(t))
                inner.append(np.diff(at) - 1)
            lengths = pa.array([x.tolist() for x in inner], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], *(pa.array(x, pa.int64()) for x in (ends, head, tail)), lengths], ["file", "block", "ends", "head", "tail", "inner"])

    found = materialize(blocks.select("file", "block", "tokens").mapInArrow(searched, f"file {kind.simpleString()}, block long, ends long, head long, tail long, inner array<long>"), "block-ends")
    # The scan sees a few numbers of each block; lengths of inner documents stay where they are.
    placed = carried(found.drop("inner").withColumn("stretch", F.expr(f"block div {STRETCH}")))
    placed = placed.withColumn("newest", F.col("block") == F.max("block").over(Window.partitionBy("file", "stretch")))
    lengths = F.concat(F.array(F.col("carry") + F.col("head")), "inner")
    inner = found.filter("ends > 0").select("file", "block", "inner")
    ended = placed.filter("ends > 0").join(inner, ["file", "block"]).select("file", "first", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    last = placed.filter("newest").join(placed.groupBy("file").agg(F.max("stretch").alias("stretch")), ["file", "stretch"])
    open_end = last.select("file", (F.col("first") + F.col("ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended")).filter("n_tokens > 0")
    return ended.unionByName(open_end)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = write_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    counts = count_tokens(flat.filter("tokens IS NOT NULL"))
    named = flat.filter("ids IS NOT NULL").select("file", "first", F.posexplode("ids").alias("i", "doc_id"))
    named = named.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return named.join(counts, ["file", "ordinal"], "left").select("doc_id", "n_tokens")
