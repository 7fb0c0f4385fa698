"""Operator 12: packing documents into sequences of tokens, shortest pack first over the histogram of lengths."""

from __future__ import annotations

import heapq
import os
import re
import struct
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navgraph.llm.arrow import SLICE_BYTES, byte_slices
from navgraph.llm.common import broadcast_up_to, documents, materialize, text_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Tokens of a sequence, and the identifier that ends each document.
SIZE, END = 2048, 1
#: Words, and parts of words, whose identifiers a worker remembers, of so many characters at most; words are then forgotten all at once.
REMEMBERED, PARTS_REMEMBERED, LONGEST = 1 << 19, 1 << 17, 64
#: Rows of the table of ranks (task, length) up to which it is broadcast.
MAX_BROADCAST_RANKS = 1_000_000


# Fixed by the vocabulary: how a word is parted before merging, and how its bytes are written as characters. The class
# of letters is that of Latin ones, which its normalizer only puts in lower case; words with others are left to it.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
PLAIN = re.compile(f"[!-~\u00a1\u00ab\u00bb\u00bf{LATIN}]+").fullmatch
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^0-9{LATIN}]+").findall
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
WRITTEN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SHOWN)}


class Words(dict):
    """The identifiers of words between blanks or newlines, as little-endian bytes, two each, or four where the vocabulary needs them, made when first asked for."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.merge = self.tokenizer.model.tokenize
        self.part = lru_cache(PARTS_REMEMBERED)(self.merged)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def merged(self, part: str) -> bytes:
        return self.packed([t.id for t in self.merge(part if part.isascii() else part.encode().decode("latin-1").translate(WRITTEN))])

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            return self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if PLAIN(word) and "<|" not in word:
            found = self.merged(word.lower()) if word.isalpha() else b"".join(map(self.part, PARTS(word.lower())))
        else:
            found = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


@lru_cache(maxsize=1)
def words_of(vocabulary: str) -> Words:
    return Words(vocabulary)


def encode(texts: pa.Array, words: Words, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The identifiers of all texts, each followed by ``end``, behind each other, and how many each text has.

    Texts are encoded word by word, each distinct word once: the vocabulary
    drops white space and merges within words only, so this is what it makes of
    the whole texts. A column that is too long for that at once is cut at blanks.
    """
    if len(texts) == 1 and len(long := texts[0].as_py()) > 4 * SLICE_BYTES:
        pieces, at = [], 0
        while at < len(long):
            cut = long.find(" ", at + SLICE_BYTES)
            cut = len(long) if cut < 0 else cut
            pieces.append(encode(pa.array([long[at:cut]]), words, end)[0])
            at = cut + 1
        whole = np.concatenate([p[:-1] for p in pieces] + [pieces[-1][-1:]])
        return whole, np.array([len(whole)])
    texts = pc.replace_substring(texts, "\n", " ")
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)  # all but special tokens, which may stand here, are put in lower case anyway
    # A mark between a letter and a blank is a part of its own.
    split = pc.split_pattern(pc.replace_substring_regex(texts, r"([\p{L}\p{N}])([.,;:!?]) ", r"\1 \2 "), " ")
    found = split.flatten().dictionary_encode()
    known = [words[w] for w in found.dictionary.to_pylist()]
    kind = np.dtype(f"<{words.code}")
    size = np.fromiter(map(len, known), np.int64, len(known)) // kind.itemsize
    each = found.indices.to_numpy()
    many = size[each]
    done = np.concatenate([[0], np.cumsum(many)])
    offsets = split.offsets.to_numpy()
    total = np.diff(done[offsets - offsets[0]]) + 1
    last = np.cumsum(total) - 1
    out = np.full(len(last) + done[-1], end, kind)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = np.frombuffer(b"".join(known), kind)[np.repeat((np.cumsum(size) - size)[each] - done[:-1], many) + np.arange(done[-1])]
    return out, total


class Placed(NamedTuple):
    """The pieces of ``length`` with ranks from ``rank``, ``count`` of them: ``taken`` tokens from ``start`` lie at ``offset`` of the sequences from ``first``, one each."""

    length: int
    rank: int
    count: int
    start: int
    taken: int
    first: int
    offset: int


def place(histogram: dict[int, int], size: int = SIZE) -> list[Placed]:
    """Where the pieces of a histogram (length: number of pieces) go, in the least number of sequences.

    Lengths are placed longest first, each into the shortest of the open packs;
    a pack stands for all sequences that hold the same lengths, with their
    count. Where the shortest has no room a new pack is opened, while sequences
    are left of the least number that can hold all tokens; then a piece is cut
    to fill the shortest pack, and what is left of it is a shorter length that
    is placed in its turn. So under ``size`` tokens are padded in all. The work
    depends on the number of lengths, not of pieces.
    """
    needed = -(-sum(length * n for length, n in histogram.items()) // size)
    stock: dict[int, list[tuple]] = defaultdict(list)
    for length, n in histogram.items():
        if n:
            stock[length].append((length, 0, n, 0))
    packs: list[tuple[int, int, int]] = []  # used tokens, first sequence, sequences
    opened, out = 0, []
    for length in range(size, 0, -1):
        for origin, rank, count, start in stock.pop(length, ()):
            while count:
                if packs and (packs[0][0] + length <= size or opened == needed):
                    used, first, many = heapq.heappop(packs)
                else:
                    used, first, many = 0, opened, min(count, needed - opened)
                    opened += many
                taken, n = min(length, size - used), min(count, many)
                if n < many:
                    heapq.heappush(packs, (used, first + n, many - n))
                if used + taken < size:
                    heapq.heappush(packs, (used + taken, first, n))
                if taken < length:
                    stock[length - taken].append((origin, rank, n, start + taken))
                out.append(Placed(origin, rank, n, start, taken, first, used))
                rank, count = rank + n, count - n
    return out


def by_rank(placed: list[Placed]) -> dict[int, tuple[list[int], list[list[Placed]]]]:
    """For each length the ranks at which something changes, and what holds from there on: the parts of a piece in their order."""
    own: dict[int, list[Placed]] = defaultdict(list)
    for p in placed:
        own[p.length].append(p)
    out = {}
    for length, found in own.items():
        edges = sorted({p.rank for p in found} | {p.rank + p.count for p in found})[:-1]
        parts: list[list[Placed]] = [[] for _ in edges]
        at = {e: k for k, e in enumerate(edges)}
        for p in found:
            k = at[p.rank]
            while k < len(edges) and edges[k] < p.rank + p.count:
                parts[k].append(p)
                k += 1
        out[length] = edges, [sorted(x, key=lambda p: p.start) for x in parts]
    return out


def tokens_of(docs: DataFrame, keep: Sequence[str], vocabulary: str = VOCABULARY, size: int = SIZE, end: int = END) -> DataFrame:
    """doc, ids (little-endian, two bytes each, or four where the vocabulary needs them), total, task, and full_at and rest_at, in the shared folder.

    A document is whole pieces of ``size`` tokens and a rest; full_at and rest_at
    number its first whole piece and its rest among those of like length in its
    task, which reads them off running counts.
    """
    rows = docs.select(F.struct(*keep).alias("doc"), text_of().alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = words_of(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for b in byte_slices(batches, "text"):
            flat, total = encode(b["text"], words, end)
            full_at, rest_at = [], []
            for n in total.tolist():
                full, rest = divmod(n, size)
                full_at.append(seen[size])
                rest_at.append(seen[rest])
                seen[size] += full
                seen[rest] += 1
            at = np.concatenate([[0], np.cumsum(total)]) * flat.itemsize
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(total), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
            columns = [ids, *(pa.array(x, pa.int64()) for x in (total, [task] * len(total), full_at, rest_at))]
            yield pa.RecordBatch.from_arrays([b["doc"], *columns], ["doc", "ids", "total", "task", "full_at", "rest_at"])

    fields = [T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("total", "task", "full_at", "rest_at"))]
    return materialize(rows.mapInArrow(each, T.StructType([rows.schema["doc"], *fields])), "pack-tokens")


def pack(docs: DataFrame, keep: Sequence[str], vocabulary: str = VOCABULARY, size: int = SIZE, end: int = END) -> DataFrame:
    """The pieces of documents in sequences of at most ``size`` tokens, of which under ``size`` in all are padding.

    ``docs`` has text. A row is a piece: ``doc`` (a struct of ``keep``), start
    (its document's tokens before it), length, tokens (little-endian unsigned
    32-bit identifiers), doc_tokens, sequence_id (from 0) and offset (gapless
    from 0 in a sequence). A document is its identifiers and ``end``; null and
    empty texts are ``end`` alone. Special tokens written out in a text are
    those tokens, as the vocabulary's file has it. Documents over ``size``
    tokens are cut there, others only where they fill a sequence up. Rows that
    repeat are packed each by itself. No rows: no result rows.

    Only counts by length (at most ``size``) reach the driver. The plan that is
    made of them goes to all tasks, and a piece finds its sequence by its rank
    among the pieces of its length: the sum of those of the tasks before and
    its number in its own. Tokens are written once, and aren't shuffled while
    the table of ranks is small enough to be broadcast.
    """
    made = tokens_of(docs, keep, vocabulary, size, end)
    lengths = made.select("task", F.explode(F.array(F.struct((F.col("total") % size).alias("length"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(size).cast("long").alias("length"), F.expr(f"total div {size}").alias("n")))).alias("p"))
    counts = materialize(lengths.filter("p.length > 0 AND p.n > 0").groupBy("task", "p.length").agg(F.sum("p.n").alias("n")), "pack-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = by_rank(place(histogram, size))

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = materialize(counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "pack-ranks")
    rest = broadcast_up_to(ranks.withColumnRenamed("before", "rest_before"), MAX_BROADCAST_RANKS)
    full = broadcast_up_to(ranks.filter(F.col("length") == size).select("task", F.col("before").alias("full_before")), MAX_BROADCAST_RANKS)
    ranked = made.withColumn("length", F.col("total") % size).join(rest, ["task", "length"], "left").join(full, "task", "left")
    known = lambda c: F.coalesce(F.col(f"{c}_before"), F.lit(0)) + F.col(f"{c}_at")
    ranked = ranked.select("doc", "ids", "total", known("full").alias("full"), known("rest").alias("rest"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "ids"):
            row, columns = [], [[] for _ in range(6)]
            for k, (data, total, full, rest) in enumerate(zip(*(b[c].to_pylist() for c in ("ids", "total", "full", "rest")), strict=True)):
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * total else "<u4").astype("<u4")
                for at in range(0, total, size):
                    length = min(size, total - at)
                    rank = full + at // size if length == size else rest
                    edges, parts = plan[length]
                    for p in parts[bisect_right(edges, rank) - 1]:
                        row.append(k)
                        start = at + p.start
                        for column, value in zip(columns, (start, p.taken, ids[start : start + p.taken].tobytes(), total, p.first + rank - p.rank, p.offset), strict=True):
                            column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b["doc"].take(pa.array(row, pa.int32())), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], ["doc", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"])

    fields = [T.StructField(c, T.BinaryType() if c == "tokens" else T.LongType()) for c in ("start", "length", "tokens", "doc_tokens", "sequence_id", "offset")]
    return ranked.mapInArrow(each, T.StructType([ranked.schema["doc"], *fields]))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    return out.select("doc.doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
