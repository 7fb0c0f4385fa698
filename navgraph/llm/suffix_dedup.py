"""Operator 5: removal of passages that other documents hold, by suffixes sorted in a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm.bwt import smallest_owner
from navgraph.llm.common import broadcast_up_to, discard, documents, materialize, release, text_of
from navgraph.llm.hashing import as_bytes, lists, mix, slices

_U = np.uint64
#: A string's anchor is the least hash of its ANCHOR-byte substrings: equal strings have equal anchors.
ANCHOR = 24
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: A piece holds so many strings of one anchor at most; only texts that repeat themselves have so many in a row.
PIECE = 256
#: Anchors with up to so many unlike pieces go to one transform together (about 100 MB of arrays); those with more are worked off string by string.
TOGETHER = 16_000
#: Symbols that one transform takes, about, so that its arrays fit a core's cache; an anchor's pieces are never divided.
TRANSFORM = 1 << 16
MAX_BROADCAST_ROWS = 1_000_000
#: Strings that are hashed at once; a longer text is cut into overlapping parts.
PART = 1 << 17


def parts(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Groups of parts of texts of about PART bytes: text number and first byte of each part, and its bytes.

    A text's parts overlap by ``length`` - 1 bytes, so each of its strings lies in one part.
    """
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PART):
            if group and held + len(t) - at > PART:
                yield np.array([g[0] for g in group]), np.array([g[1] for g in group]), [g[2] for g in group]
                group, held = [], 0
            part = t[at : at + PART + length - 1] if at or len(t) > PART else t
            group.append((i, at, part))
            held += len(part)
    if group:
        yield np.array([g[0] for g in group]), np.array([g[1] for g in group]), [g[2] for g in group]


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[dict[str, np.ndarray], bytes]]:
    """The texts, cut where the anchor of their ``length``-byte strings changes, with the joined bytes they lie in.

    Columns text (its number), start (first string, within the text), n
    (strings, so n + length - 1 bytes), at (start in the joined bytes) and
    anchor. Texts with less than ``length`` bytes have none.
    """
    for text, offset, group in parts(texts, length):
        joined = b"".join(group)
        n, window, strings = len(joined), length - ANCHOR + 1, len(joined) - length + 1
        if strings <= 0:
            continue
        data = np.frombuffer(joined, np.uint8)
        eight = np.empty(n - 7, np.uint64)
        for k in range(8):
            part = np.frombuffer(data[k : k + (n - k) // 8 * 8].tobytes(), "<u8")
            eight[k::8] = part[: len(eight[k::8])]
        grams = n - ANCHOR + 1
        least = eight[:grams] * _U(_ODD[0])
        for k in range(1, ANCHOR // 8):
            least += eight[8 * k : 8 * k + grams] * _U(_ODD[k])
        least ^= least >> _U(29)
        least *= _U(0xBF58476D1CE4E5B9)
        least ^= least >> _U(32)
        width = 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        ends = np.cumsum([len(t) for t in group])
        begins = np.concatenate([[0], ends[:-1]])
        change = np.empty(strings, bool)
        change[0] = True
        np.not_equal(least[1:], least[:-1], out=change[1:])
        for edge in (begins, ends - length + 1):  # where a part's strings begin, and after its last one
            change[edge[(edge >= 0) & (edge < strings)]] = True
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, strings))
        part = np.searchsorted(ends, first, "right")
        fit = first + length <= ends[part]
        first, count, part = first[fit], count[fit], part[fit]
        if len(count) and count.max() > PIECE:
            cuts = -(-count // PIECE)
            within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            first, part, left = np.repeat(first, cuts) + within * PIECE, np.repeat(part, cuts), np.repeat(count, cuts) - within * PIECE
            count = np.minimum(left, PIECE)
        yield {"text": text[part], "start": first - begins[part] + offset[part], "n": count, "at": first, "anchor": least[first].view(np.int64)}, joined


def digests(p: dict[str, np.ndarray], joined: bytes, use: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the bytes of the pieces ``use``: eight bytes after eight are mixed in, the last eight at the end."""
    data = np.frombuffer(joined, np.uint8)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8")[:, 0] if len(use) else np.zeros(0, np.uint64)
    at, size = p["at"][use], p["n"][use] + length - 1
    h = mix(size.astype(np.uint64))
    for k in range(0, int(size.max()) - 7 if len(use) else 0, 8):
        on = np.flatnonzero(size >= k + 8)
        h[on] = mix(h[on] * _U(_ODD[0]) + eight[at[on] + k])
    return mix(h * _U(_ODD[1]) + eight[at + size - 8]).view(np.int64) if len(use) else h.view(np.int64)


def joint(text: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """One hash of a text's number and values, to look up pairs in a batch."""
    h = mix(text.astype(np.uint64))
    for v in values:
        h = mix(h * _U(_ODD[2]) + v.view(np.uint64))
    return h


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in ``known``, which is sorted."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The number of its list, and the value, of each value of a column of int64 lists."""
    return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy()), column.flatten().to_numpy()


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """The distinct (anchor, doc_id)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for p, _ in pieces(as_bytes(batch["text"]), length):
                order = np.lexsort((p["anchor"], p["text"]))
                anchor, text = p["anchor"][order], p["text"][order]
                new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))[: len(order)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new], pa.int64()), pa.array(ids[text[new]], pa.int64())], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(found, "anchor long, doc_id long")


def cut(docs: DataFrame, length: int, whole: bool = False) -> DataFrame:
    """The distinct pieces of each document whose anchor is in its array ``wanted``; ``whole``: those whose digest is in ``digests``, with their bytes."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch["doc_id"].to_numpy()
            wanted = np.unique(joint(*flat(batch["wanted"])))
            known = np.unique(joint(*flat(batch["digests"]))) if whole else None
            for p, joined in pieces(as_bytes(batch["text"]), length):
                use = np.flatnonzero(among(joint(p["text"], p["anchor"]), wanted))
                d = digests(p, joined, use, length)
                if whole:
                    hit = among(joint(p["text"][use], d), known)
                    use, d = use[hit], d[hit]
                _, one = np.unique(joint(p["text"][use], p["anchor"][use], d), return_index=True)
                use, d = use[one], d[one]
                columns = [pa.array(ids[p["text"][use]], pa.int64()), pa.array(p["anchor"][use], pa.int64()), pa.array(d, pa.int64())]
                if whole:
                    columns.append(pa.array([joined[s : s + n + length - 1] for s, n in zip(p["at"][use].tolist(), p["n"][use].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "anchor", "digest", "piece"][: len(columns)])

    return docs.select("doc_id", "text", "wanted", *["digests"] * whole).mapInArrow(found, "doc_id long, anchor long, digest long" + ", piece binary" * whole)


def compared(held: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """For pieces that share an anchor with unlike ones: anchor, digest, least (for each string, its smallest document); ``hot`` has the anchors of many."""

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[int, int, int, bytes]] = []
        size = 0

        def done() -> pa.RecordBatch:
            least = smallest_owner([x[3] for x in some], np.array([x[2] for x in some], np.int64), length)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64()), lists(least, pa.int64())], ["anchor", "digest", "least"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "digest", "owner", "piece")), strict=True):
                if some and size > TRANSFORM and some[-1][0] != row[0]:
                    yield done()
                    some, size = [], 0
                some.append(row)
                size += len(row[3])
        if some:
            yield done()

    columns = ["anchor", "digest", "owner", "piece"]
    few = held.select(*columns).join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    together = few.mapInArrow(transformed, "anchor long, digest long, least array<long>")

    # Strings of very common anchors are grouped themselves, byte for byte: sums before the shuffle, and no large group.
    at = F.sequence(F.lit(1), F.octet_length("piece") - (length - 1))
    strings = held.join(hot, "anchor", "left_semi").select("anchor", "digest", "owner", F.posexplode(F.transform(at, lambda i: F.substring("piece", i, length))).alias("i", "string"))
    smallest = strings.groupBy("string").agg(F.min("owner").alias("m"))
    each = strings.join(smallest, "string").groupBy("anchor", "digest").agg(F.sort_array(F.collect_set(F.struct("i", "m"))).alias("s"))
    return together.unionByName(each.select("anchor", "digest", F.col("s.m").alias("least")))


def removed(docs: DataFrame, keep: Sequence[str], length: int = 50) -> DataFrame:
    """Each document without the ``length``-byte strings that a document with a smaller doc_id holds.

    ``docs`` has doc_id and text. The result has ``doc`` (a struct of ``keep``),
    n_bytes, spans (array of start, end: the maximal removed runs, in bytes of
    the UTF-8 text) and rest (the bytes that remain; not valid UTF-8 where a cut
    parts a character). Null and empty texts, texts shorter than ``length`` and
    rows without doc_id stay whole. Rows with one doc_id don't remove each
    other's bytes. Overlaps of a text with itself don't count.

    Exact copies of a smaller document go whole. Of the others, each string
    belongs to its anchor. Anchors of one document are settled; for the rest
    the texts are cut into pieces of one anchor. A piece that no other piece of
    its anchor differs from belongs to its smallest document; unlike pieces of
    an anchor are compared by a Burrows-Wheeler transform.
    """
    text, key = text_of().cast("binary"), F.md5(text_of())
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("copy")).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    ids = materialize(known.select("doc_id", "copy"), "copies")
    # Tables of their own where a join's key may be very common, so that adaptive execution can split it.
    first = materialize(ids.groupBy("copy").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("copy", "first"), "first-copies")
    copies = materialize(ids.join(first, "copy").filter("doc_id > first").select("doc_id", "copy").distinct(), "later-copies")
    discard(ids, first)
    single = known.join(broadcast_up_to(copies, MAX_BROADCAST_ROWS), ["doc_id", "copy"], "left_anti")

    # The pairs are made twice: that takes less than keeping them.
    pairs = anchors(single, length)
    shared = materialize(pairs.groupBy("anchor").count().filter("count > 1").select("anchor"), "shared")
    release(docs.sparkSession)
    wanted = materialize(pairs.join(shared.hint("shuffle_hash"), "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("wanted")), "shared-anchors")
    discard(shared)
    release(docs.sparkSession)
    found = materialize(cut(single.join(wanted.hint("shuffle_hash"), "doc_id"), length), "pieces")

    unlike = materialize(found.groupBy("anchor", "digest").agg(F.min("doc_id").alias("owner")), "unlike-pieces")
    many = materialize(unlike.groupBy("anchor").agg(F.count("*").alias("unlike")).filter("unlike > 1"), "many")
    contested = unlike.join(many, "anchor")
    # The bytes of a piece are cut anew, from its owner's text, where they are needed.
    owned = materialize(contested.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_set("anchor").alias("wanted"), F.collect_list("digest").alias("digests")), "owned")
    held = materialize(cut(single.join(owned.hint("shuffle_hash"), "doc_id"), length, whole=True).select(F.col("doc_id").alias("owner"), "anchor", "digest", "piece"), "contested")
    hot = materialize(many.filter(F.col("unlike") > TOGETHER).select("anchor"), "hot-anchors")
    compared_pieces = compared(held, broadcast_up_to(hot, MAX_BROADCAST_ROWS), length)
    settled = unlike.join(many, "anchor", "left_anti").select("anchor", "digest", F.array("owner").alias("least"))
    least = materialize(compared_pieces.unionByName(settled), "least")
    discard(wanted, unlike, many, owned, hot, held)
    verdicts = found.join(least.hint("shuffle_hash"), ["anchor", "digest"]).filter(F.exists("least", lambda m: m < F.col("doc_id")))
    verdicts = verdicts.select("doc_id", F.struct("anchor", "digest", "least").alias("v"), F.lit(None).cast("string").alias("copy"))
    work = verdicts.unionByName(copies.select("doc_id", F.lit(None).cast(verdicts.schema["v"].dataType).alias("v"), "copy"))
    work = materialize(work.groupBy("doc_id").agg(F.collect_list("v").alias("_verdicts"), F.collect_set("copy").alias("_copies")), "to-remove")
    discard(found, least)

    marked = docs.select(F.struct(*keep).alias("doc"), text.alias("_text"), F.col("doc_id").cast("long").alias("_id"))
    marked = marked.join(work.withColumnRenamed("doc_id", "_id").hint("shuffle_hash"), "_id", "left")
    return apply(marked, length)


def apply(marked: DataFrame, length: int) -> DataFrame:
    kind = marked.schema["doc"].dataType.simpleString()

    def marks(texts: list[bytes], ids: np.ndarray, verdicts: pa.ListArray, base: np.ndarray, depth: np.ndarray) -> None:
        """Count up in ``depth`` where a string that goes begins, and down where it ends."""
        v = verdicts.flatten()
        whose = np.repeat(np.arange(len(verdicts)), verdicts.value_lengths().fill_null(0).to_numpy())
        anchor, known, least = v.field("anchor").to_numpy(), v.field("digest").to_numpy(), v.field("least")
        size, value = least.value_lengths().to_numpy(), least.flatten().to_numpy()
        first = np.cumsum(size) - size
        wanted, keys = np.unique(joint(whose, anchor)), joint(whose, anchor, known)
        order = np.argsort(keys)
        keys = keys[order]
        for p, joined in pieces(texts, length) if len(keys) else ():
            use = np.flatnonzero(among(joint(p["text"], p["anchor"]), wanted))
            mine = joint(p["text"][use], p["anchor"][use], digests(p, joined, use, length))
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[at] == mine
            use, at = use[hit], order[at[hit]]
            n = p["n"][use]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = value[np.repeat(first[at], n) + np.where(np.repeat(size[at], n) > 1, within, 0)]
            goes = owner < np.repeat(ids[p["text"][use]], n)
            starts = (np.repeat(base[p["text"][use]] + p["start"][use], n) + within)[goes]
            depth[starts] += 1
            depth[starts + length] -= 1

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch["_text"])
            ids, copies = batch["_id"].fill_null(0).to_numpy(), batch["_copies"].to_pylist()
            whole = [bool(c) and hashlib.md5(t).hexdigest() in c for c, t in zip(copies, texts, strict=True)]
            sizes = np.array([len(t) for t in texts], np.int64)
            base = np.cumsum(sizes + 1) - sizes - 1  # each text has a byte of its own after it, where no run goes on
            depth = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
            has = batch["_verdicts"].value_lengths().fill_null(0).to_numpy() > 0
            marks([t if h and not w else b"" for t, h, w in zip(texts, has, whole, strict=True)], ids, batch["_verdicts"], base, depth)
            edge = np.diff(np.concatenate([[False], np.cumsum(depth) > 0]).astype(np.int8))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            bounds = np.searchsorted(start, np.append(base, len(depth)))
            spans, rest = [], []
            for i, t in enumerate(texts):
                part = slice(bounds[i], bounds[i + 1])
                gone = [(0, len(t))] if whole[i] else list(zip((start[part] - base[i]).tolist(), (end[part] - base[i]).tolist(), strict=True))
                spans.append([{"start": a, "end": b} for a, b in gone])
                stops = [0, *(x for s in gone for x in s), len(t)]
                rest.append(b"".join(t[a:b] for a, b in zip(stops[::2], stops[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(rest, pa.binary())], ["doc", "n_bytes", "spans", "rest"]
            )

    return marked.mapInArrow(clean, f"doc {kind}, n_bytes long, spans array<struct<start:long,end:long>>, rest binary")


def taken(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc.doc_id", "n_bytes", taken(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))
