"""Operator 1: toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navgraph.llm.common import broadcast_up_to, documents
from navgraph.llm.hashing import as_bytes

#: Labelled rows that are learnt from: about so many of each class, and only texts up to so many bytes.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 100_000
#: A window is so many words; one word is best on held-out rows, and equal windows are compressed once.
WIDTH = 1
#: Bytes of the base that both dictionaries have, and of the part that each has of its own in each training round.
BASE_BYTES, PART_BYTES = 65_536, (32_768, 16_384, 8_192, 8_192, 4_096, 4_096)
#: The part of a text's windows, those most typical of its class, from which the next round learns.
TYPICAL = (0.08, 0.04, 0.03, 0.03, 0.03)
LEVEL = 12
#: Bytes by which the toxic dictionary shortens a window: the thresholds that a text's windows are counted by.
THRESHOLDS = (1, 2, 3, 4)
#: Each window is compressed between two strings that both dictionaries end with, so that its own cost shows at all.
BEFORE, AFTER = bytes(range(1, 9)) + bytes(range(14, 22)) + b" ", b" " + bytes(range(22, 32)) + bytes([0, 11, 12, 127, 31, 30])
#: Windows whose distance a worker remembers.
REMEMBERED = 1_000_000


def windows(text: bytes, width: int) -> list[bytes]:
    """The windows of ``width`` words of an A-Z lower-cased text, one at each word; a shorter text is one window."""
    w = text.lower().split()
    return w if width == 1 else [b" ".join(g) for g in zip(*(w[i:] for i in range(width)), strict=False)] or [b" ".join(w)] * bool(w)


@dataclass
class Pair:
    """The two dictionaries; ``distance`` is by how many bytes the toxic one shortens a window."""

    toxic: bytes
    ordinary: bytes

    def distance(self) -> Callable[[bytes], int]:
        def compressor(content: bytes) -> Callable[[bytes], bytes]:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False).compress

        toxic, ordinary = compressor(self.toxic), compressor(self.ordinary)
        return lambda w: len(ordinary(BEFORE + w + AFTER)) - len(toxic(BEFORE + w + AFTER))


class Remembered(dict):
    """Distances by window, each computed once."""

    def __init__(self, distance: Callable[[bytes], int]) -> None:
        self.distance = distance

    def __missing__(self, w: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[w] = self.distance(w)
        return found


def train_pair(toxic: Sequence[bytes], ordinary: Sequence[bytes], width: int) -> Pair:
    """Dictionaries from texts of both classes.

    Both have a base trained on ordinary texts, and a part of their own. The
    first parts are trained on whole texts. Each later one is trained on those
    windows of each text that the dictionaries so far take for the most typical
    of its class: the toxic part comes to hold what only toxic texts say, and
    the ordinary part what is mistaken for it.
    """

    def trained(size: int, samples: Sequence[bytes]) -> bytes:
        samples = [s for s in samples if len(s) >= 8]
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: the texts themselves
            return b" ".join(samples)[-size:]

    half = len(ordinary) // 2
    base = trained(BASE_BYTES, ordinary[:half])
    pair = lambda t, o: Pair(t + base + BEFORE + AFTER, o + base + BEFORE + AFTER)
    found = pair(trained(PART_BYTES[0], toxic), trained(PART_BYTES[0], ordinary[half:]))
    for size, part in zip(PART_BYTES[1:], TYPICAL, strict=True):
        of = Remembered(found.distance())

        def typical(texts: Sequence[bytes], of: Remembered = of, part: float = part) -> list[bytes]:
            out = []
            for t in texts:
                known = sorted(set(windows(t, width)))
                best = sorted(known, key=lambda w: (-of[w], hashlib.md5(w).digest()))[: max(1, int(len(known) * part))]
                if best := [w for w in best if of[w] > 0]:
                    out.append(b" " + b"  ".join(sorted(best, key=lambda w: hashlib.md5(w).digest())) + b" ")
            return out

        found = pair(trained(size, typical(toxic)), trained(size, typical(ordinary)))
    return found


def measures(texts: Iterable[bytes], of: Remembered, width: int) -> np.ndarray:
    """For each text: how many windows reach each threshold (log), and their share of all windows."""
    rows = []
    for t in texts:
        counts = Counter(map(of.__getitem__, windows(t, width)))
        n = max(1, counts.total())
        hits = [sum(c for d, c in counts.items() if d >= k) for k in THRESHOLDS]
        rows.append([1.0, *(np.log1p(h) for h in hits), *(min(1.0, 20 * h / n) for h in hits), np.log(n)])
    return np.array(rows or np.empty((0, 2 + 2 * len(THRESHOLDS))))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
    return b


@dataclass
class Model:
    """Dictionaries and calibration; without rows of both classes there are none, and ``prior`` is every score."""

    prior: float
    width: int = WIDTH
    pair: Pair | None = None
    weights: np.ndarray | None = None


def hashed(key: Column) -> Column:
    """A number from 0 to 1 from the id, unlike the CRC that divides the rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 11) / F.lit(float(1 << 53))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, width: int = WIDTH, rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows of ``docs`` for which ``learn`` holds.

    About ``rows`` rows of each class are drawn by a hash of their id, so what
    reaches the driver is bounded at every input size: twice ``rows`` texts of
    ``SAMPLE_BYTES`` bytes at most. Two thirds train the dictionaries; the rest
    calibrate, weighted to the share of toxic rows among all labelled ones.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.filter(learn).withColumn("u", hashed(F.col("doc_id")))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = totals.get(True, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model(prior, width)
    share = F.when(F.col("toxic"), F.lit(rows / totals[True])).otherwise(F.lit(rows / totals[False]))
    chosen = known.filter(F.col("u") < share).select("doc_id", "toxic", "u")
    texts = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, SAMPLE_BYTES)).join(broadcast_up_to(chosen, 4 * rows), "doc_id")
    drawn = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", F.col("text").cast("binary").alias("t"), hashed(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("v")).orderBy("v", F.md5("t")).limit(2 * rows).collect()
    train = {c: [bytes(r["t"]).lower() for r in drawn if r["toxic"] is c and r["v"] < 2 / 3] for c in (True, False)}
    rest = [r for r in drawn if r["v"] >= 2 / 3]
    if not train[True] or len(train[False]) < 2 or len({r["toxic"] for r in rest}) < 2:
        return Model(prior, width)
    pair = train_pair(train[True], train[False], width)
    y = np.array([float(r["toxic"]) for r in rest])
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    x = measures((bytes(r["t"]) for r in rest), Remembered(pair.distance()), width)
    return Model(prior, width, pair, calibrate(x, y, weight))


def scored(docs: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    """``doc`` (a struct of ``keep``) and ``score``, the probability that a text is toxic, from its whole text and nothing else.

    Null and empty texts have no windows; their score is the calibration's for
    none. Equal texts get equal scores. One pass over the rows, without a shuffle.
    """
    rows = docs.select(F.struct(*keep).alias("doc"), F.col("text").alias("text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Remembered(model.pair.distance()) if model.pair else None
        for batch in batches:
            if of is None:
                score = np.full(batch.num_rows, model.prior)
            else:
                x = measures(as_bytes(batch["text"]), of, model.width)
                score = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(score, pa.float64())], ["doc", "score"])

    return rows.mapInArrow(rate, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    out = scored(docs, model, ["doc_id"])
    out = out.select("doc.doc_id", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
