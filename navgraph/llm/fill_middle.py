"""Operator 13: fill-in-the-middle texts, cut by a kernel that works on a whole batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navgraph.llm.arrow import byte_slices, flat
from navgraph.llm.common import documents, text_of

#: Marks of prefix, suffix and middle; a text that holds one stays as it is.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True)
class Unit:
    """Where a text may be cut: ``kind`` maps bytes to classes, and a unit begins between two bytes whose classes ``opens`` names (before, after)."""

    kind: np.ndarray
    opens: np.ndarray


def _unit(members: Sequence[int], opens: Sequence[tuple[int, int]]) -> Unit:
    kind, table = np.zeros(256, np.uint8), np.zeros((2, 2), bool)
    kind[list(members)] = 1
    for pair in opens:
        table[pair] = True
    return Unit(kind, table.ravel())


#: Lines end with their newline, words with the white space after them; characters are UTF-8 sequences.
UNITS = {
    "line": _unit([10], [(1, 0), (1, 1)]),
    "word": _unit([32, *range(9, 14)], [(1, 0)]),
    "char": _unit(range(0x80, 0xC0), [(0, 0), (1, 0)]),
}


def before(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and before the end."""
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])


def marked(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text holds one of MARKS."""
    inner = np.zeros(256, bool)
    inner[[ord(m[1]) for m in MARKS]] = True
    p = np.flatnonzero(data[:-2] == ord("<"))
    p = p[inner[data[p + 1]] & (data[p + 2] == ord(">"))]
    row = np.searchsorted(at, p, "right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[row[p + 2 < at[row + 1]]] = True
    return out


def cuts(data: np.ndarray, at: np.ndarray, draws: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its number of units n, and the bytes where prefix and middle end, after min and max of ``draws`` (two a text) modulo n + 1 units."""
    kind = unit.kind[data]
    opens = np.ones(len(data), bool)
    opens[1:] = unit.opens[2 * kind[:-1] + kind[1:]]
    starts, ends = at[:-1], at[1:]
    opens[starts[starts < ends]] = True
    count = before(opens)
    first = count[starts].astype(np.int64)
    n = count[ends] - first
    taken = np.sort(draws % (n + 1), axis=0)
    # The unit after the cut is the first byte at which so many units are open; after the last it lies in a later text.
    wanted = (first + taken + 1).ravel()
    place = np.searchsorted(count[1:], wanted).reshape(2, -1)
    return n, np.minimum(place[0], ends), np.minimum(place[1], ends)


def rewritten(texts: pa.Array, draws: np.ndarray, stays: np.ndarray, spm: np.ndarray, unit: Unit) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all texts of a batch."""
    data, at = flat(texts)
    starts, ends = at[:-1], at[1:]
    n, low, high = cuts(data, at, draws, unit)
    plain = stays | (starts == ends) | marked(data, at)
    form = np.where(plain, 0, np.where(spm, 2, 1))
    chars = before((data & 0xC0) != 0x80)
    view, (p, s, m) = memoryview(np.ascontiguousarray(data)), (x.encode() for x in MARKS)
    parts: list = []
    for kind, a, b, c, d in zip(form.tolist(), starts.tolist(), low.tolist(), high.tolist(), ends.tolist(), strict=True):
        if kind == 0:
            parts.append(view[a:d])
        elif kind == 1:
            parts += (p, view[a:b], s, view[c:d], m, view[b:c])
        else:
            parts += (s, view[c:d], p, view[a:b], m, view[b:c])
    size = ends - starts + np.where(plain, 0, sum(map(len, MARKS)))
    places = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    output = pa.StringArray.from_buffers(len(texts), pa.py_buffer(places), pa.py_buffer(b"".join(parts)))
    whole = lambda x: pa.array(x.astype(np.int64), pa.int64(), mask=plain)
    return [pa.array(n, pa.int64()), pa.array(FORMS).take(pa.array(form)), whole(chars[low] - chars[starts]), whole(chars[high] - chars[low]), output]


def draws_of(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that seed and id decide; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_middle(docs: DataFrame, keep: Sequence[str], seed: int = 7, unit: str = "line", percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """Texts cut in prefix, middle and suffix, with the middle moved to the end.

    ``docs`` has doc_id and text. The result has ``doc`` (a struct of ``keep``),
    n (units of the text), form, prefix_chars and middle_chars (code points;
    null if plain) and output. Of the draws that seed and doc_id decide, two
    place the cuts, the third leaves texts ``plain`` (100 - percent of them), the
    fourth chooses spm or psm. Empty texts (null: empty), and those that hold a
    mark, are plain, and their output is the text. Rows that repeat, and rows
    without an id, which count as one id, are cut alike where their texts are.

    One pass without a shuffle. A batch's texts are one byte array: classes of
    bytes are looked up, adjacent classes tell where units begin, a running sum
    less its value at a text's start counts the text's units, and one search in
    it finds the cuts of all rows.
    """
    h = draws_of(F.col("doc_id"), seed)
    rows = docs.select(F.struct(*keep).alias("doc"), text_of().alias("text"), h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 >= percent).alias("stays"), (h[3] % 100 < spm_percent).alias("spm"))
    cut_at = UNITS[unit]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text"):
            draws = np.stack([b[c].to_numpy() for c in ("h1", "h2")])
            flags = [b[c].to_numpy(zero_copy_only=False) for c in ("stays", "spm")]
            yield pa.RecordBatch.from_arrays([b["doc"], *rewritten(b["text"], draws, *flags, cut_at)], ["doc", "n", "form", "prefix_chars", "middle_chars", "output"])

    long = T.LongType()
    fields = [("n", long), ("form", T.StringType()), ("prefix_chars", long), ("middle_chars", long), ("output", T.StringType())]
    return rows.mapInArrow(each, T.StructType([rows.schema["doc"], *(T.StructField(*f) for f in fields)]))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: the marks part it, as no text that is cut holds one."""
    p = F.split(output, "|".join(MARKS), 4)
    part = lambda k: F.get(p, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
p AS (
  SELECT doc_id, text, n, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""
