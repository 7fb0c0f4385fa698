"""Hard negatives, packing and fill-in-the-middle against brute force, on the smallest tables and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from navgraph.llm import arrow, common, fill_middle, hard_negatives, packing, vantage

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "", "en", "a", 0), (2, None, "en", None, None), (None, "no id\nhere\n\n" * 9, "en", "a", 1), (None, "no id\nhere\n\n" * 9, "en", "a", 1), (5, "one", "en", "a", 3), (5, "one", "en", "a", 3), (6, "\n", "de", "b", 3),
    (7, "\n\n\nend", "en", "a", 1), (8, "holds a <S> mark\nand lines", "fr", None, 2), (9, "<P", "en", "a", 3), (10, ">\n<M", "en", "a", 3), (11, "è ñ ü\n漢字 𝄞𝄞\t x y\r\nz\x1cq" * 40, "es", "c", 1),
    (12, " ".join(f"word{i % 700}x{i}" + "\n" * (i % 9 == 0) for i in range(40_000)), "en", "a", 1), (13, "x" * 300_000, "en", "a", 1), (-14, "a\nb\nc", "en", "a", 1),
]


def up(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in ("doc", "form", "n", "start", "tokens", "task", "h1")})


SPLIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"\A[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "char": r"(?s)."}


def middle_brute(doc_id, text, unit, seed=7, percent=100, spm=50):
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(SPLIT[unit], text)
    n = len(units)
    assert "".join(units) == text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_fill_middle(spark, sf_dir, unit):
    docs = up(spark, ODD).unionByName(common.documents(spark, sf_dir).limit(60), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = fill_middle.fill_middle(docs, ["doc_id", "n", "doc", "text"], unit=unit, percent=80, spm_percent=30)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, *middle_brute(i, t, unit, percent=80, spm=30)) for i, t in rows)
    assert all(r.back == (r.doc.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(docs.limit(0), ["doc_id"]).count() == 0


def test_byte_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", "", "bb", "c" * 50, "", "", "dd"])], ["t"])
    parts = [b["t"].to_pylist() for b in arrow.byte_slices([batch.slice(1), batch.slice(0, 0)], "t", 6)]
    assert parts == [["", "bb"], ["c" * 50], ["", "", "dd"]] and [x for p in parts for x in p] == batch["t"].to_pylist()[1:]


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    return [[*e.ids, packing.END] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_pack(rows, out, size):
    """Every identifier in one piece, sequences gapless and at most ``size``, under ``size`` padded in all."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        t = np.frombuffer(r.tokens, "<u4")
        assert len(t) == r.length > 0
        pieces[(r.doc.doc_id, r.doc.n_chars)].append((r.start, t, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (key, text), ids in zip(rows, whole_ids([t for _, t in rows]), strict=True):
        own = sorted(pieces[key], key=lambda p: p[0])
        assert [p[0] for p in own] == np.cumsum([0, *(len(p[1]) for p in own)])[:-1].tolist()
        assert np.concatenate([p[1] for p in own]).tolist() == ids and {p[2] for p in own} == {len(ids)}
    total = sum(r.length for r in out)
    assert sorted(sequences) == list(range(-(-total // size)))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist() and sum(p[1] for p in parts) <= size


@pytest.mark.parametrize("size", [64, 2048])
def test_pack(spark, sf_dir, size):
    docs = up(spark, ODD).unionByName(common.documents(spark, sf_dir), allowMissingColumns=True).repartition(5).withColumn("n_chars", F.monotonically_increasing_id())
    docs = common.materialize(docs, "numbered")
    rows = [((r.doc_id, r.n_chars), r.text) for r in docs.collect()]
    check_pack(rows, packing.pack(docs, ["doc_id", "n_chars", "tokens"], size=size).collect(), size)
    assert packing.pack(docs.limit(0), ["doc_id"]).count() == 0


def test_pack_with_shuffled_ranks(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_BROADCAST_RANKS", 0)
    docs = spark.createDataFrame([(i, "la " * (i % 90), i) for i in range(400)], "doc_id long, text string, n_chars long").repartition(7)
    check_pack([((i, i), "la " * (i % 90)) for i in range(400)], packing.pack(docs, ["doc_id", "n_chars"], size=100).collect(), 100)


def test_identifiers_of_words_are_the_tokenizers_own(monkeypatch):
    rng = np.random.default_rng(7)
    texts = ["don't I'LL  x y z", "é ́e\ń", "Σας ΣΑΣ Σ ς", "a\x1cb\x85c\x0bd", "<|endoftext|> x<|startoftext|>y", "ﬁ İİ ẞ", "  \n\n ", "12 345,6\t7", "﻿bom ​zero", "𝄞 漢字かな　전각", "'s' 't''re"]
    texts += ["".join(chr(c) for c in rng.integers(low, high, 40) if not 0xD800 <= c < 0xE000) for low, high in ((33, 127), (33, 0x180), (0xA0, 0x250), (0x300, 0x700), (0x20, 0x3000)) for _ in range(40)]
    texts += [chr(c) + chr(c + 1) + "a" + chr(c) + "'S" for c in range(33, 0x180) if c not in (0x7F, 0xA0)]
    own, want = packing.words_of(packing.VOCABULARY), whole_ids(texts)
    for part in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts))):
        flat, total = packing.encode(part, own)
        assert [x.tolist() for x in np.split(flat, np.cumsum(total)[:-1])] == want
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)
    long = "  ".join(texts)
    flat, total = packing.encode(pa.array([long]), own)
    assert flat.tolist() == whole_ids([long])[0] and total.tolist() == [len(flat)]


def test_placing_of_histograms():
    rng = np.random.default_rng(4)
    cases = [{2048: 5}, {1: 10**9}, {5: 10**10, 2047: 3}, {1025: 7}, {700: 10, 1400: 4}, {}, {3: 0}]
    cases += [{int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 2049), m, replace=False), rng.integers(1, most, m))} for m, most in ((2048, 10**9), (2048, 3), (40, 10**6), (300, 50))]
    for histogram in cases:
        placed, total = packing.place(histogram), sum(k * n for k, n in histogram.items())
        assert sum(p.taken * p.count for p in placed) == total and len(placed) < 60_000
        assert max([p.first + p.count for p in placed], default=0) == -(-total // 2048)
        held = defaultdict(int)
        for p in placed:  # ranges of sequences, as differences
            held[p.first] += p.taken
            held[p.first + p.count] -= p.taken
        assert max(np.cumsum([held[k] for k in sorted(held)]), default=0) <= 2048
        own = packing.by_rank(placed)
        for length, n in histogram.items():
            edges, parts = own.get(length, ([], []))
            assert all(sum(p.taken for p in x) == length for x in parts) and (not n or edges[0] == 0)


ROWS = "vec_id long, label int, embedding array<float>"


def mined_brute(rows):
    kept = []
    for i, lab, v in rows:
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in w) < hard_negatives.MAX_NORM:
            kept.append((i, lab, w))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, lab, v) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, b) for k, (j, b, w) in enumerate(kept) if k != a]
        for s, j, _ in sorted((r for r in scored if r[2] == lab), key=key)[:5]:
            found = sorted((r for r in scored if r[2] != lab and 30 * s <= 100 * r[0] <= 90 * s), key=key)[:10]
            out += [(i, j, n, r[1], s, r[0]) for n, r in enumerate(found, 1)]
    return Counter(out)


def mined(spark, rows):
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, ROWS).withColumns({"row": F.lit("clash"), "v": F.lit(1), "leaf": F.lit("x")}), F.col("vec_id") % 100 == 0)
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.mark.parametrize("block", [40, 4096])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 4)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 6))
    rows = [(k, int(rng.integers(0, 4)), (centers[k % 12] + rng.normal(size=6) * 0.3).tolist()) for k in range(400)]
    rows += [(5000 + k % 7, k % 3, [1.0, 2.0, 0.5]) for k in range(150)]  # one vector in many rows, shorter than the others, with ids that repeat
    rows += [(100, 2, rows[100][2]), (None, 1, [0.1] * 6), (600, None, [0.1] * 6), (700, 1, None), (800, 1, [0.1, None]), (900, 1, [float("nan")]), (1000, 1, [float("inf")]), (1100, 1, []), (1200, 1, [0.0] * 6), (-300, 3, [-1.0] * 6), (1300, 1, [3e38] * 6)]
    got, want = mined(spark, rows), mined_brute(rows)
    assert got == want and len(want) > 200


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, []) == Counter() and mined(spark, [(0, 1, [1.0])]) == Counter() and mined(spark, [(0, 1, None)]) == Counter()
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, [0.95])]) == Counter([(0, 1, 1, 2, 65536, 32768)])
    large = [(k, k % 2, [40_000.0 + k, 0.5 * k]) for k in range(0, 60, 3)]
    assert mined(spark, large) == mined_brute(large)


def test_bounds_of_trees_hold():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(700, 5)) * 40)
    x[:200] = x[0]
    q = np.floor(rng.normal(size=(30, 5)) * 60)
    tree = vantage.grow(x, (x * x).sum(1).max(), 16)
    assert sorted(np.concatenate(tree.members)) == list(range(700)) and max(map(len, tree.members)) <= 16
    most, least = tree.score_bounds(q)
    scores = q @ x.T
    for leaf, rows in enumerate(tree.members):
        assert (scores[:, rows].max(1) <= most[:, leaf]).all() and (scores[:, rows].min(1) >= least[:, leaf]).all()
    assert (most < np.sqrt((q * q).sum(1) * tree.most)[:, None]).any()
    dealt = vantage.grow(x[::3], (x * x).sum(1).max(), 40, closed=False)
    leaf = dealt.leaf_of(x)
    most, least = dealt.score_bounds(q)
    assert (scores <= most[:, leaf]).all() and (scores >= least[:, leaf]).all()
