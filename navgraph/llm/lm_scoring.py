"""Operator 6: texts scored by a hierarchical Pitman-Yor language model, in which each word is drawn in the context of the word before.

Words are known by 64 bits of BLAKE2b. Rows of the tables between the steps are
packed arrays of one kind, sent to a group: a group of pairs of words (a word
and the one before), a group of words (a word's home), or a block of documents.
Spark deals, groups and keeps them; the tasks work on a group's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm.arrow import byte_slices
from navgraph.llm.common import discard, documents, materialize, release
from navgraph.llm.hashing import Codes, as_bytes, code, grouped, mix, slices
from navgraph.llm.packed import pack, pack_words, unpack, unpack_words
from navgraph.llm.pitman_yor import CONTEXTS, WORDS, Draw, seat, seat_spelling, spell

#: Draws that are thrown away at first, and draws whose predictive probabilities are averaged.
BURN_IN, DRAWS = 2, 3
#: Pairs lie with their second word, unless it has 1 / FREQUENT of the tokens of the first HEAD documents; then with the first, or by themselves.
FREQUENT, HEAD = 20_000, 1024
#: Words of the first HEAD documents, the most frequent ones, that are sent by number; others are sent by code.
COMMON = (1 << 16) - 1
#: Scores by document and group are sent as whole numbers of so small a part of 1; their sums depend on no order.
PART_OF_1 = 1 << 32
#: Bytes of the texts of a block, about; a longer text is a block of its own.
BLOCK = 1 << 23
#: Bytes of text for which there is a group of words and one of pairs, about, and the least number of groups.
GROUP, LEAST_GROUPS = 1 << 23, 8

#: A block's documents, its pairs with the documents that have them, and its words; a group's words with what never changes, all its pairs, where blocks ask for them, the words it asks for.
BLOCKS, ASKED, SPELT, HOME, PAIRS, ASKING, ALL = range(7)
#: Pairs that occur twice or more; tables by word sent home and the answers; a draw's sums; sums over kept draws; the last answers, and scores by block.
ACTIVE, PART, ANSWER, SUMS, SEATS, LEVEL, LEFT, LAST, SCORES = range(7, 16)
#: Columns of packed arrays; ``data`` has packed words, ``ids`` and ``n`` are what Spark sums up or has nulls.
PACKED = "abijklxyd"
ROW = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("src", pa.int64())] + [(c, pa.binary()) for c in (*PACKED, "data")] + [(c, pa.list_(pa.int64())) for c in ("ids", "n")] + [("left", pa.float64())])
ROW_DDL = "to long, kind int, src long, " + ", ".join(f"{c} binary" for c in (*PACKED, "data")) + ", ids array<long>, n array<long>, left double"
RATED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from: crc32 of the id as text, modulo 10, is 0; rows without id count as learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


class Numbered(dict):
    """Words by number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def tokens(texts: list[bytes], number: Numbered) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts: numbers of the A-Z lower-cased words, each text's followed by an end (the empty word, which must be 0); of the words before, an end before a text's first; tokens by text."""
    found, sizes = [], []
    for group in grouped(texts):
        words = []
        for t in group:
            at = len(words)
            words += t.lower().split()
            words.append(b"")
            sizes.append(len(words) - at)
        found.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    word = np.concatenate([*found, np.empty(0, np.int64)])
    return word, np.concatenate([[0], word])[:-1], np.array(sizes, np.int64)


def home(codes: np.ndarray, groups: int) -> np.ndarray:
    """The group of each word."""
    return (codes.view(np.uint64) % np.uint64(groups)).astype(np.int64)


def pair_codes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before.view(np.uint64)) + word.view(np.uint64))


def cut(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Consecutive parts of these sizes."""
    ends = np.cumsum(sizes)
    return [values[end - size : end] for end, size in zip(ends.tolist(), np.asarray(sizes).tolist(), strict=True)]


def rows(kind: int, to: object, sizes: object = None, **columns: object) -> pa.RecordBatch:
    """Rows of one kind. Arrays are cut into parts of ``sizes`` (default: one row has all) and packed; lists have each row's arrays, or what is packed."""
    to = np.asarray(to, np.int64)
    out = {"to": pa.array(to), "kind": pa.array(np.full(len(to), kind, np.int32))}
    for c, values in columns.items():
        if c == "src":
            out[c] = pa.array(np.broadcast_to(np.asarray(values, np.int64), len(to)))
        elif c in PACKED:
            parts = values if isinstance(values, list) else [values] if sizes is None else cut(values, sizes)
            out[c] = pa.array([x if isinstance(x, bytes) else pack(x) for x in parts], pa.binary())
        else:
            out[c] = pa.array(values, ROW.field(c).type)
    return pa.RecordBatch.from_arrays([out[c] if c in out else pa.nulls(len(to), ROW.field(c).type) for c in ROW.names], schema=ROW)


def pick(group: pa.Table, kind: int) -> pa.Table:
    """A group's rows of a kind, by sender."""
    some = group.filter(pc.equal(group["kind"], kind))
    return some.take(pc.sort_indices(some["src"])).combine_chunks() if len(some) > 1 else some.combine_chunks()


def flat(part: pa.Table, column: str) -> np.ndarray:
    """All values of a column's arrays."""
    found = [unpack(x) for x in part[column].to_pylist()]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def names_of(part: pa.Table) -> list[bytes]:
    """Words of all rows."""
    return [x for data in part["data"].to_pylist() for x in unpack_words(data)]


def lengths(part: pa.Table, column: str) -> np.ndarray:
    return np.array([len(unpack(x)) for x in part[column].to_pylist()], np.int64)


def stage(*tables: DataFrame, work: object, schema: str = ROW_DDL) -> DataFrame:
    """What ``work`` makes of the rows of each group; rows that it makes go to other groups."""
    all_rows = tables[0]
    for t in tables[1:]:
        all_rows = all_rows.unionByName(t)
    return all_rows.groupBy("to").applyInArrow(work, schema)


def table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches, ROW)


def of_kind(df: DataFrame, *kinds: int) -> DataFrame:
    return df.filter(F.col("kind").isin(*kinds))


def frequent_codes(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of the first HEAD documents: codes of the most frequent words, which are sent by their number; those of them, sorted, that are so frequent that it says where pairs are worked on. Neither changes a count."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, codes = Numbered({b"": 0}), np.zeros(0, np.int64), Codes()
        for batch in batches:
            word, _, _ = tokens(as_bytes(batch["text"]), number)
            more = np.bincount(word, minlength=len(number))
            more[: len(n)] += n
            n = more
        names, first = list(number), np.argsort(-n, kind="stable")[:COMMON]
        found = np.array([codes[names[w]] for w in first], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[first] * FREQUENT >= max(n.sum(), 1))], ["code", "often"])

    found = docs.select("text").limit(HEAD).coalesce(1).mapInArrow(counted, "code long, often boolean").toPandas()
    codes = found["code"].to_numpy().astype(np.int64)
    return codes, np.sort(codes[found["often"].to_numpy().astype(bool)])


def spread(docs: DataFrame, common: np.ndarray, often: np.ndarray, groups: int) -> DataFrame:
    """Blocks of documents (doc_id, text, held_out): their pairs, with the documents that each occurs in, and their words, sent to their groups.

    A block's pairs are sorted by their second words' codes, then by their first
    ones'. Second words are sent as runs, first ones by their number in ``common`` if they are there.
    """
    by_code = np.argsort(common)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.Array, np.ndarray]]:
        for batch in byte_slices(batches, "text", BLOCK):
            for part in slices([batch], 1 << 14):
                yield as_bytes(part["text"]), part["doc_id"], part["held_out"].to_numpy(zero_copy_only=False)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, codes = groups + (TaskContext.get().partitionId() << 32), Codes()
        for texts, doc_id, held in blocks(batches):
            number = Numbered({b"": 0})
            word, before, sizes = tokens(texts, number)
            names = list(number)
            code = np.array([codes[x] for x in names], np.uint64).view(np.int64)
            sort = np.argsort(code)
            rank = np.empty(len(sort), np.int64)
            rank[sort] = np.arange(len(sort))
            code, word = code[sort], rank[word]
            learnt = np.repeat(~held, sizes)
            pairs, where = np.unique((word << 32) | rank[before], return_inverse=True)
            word, where = word.astype(np.int32), where.astype(np.int32)
            w, u = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
            del before, pairs
            hot, at = np.isin(code, often), home(code, groups)
            to = np.where(~hot[w], at[w], np.where(~hot[u], at[u], (pair_codes(code[u], code[w]) % np.uint64(groups)).astype(np.int64)))
            order = np.argsort(to.astype(np.uint16) if groups <= 1 << 16 else to, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            yield rows(BLOCKS, [block], ids=[doc_id.cast(pa.int64()).to_pylist()], b=sizes, j=held)
            whose = np.repeat(np.arange(len(texts), dtype=np.uint16), sizes)[np.argsort(place[where], kind="stable")]  # the documents of each pair
            to, w, u = to[order], w[order], u[order]
            some, sizes = np.unique(to, return_counts=True)

            def shared(of: np.ndarray, to: np.ndarray = to, some: np.ndarray = some) -> np.ndarray:
                """How many of these places each group gets."""
                return np.bincount(to[of], minlength=some[-1] + 1)[some]

            n = np.bincount(where, minlength=len(order))[order]
            held_n = n - np.bincount(where, learnt, len(order))[order].astype(np.int64)
            del place, where, order
            docs_n = np.add.reduceat(n, np.cumsum(np.append(0, sizes[:-1])))
            head = np.flatnonzero((np.diff(w, prepend=-1) != 0) | (np.diff(to, prepend=-1) != 0))
            near, known = find(common[by_code], code)
            numbers = np.where(known, by_code[near], len(common))[u] if len(common) else np.zeros(len(u), np.int64)
            rare = np.flatnonzero(numbers == len(common))
            yield rows(
                ASKED, some, sizes, src=block, a=cut(code[u[rare]], shared(rare)), i=numbers, b=cut(code[w[head]], shared(head)), j=cut(np.diff(head, append=len(w)), shared(head)), k=n, l=held_n, d=cut(whose, docs_n)
            )
            c = np.bincount(word, learnt, len(names)).astype(np.int64)
            known = np.flatnonzero(c)
            known = known[np.argsort(at[known], kind="stable")]
            some, sizes = np.unique(at[known], return_counts=True)
            yield rows(SPELT, some, sizes, src=block, i=c[known], data=[pack_words([names[w] for w in part]) for part in cut(sort[known], sizes)])
            block += 1

    return docs.select("doc_id", "text", "held_out").mapInArrow(sent, ROW_DDL)


def gather(sent: DataFrame, common: np.ndarray, groups: int) -> DataFrame:
    """Each group's words and pairs once, with their counts (0: in held-out documents only)."""

    def asked_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of these words, which lie by home, each home gets, and these homes."""
        return np.unique(home(codes, groups), return_counts=True)

    def gathered(group: pa.Table) -> pa.Table:
        g = group["to"][0].as_py()
        if g >= groups:
            return group.select(ROW.names)
        out, asked, spelt = [], pick(group, ASKED), pick(group, SPELT)
        if len(spelt):
            number = Numbered()
            where = np.fromiter(map(number.__getitem__, names_of(spelt)), np.int64)
            names, n = list(number), np.bincount(where, flat(spelt, "i")).astype(np.int64)
            codes = np.array([code(x) for x in names], np.uint64).view(np.int64)
            sort = np.argsort(codes)
            out.append(rows(SPELT, [g], a=codes[sort], b=n[sort], data=[pack_words([names[k] for k in sort])]))
        if len(asked):
            numbers, times = flat(asked, "i"), flat(asked, "k")
            before = np.append(common, 0)[numbers]
            before[numbers == len(common)] = flat(asked, "a")
            us, u = np.unique(before, return_inverse=True)
            ws, w = np.unique(flat(asked, "b"), return_inverse=True)
            pairs, where = np.unique((np.repeat(w, flat(asked, "j")) << 32) | u, return_inverse=True)
            c = np.bincount(where, times - flat(asked, "l")).astype(np.int64)
            codes = np.unique(np.concatenate([us, ws]))
            sort = np.argsort(home(codes, groups), kind="stable")
            place = np.empty(len(sort), np.int64)
            place[sort] = np.arange(len(sort))
            u, w = place[np.searchsorted(codes, us)][pairs & 0xFFFFFFFF], place[np.searchsorted(codes, ws)][pairs >> 32]
            codes, once = codes[sort], c == 1
            some, sizes = asked_words(codes)
            once_in, once_of = (np.bincount(x[once], minlength=len(codes)) for x in (u, w))
            out.append(rows(ALL, some, sizes, src=g, a=codes, i=once_in, j=once_of))
            out.append(rows(PAIRS, [g], i=u, j=w, k=c))
            out.append(rows(ASKING, np.full(len(asked), g), lengths(asked, "k"), src=asked["src"].to_numpy(), i=where, k=asked["k"].to_pylist(), d=asked["d"].to_pylist()))
            more = c > 1
            if more.any():
                used, at = np.unique(np.concatenate([u[more], w[more]]), return_inverse=True)
                out.append(rows(ACTIVE, [g], a=codes[used], i=at[: len(at) // 2], j=at[len(at) // 2 :], k=c[more]))
        return table(out)

    return materialize(stage(sent, work=gathered), "lm-pairs", by=["kind"])


def at_home(model: DataFrame) -> DataFrame:
    """Each group's words: counts, and in how many pairs that occur once they come first and second: these always sit at one table."""

    def homes(group: pa.Table) -> pa.Table:
        spelt, asked = pick(group, SPELT), pick(group, ALL)
        if not len(spelt):
            return table([])
        codes = flat(spelt, "a")
        place, known = find(codes, flat(asked, "a"))
        once = [np.bincount(place[known], flat(asked, c)[known], len(codes)) for c in "ij"]
        n = flat(spelt, "b")
        return table([rows(HOME, group["to"][:1], a=codes, b=n, i=once[0].astype(np.int64), j=once[1].astype(np.int64), data=spelt["data"].to_pylist(), n=[[len(n), int(n.sum())]])])

    return materialize(stage(of_kind(model, SPELT, ALL), work=homes), "lm-words")


def find(codes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked word lies among sorted codes, and whether it does."""
    place = np.minimum(np.searchsorted(codes, asked), max(len(codes) - 1, 0))
    return place, codes[place] == asked if len(codes) else np.zeros(len(asked), bool)


def seated(model: DataFrame, words: DataFrame, last: DataFrame | None, draw: Draw | None, total: int, groups: int, number: int, seed: int, keep: bool, answer: bool) -> DataFrame:
    """One round of the sampler: pairs are seated given the last round's answers (tables of the context, the word's probability), then words given their customers.

    Only pairs that occur twice or more are sent and drawn. With ``keep``, sums
    over kept rounds go on; without ``answer`` nobody is told of the outcome.
    """
    base, shared = (draw.base(), draw.shared()) if draw else (None, None)

    def seat_pairs(group: pa.Table) -> pa.Table:
        pairs = pick(group, ACTIVE)
        if not len(pairs):
            return table([])
        g, codes, count = group["to"][0].as_py(), flat(pairs, "a"), flat(pairs, "k")
        context, word = flat(pairs, "i"), flat(pairs, "j")
        t = np.ones(len(count), np.int64)
        told, before = pick(group, ANSWER), pick(group, SEATS)
        if len(told):
            discount, strength = CONTEXTS
            tables, p = flat(told, "i"), flat(told, "y")
            t = seat(count, (strength + discount * tables[context]) * p[word], discount, np.random.default_rng([seed, number, g]))
        sizes = np.bincount(home(codes, groups), minlength=groups)
        some = np.flatnonzero(sizes)
        out = [rows(PART, some, sizes[some], src=g, a=codes, i=np.bincount(context, t, len(codes)).astype(np.int64), j=np.bincount(word, t, len(codes)).astype(np.int64))]
        if keep:
            out.append(rows(SEATS, [g], i=t + flat(before, "i") if len(before) else t))
        return table(out)

    def seat_words(group: pa.Table) -> pa.Table:
        own, parts, before = (pick(group, k) for k in (HOME, PART, LEVEL))
        g, out = group["to"][0].as_py(), [b for b in group.filter(pc.equal(group["kind"], SEATS)).select(ROW.names).to_batches()]
        if not len(own):
            return table(out)
        codes, asked = flat(own, "a"), flat(parts, "a")
        place, _ = find(codes, asked)
        tables, customers = ((flat(own, c) + np.bincount(place, flat(parts, c), len(codes))).astype(np.int64) for c in "ij")
        cells, start = spell(names_of(own))
        if shared is None:
            t0, p = np.minimum(customers, 1), flat(own, "b") / total
        else:
            discount, strength = WORDS
            spelt = np.exp(np.maximum(base(cells, start), -600.0))
            opening = (strength + discount * shared.tables) * spelt
            t0 = seat(customers, opening, discount, np.random.default_rng([seed, number, g, 1]))
            p = (customers - discount * t0 + opening) / (strength + shared.customers)
        found, where = np.unique(cells, return_inverse=True)
        sums = np.bincount(where, np.repeat(t0, np.diff(np.append(start, len(cells)))))
        out.append(rows(SUMS, [g], ids=[np.concatenate([found, [-1, -2]])], n=[np.concatenate([sums, [customers.sum(), t0.sum()]]).astype(np.int64)]))
        if answer and len(parts):
            out.append(rows(ANSWER, parts["src"].to_numpy(), lengths(parts, "a"), src=g, i=tables[place], y=p[place]))
        if keep:
            sums = [tables, p] if not len(before) else [tables + flat(before, "x"), p + flat(before, "y")]
            out += [rows(LEVEL, [g], x=sums[0], y=sums[1]), rows(LEFT, [g], left=[spelt.sum()])]
        return table(out)

    pairs = [of_kind(model, ACTIVE), *([of_kind(last, ANSWER, SEATS)] if last else [])]
    told = [words, stage(*pairs, work=seat_pairs), *([of_kind(last, LEVEL)] if last else [])]
    return materialize(stage(*told, work=seat_words), "lm-draw", by=["kind"])


def sample(model: DataFrame, words: DataFrame, total: int, groups: int, seed: int, burn_in: int = BURN_IN, draws: int = DRAWS) -> tuple[DataFrame, float]:
    """The last of ``burn_in`` + ``draws`` rounds, with sums over the last ``draws``; what these leave to words that aren't known.

    Each round's cells of spelling are summed up by Spark and come to the
    driver, 256**3 at most for any corpus; it seats the spelling. ``burn_in`` is 1 at least.
    """
    rng, draw, last, unknown = np.random.default_rng(seed), None, None, 0.0
    for number in range(burn_in + draws):
        keep = number >= burn_in
        now = seated(model, words, last, draw, total, groups, number, seed, keep, number < burn_in + draws - 1)
        if last:
            discard(last)
        if keep:
            spelt = of_kind(now, LEFT).agg(F.sum("left")).first()[0] or 0.0
            unknown += draw.share() * max(1.0 - spelt, 0.0) / draws
        cells = of_kind(now, SUMS).select(F.explode(F.arrays_zip("ids", "n")).alias("s")).groupBy(F.col("s.ids").alias("cell")).agg(F.sum("s.n").alias("n")).toPandas().sort_values("cell")
        cell, n = cells["cell"].to_numpy(), cells["n"].to_numpy()
        known = dict(zip(cell[cell < 0].tolist(), n[cell < 0].tolist(), strict=True))
        spelling = seat_spelling(cell[cell >= 0], n[cell >= 0], draw.spelling if draw else None, rng)
        draw, last = Draw(spelling, known.get(-1, 0), known.get(-2, 0)), now
        release(model.sparkSession)
    return last, unknown


def rate(model: DataFrame, words: DataFrame, last: DataFrame, unknown: float, draws: int, total: int, distinct: int, groups: int) -> DataFrame:
    """Each document's sums over its tokens."""
    discount, strength = CONTEXTS

    def answer(group: pa.Table) -> pa.Table:
        own, level, asked = (pick(group, k) for k in (HOME, LEVEL, ALL))
        if not len(asked):
            return table([])
        c, tables, p = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, max(unknown, 1e-300))  # of words that aren't known
        codes = flat(own, "a") if len(own) else np.empty(0, np.int64)
        if len(own):
            c, tables, p = np.append(flat(own, "b"), c), np.append(flat(level, "x"), tables), np.append(flat(level, "y") / draws, p)
        place, known = find(codes, flat(asked, "a"))
        place = np.where(known, place, len(codes))
        return table([rows(LAST, asked["src"].to_numpy(), lengths(asked, "a"), src=group["to"][0].as_py(), i=tables[place], j=c[place], y=p[place])])

    def score(group: pa.Table) -> pa.Table:
        pairs, asking, seats, told = (pick(group, k) for k in (PAIRS, ASKING, SEATS, LAST))
        if not len(pairs):
            return table([])
        context, word, count = flat(pairs, "i"), flat(pairs, "j"), flat(pairs, "k")
        tables = np.minimum(count, 1).astype(np.float64)
        tables[count > 1] = flat(seats, "i") / draws
        n, p = flat(told, "j"), flat(told, "y")
        share = (strength + discount * flat(told, "i") / draws) / (strength + n)
        own = np.log10((count - discount * tables) / (strength + n[context]) + share[context] * p[word])
        base = np.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))
        out = []
        for src, where, times, docs in zip(*(asking[c].to_pylist() for c in ("src", "i", "k", "d")), strict=True):
            where, times, docs = unpack(where), unpack(times), unpack(docs)
            some, at = np.flatnonzero(np.bincount(docs)), word[where]
            known, base_sum, own_sum = (np.bincount(docs, np.repeat(x, times))[some] for x in (n[at] > 0, base[at], own[where]))
            base_sum, own_sum = (np.rint(x * PART_OF_1).astype(np.int64) for x in (base_sum, own_sum))
            out.append(rows(SCORES, [src], src=group["to"][0].as_py(), i=some, j=known.astype(np.int64), x=base_sum, y=own_sum))
        return table(out)

    def add_up(group: pa.Table) -> pa.Table:
        docs, scores = pick(group, BLOCKS), pick(group, SCORES)
        sizes, at = flat(docs, "b"), flat(scores, "i")
        known, base, own = (np.bincount(at, flat(scores, c), len(sizes)) for c in "jxy")
        held = pa.array(flat(docs, "j") > 0)
        return pa.table([pc.list_flatten(docs["ids"]).combine_chunks(), held, pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base / PART_OF_1), pa.array(own / PART_OF_1)], RATED_DDL.replace(",", "").split()[::2])

    answers = stage(words, of_kind(last, LEVEL), of_kind(model, ALL), work=answer)
    scores = stage(of_kind(model, PAIRS, ASKING), of_kind(last, SEATS), answers, work=score)
    return stage(of_kind(model, BLOCKS), scores, work=add_up, schema=RATED_DDL)


def score_texts(docs: DataFrame, held: Column, seed: int = 6) -> DataFrame:
    """Each document's log10 probability: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` has doc_id and text. The model is learnt from the rows for which
    ``held`` is false. Tokens are A-Z lower-cased words, and one end for each
    text: null and empty texts are one token. base_score adds up smoothed
    relative counts, score the model's averaged predictive probabilities of each
    word in its context, the word before (an end before a text's first). As in
    base_score, all words that are not known are one event: their probability
    is what spelling leaves them. Equal texts get equal scores.

    Texts are cut into words once. Blocks of documents send each pair of theirs,
    with the documents it occurs in, to the pair's group, and get back sums by document.
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    groups = max(LEAST_GROUPS, (columns.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP)
    common, often = frequent_codes(columns)
    release(docs.sparkSession)
    model = gather(spread(columns, common, often, groups), common, groups)
    release(docs.sparkSession)
    words = at_home(model)
    known = words.agg(F.sum(F.col("n")[0]), F.sum(F.col("n")[1])).first()
    distinct, total = known[0] or 0, known[1] or 0
    last, unknown = sample(model, words, total, groups, seed)
    rated = rate(model, words, last, unknown, DRAWS, total, distinct, groups)
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_texts(docs, held_out(F.col("doc_id")))
