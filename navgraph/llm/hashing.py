"""Word and shingle hashes of many texts at once, with numpy, for use inside tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: A text is hashed in parts of about so many bytes, so arrays stay small beside it however long it is.
PART = 1 << 18
#: Word hashes that a worker remembers; they are then forgotten all at once.
REMEMBERED = 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def code(data: bytes) -> int:
    """64 bits of a cryptographic hash: no two byte strings that anyone can write down share them by their form."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class Codes(dict):
    """The code of each word, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = code(word)
        return found


def parts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """``text`` cut at gaps between words into parts of about ``size`` bytes."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def word_codes(text: bytes, codes: Codes) -> np.ndarray:
    """The codes of the words of a text."""
    found = [np.array([codes[w] for w in part.split()], np.uint64) for part in parts(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def grouped(texts: Iterable[bytes], limit: int = PART) -> Iterator[list[bytes]]:
    """The texts in groups of about ``limit`` bytes; a longer text is a group of its own."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > limit:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def shingle_sets(texts: Iterable[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (signed) of its ``width``-word shingles, A-Z lower-cased.

    Fewer words count as one shingle; no words: an empty set. Words are coded
    by 64 bits of BLAKE2b, and a shingle by its words' codes and their number.
    """
    codes = Codes()
    for text in texts:
        word = word_codes(text.lower(), codes)
        n = min(len(word), width)
        full = np.zeros(len(word) - n + 1 if n else 0, np.uint64)
        for k in range(n):
            full = mix(full + word[k : k + len(full)] * _U(2 * k + 1))
        yield np.unique(mix(full + _U(n if n < width else 0)).view(np.int64))


def as_bytes(column: pa.Array) -> list[bytes]:
    """An Arrow text column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)]), kind))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows`` rows: what a task makes of one is sent off before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
