"""Equal substrings of a bounded set of strings, by intervals of their Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse of non-negative symbols, by prefix doubling; every suffix must come to differ."""
    n, bits = len(symbols), int(symbols.max() + 1).bit_length()
    width = max(1, 62 // bits)  # so many symbols make the first keys
    rank = np.zeros(n, np.int64)
    for k in range(width):
        rank <<= bits
        rank[: n - k] += symbols[k:] + 1
    key = rank
    while True:
        order = np.argsort(key)
        found = key[order]
        new = np.cumsum(found[1:] != found[:-1])
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = new
        if not n > 1 or new[-1] == n - 1 or width >= n:
            return order, rank
        key = rank * (n + 1)
        key[:-width] += rank[width:] + 1
        width *= 2


def smallest_owner(pieces: list[bytes], owner: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece and each of its ``length``-byte substrings: the smallest owner of a piece that holds the substring.

    Pieces end in separators that all differ. Intervals of suffixes that agree
    in their first bytes are extended backwards, breadth first: in round l every
    interval of common prefix l is extended by each byte before it, which gives
    the left bounds of the intervals of l + 1, and so the positions whose common
    prefix with the suffix before is l. Position j of the transform starts the
    extension by its byte if the byte's occurrence before it lies outside j's
    interval; it then never needs a look again. Rounds stop at ``length``: bounds
    still unset have a common prefix of at least that.
    """
    lengths = np.array([len(p) for p in pieces])
    n, count = int(lengths.sum()) + len(pieces), len(pieces)
    ends = np.cumsum(lengths + 1) - 1  # of the separators
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64) + count
    text[ends] = np.arange(count)
    order, rank = suffix_order(text)
    before = order - 1  # -1: the last separator, as in a cycle
    last = rank[before].astype(np.int32)
    symbols = text[before].astype(np.int32)
    by_symbol = np.argsort(symbols, kind="stable")
    symbol = symbols[by_symbol]
    earlier = np.full(n, -1, np.int32)
    same = symbol[1:] == symbol[:-1]
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]

    starting = np.zeros(n, np.int32)  # a left bound's own position, else 0
    left = np.empty(n, np.int32)
    waiting, since, goes = np.arange(n, dtype=np.int32), earlier, last
    bound = np.zeros(n, bool)
    bound[0] = True
    for _ in range(length):
        np.maximum.accumulate(starting, out=left)
        starts = since < left[waiting]
        if starts.any():
            found = goes[starts]
            bound[found] = True
            starting[found] = found
            stay = ~starts
            waiting, since, goes = waiting[stay], since[stay], goes[stay]

    whose = np.repeat(np.arange(count), lengths + 1)
    valid = np.arange(n) + length <= ends[whose]
    held = np.where(valid, owner[whose], np.iinfo(np.int64).max)[order]
    least = np.minimum.reduceat(held, np.flatnonzero(bound))[np.cumsum(bound) - 1][rank]
    first = ends - lengths
    return [least[s : max(s, e - length + 1)] for s, e in zip(first.tolist(), ends.tolist(), strict=True)]
