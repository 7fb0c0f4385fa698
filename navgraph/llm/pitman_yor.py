"""A hierarchical Pitman-Yor model of words: context restaurants, a shared parent, and restaurants of bytes that spell words.

A word is seated in the restaurant of its context, the word before. All of these have one
parent, the restaurant of words without context, whose base distribution spells
a word byte by byte, ended by a blank: bytes after two given ones are seated in
the restaurant of that context, whose parent is the one of the last byte alone,
whose parent is the one without context, whose parent is uniform. Bytes bound
the spelling part: 256**3 cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Discount and strength of the context restaurants, of their parent, and of the bytes' restaurants by length of context.
CONTEXTS = (0.75, 10.0)
WORDS = (0.75, 10.0)
BYTES = ((0.1, 1.0), (0.3, 1.0), (0.5, 1.0))
END = 0x20
#: Sizes of dishes that share an array, one column a table; for larger dishes than the last the number of tables is approximated.
SIZES = (2, 4, 16, 64, 256, 1024)
#: Numbers in such an array, about.
CELLS = 1 << 20


@lru_cache
def ways(discount: float) -> np.ndarray:
    """At [c, t], the log weight of all ways to seat c customers at t tables, new tables weighing 1: generalised Stirling numbers.

    The next customer opens a table, or joins one with weight c - discount * t in all.
    """
    most = SIZES[-1]
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        out[c + 1, t] = np.logaddexp(out[c, t - 1], out[c, t] + np.log(np.maximum(c - discount * t, 1e-9)))
    return out.astype(np.float32)


def seat(count: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """How many tables each dish's customers sit at: a draw given ``opening``, a new table's weight.

    An occupied table of n has weight n - discount. All customers of a dish are
    seated anew together, a block of the Gibbs sampler: t tables have the
    probability in proportion to opening**t times the ``ways`` to seat them,
    where sweeps of single customers would end. For dishes of over SIZES[-1]
    customers the number is binomial about its ``expected`` value.
    """
    tables = np.minimum(count, 1).astype(np.int64)
    log_opening = np.log(np.maximum(opening, 1e-300)).astype(np.float32)
    least = 1
    for most in SIZES:
        some = np.flatnonzero((count > least) & (count <= most))
        for at in range(0, len(some), CELLS // most):
            dish = some[at : at + CELLS // most]
            weight = ways(discount)[count[dish], 1 : most + 1] + log_opening[dish, None] * np.arange(most, dtype=np.float32)
            upto = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            chosen = rng.random(len(dish), np.float32) * upto[:, -1]
            tables[dish] = np.minimum(1 + (upto < chosen[:, None]).sum(axis=1), count[dish])
        least = most
    many = np.flatnonzero(count > least)
    c = count[many]
    mean = expected(c, opening[many], discount)
    tables[many] = 1 + rng.binomial(c - 1, np.minimum(1.0, mean / c))
    return tables


def expected(count: np.ndarray, opening: np.ndarray, discount: float) -> np.ndarray:
    """How many tables a large dish has, about, beside its largest one.

    Without their sum, ``count``, tables are a Poisson number of independent
    sizes, with the generating function 1 - (1 - z)**discount. The z at which
    their sum is ``count`` in the mean is found by halving, in the logarithm of 1 - z.
    """
    low, high = np.full(len(count), -700.0), np.zeros(len(count))
    for _ in range(60):
        x = (low + high) / 2
        more = np.log(np.maximum(opening, 1e-300)) + np.log1p(-np.exp(x)) + (discount - 1) * x > np.log(np.maximum(count, 1))
        low, high = np.where(more, x, low), np.where(more, high, x)
    return -opening / discount * np.expm1(discount * low)


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all words in a row: the cells (two bytes before, one before, the byte), and where each word starts."""
    data = np.frombuffer(b"  " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    start = np.cumsum([2, *(len(w) + 1 for w in words[:-1])])
    second = data[:-2].copy()
    second[start - 2] = END
    return (second << 16) | (data[1:-1] << 8) | data[2:], start - 2


@dataclass
class Spelling:
    """Seated cells of each context length: cell numbers (with their context in the higher bytes), customers, tables."""

    cells: list[np.ndarray]
    customers: list[np.ndarray]
    tables: list[np.ndarray]

    def probabilities(self) -> list[np.ndarray]:
        """P(byte | context) for each context length: arrays of 256, 256**2 and 256**3 cells."""
        out = [np.full(256, 1 / 256, np.float32)]
        for length, (discount, strength) in enumerate(BYTES):
            contexts = 256**length
            own = np.zeros(256 * contexts, np.float32)
            own[self.cells[length]] = self.customers[length] - discount * self.tables[length]
            customers, tables = (np.bincount(self.cells[length] >> 8, v[length], contexts) for v in (self.customers, self.tables))
            share = ((strength + discount * tables) / (strength + customers)).astype(np.float32)
            inherited = np.tile(out[-1].reshape(-1, 256), (max(1, contexts * 256 // len(out[-1])), 1))
            own = own.reshape(contexts, 256) / (strength + customers).astype(np.float32)[:, None]
            out.append((own + share[:, None] * inherited).reshape(-1))
        return out[1:]


def seat_spelling(cells: np.ndarray, customers: np.ndarray, before: Spelling | None, rng: np.random.Generator) -> Spelling:
    """Seat the customers of the longest contexts, then their tables as customers of the shorter ones, up to the root.

    A new table's weight takes the parent's probability and the restaurant's
    number of tables from ``before``, the last draw.
    """
    out = Spelling([], [], [])
    known = before.probabilities() if before else None
    for length in (2, 1, 0):
        discount, strength = BYTES[length]
        parent = cells & (256**length - 1)
        inherited = known[length - 1][parent] if known and length else np.full(len(cells), 1 / 256)
        tables = np.bincount(before.cells[length] >> 8, before.tables[length], 256**length) if before else np.bincount(cells >> 8, minlength=256**length)
        t = seat(customers, (strength + discount * tables[cells >> 8]) * inherited, discount, rng)
        for held, new in ((out.cells, cells), (out.customers, customers), (out.tables, t)):
            held.insert(0, new)
        cells, where = np.unique(parent, return_inverse=True)
        customers = np.bincount(where, t).astype(np.int64)
    return out


@dataclass
class Draw:
    """One draw of what all words share: the spelling, customers and tables of the parent."""

    spelling: Spelling
    customers: int
    tables: int

    def base(self) -> WordBase:
        cells = self.spelling.cells[2]
        return WordBase(cells, np.log(self.spelling.probabilities()[2][cells].astype(np.float64)))

    def shared(self) -> Draw:
        """The draw without its spelling, as tasks need it."""
        return Draw(Spelling([], [], []), self.customers, self.tables)

    def share(self) -> float:
        """The part of the parent's probability that is left to spelling."""
        discount, strength = WORDS
        return (strength + discount * self.tables) / (strength + self.customers)


@dataclass
class WordBase:
    """The log probability that the base distribution spells a word that was learnt, from its cells: each has customers."""

    cells: np.ndarray
    log_cell: np.ndarray

    def __call__(self, spelt: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.log_cell[np.searchsorted(self.cells, spelt)], start) if len(start) else np.zeros(0)
