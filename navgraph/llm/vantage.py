"""Vantage-point trees over vectors that are made equally long, so that nearest means greatest inner product."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Bounds are widened by so much of the greatest squared norm, far more than rounding takes.
SLACK = 1e-9


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one component more, after which all have the squared norm ``most``: their distances from a vector without it fall as the inner products rise."""
    left = np.maximum(most - np.einsum("ij,ij->i", x, x), 0)
    return np.hstack([x, np.sqrt(left)[:, None]])


@dataclass
class Tree:
    """Inner nodes part rows by their distance from a vantage point; leaves know, for each node above them, how near and how far their rows can be."""

    most: float
    points: np.ndarray
    near: np.ndarray
    """The child (a node, or -1 - leaf) for distances up to ``split``; ``far`` for others."""
    far: np.ndarray
    split: np.ndarray
    low: np.ndarray
    """By leaf and node: the least distance of the leaf's rows; 0 where the node isn't above it."""
    high: np.ndarray
    members: list[np.ndarray] = field(default_factory=list)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of rows from all vantage points."""
        return np.sqrt(np.maximum(2 * self.most - 2 * (augmented(x, self.most) @ self.points.T), 0))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        if not len(self.split):
            return np.zeros(len(x), np.int64)
        d, node = self.distances(x), np.zeros(len(x), np.int64)
        while (node >= 0).any():
            at = np.flatnonzero(node >= 0)
            here = node[at]
            node[at] = np.where(d[at, here] <= self.split[here], self.near[here], self.far[here])
        return -1 - node

    def score_bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most and the least inner product that each query (a row) can have with the rows of each leaf, by the triangle inequality."""
        norm = np.einsum("ij,ij->i", q, q)[:, None]
        if not len(self.split):
            bound = np.sqrt(norm * self.most) + 1
            return bound, -bound
        from_point = np.sqrt(np.maximum(norm + self.most - 2 * (q @ self.points[:, :-1].T), 0))
        inner, outer = np.zeros((len(q), len(self.low))), np.full((len(q), len(self.low)), np.inf)
        for node in range(len(self.split)):
            d = from_point[:, node, None]
            below = np.isfinite(self.high[:, node]) | (self.low[:, node] > 0)
            inner[:, below] = np.maximum(inner[:, below], np.maximum(d - self.high[below, node], self.low[below, node] - d))
            outer[:, below] = np.minimum(outer[:, below], d + self.high[below, node])
        slack = SLACK * (self.most + norm) + 1
        reach = np.sqrt(norm * self.most)
        return np.minimum((norm + self.most - inner**2) / 2, reach) + slack, np.maximum((norm + self.most - outer**2) / 2, -reach) - slack


def grow(x: np.ndarray, most: float, leaf_rows: int, closed: bool = True) -> Tree:
    """A tree over rows, whose leaves hold at most ``leaf_rows`` of them.

    A node's vantage point is its row farthest from their mean, and its rows are
    halved by their rank in distance, so equal rows part as well. ``closed``
    bounds a leaf by the rows it has; else by the splits alone, which hold for
    all rows that are sent down the tree later.
    """
    full = augmented(x, most)
    points, near, far, split, members, paths = [], [], [], [], [], []

    def build(rows: np.ndarray, path: list[tuple[int, float, float]]) -> int:
        if len(rows) <= leaf_rows:
            members.append(rows)
            paths.append(path)
            return -len(members)
        own = full[rows]
        point = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
        d = np.sqrt(np.maximum(2 * most - 2 * (own @ point), 0))
        order, half = np.argsort(d, kind="stable"), len(rows) // 2
        node, cut = len(split), float(d[order[half - 1]])
        points.append(point)
        split.append(cut)
        near.append(0)
        far.append(0)
        inside = (float(d[order[0]]), cut) if closed else (0.0, cut)
        outside = (float(d[order[half]]), float(d[order[-1]])) if closed else (cut, np.inf)
        near[node] = build(rows[order[:half]], [*path, (node, *inside)])
        far[node] = build(rows[order[half:]], [*path, (node, *outside)])
        return node

    build(np.arange(len(x)), [])
    low, high = np.zeros((len(members), len(split))), np.full((len(members), len(split)), np.inf)
    for leaf, path in enumerate(paths):
        for node, a, b in path:
            low[leaf, node], high[leaf, node] = a, b
    return Tree(most, np.array(points).reshape(-1, full.shape[1]), np.array(near, np.int64), np.array(far, np.int64), np.array(split), low, high, members)


def nearest_first(tree: Tree, x: np.ndarray, order: np.ndarray, fits, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` rows with the greatest inner product in each window of each query, all if fewer: (query, window, row, score), in no order.

    Rows with equal scores come by ``order`` (their rank among all). ``fits``
    (queries, rows) tells which rows count for which query. ``low`` and ``high``
    (queries x windows, inclusive) are score windows: annuli of distance about a
    query. A query visits leaves from the inside of its annuli outwards, and
    none that lies within or beyond all of them, or beyond the k-th row that
    each window has by then.
    """
    most, least = tree.score_bounds(q)
    # Sums of integers below 2^24 are exact in single precision, which is twice as fast.
    kind = np.float32 if tree.most < 1 << 24 else np.float64
    x, q = x.astype(kind), q.astype(kind)
    reach = np.minimum(most, high.max(1)[:, None])
    turn = np.argsort(-reach, axis=1, kind="stable")
    worst = low.astype(np.float64)
    found = [np.empty(0, np.int64)] * 3 + [np.empty(0)]
    every, windows = np.arange(len(q)), low.shape[1]
    for step in range(turn.shape[1]):
        leaf = turn[:, step]
        wanted = ((most[every, leaf][:, None] >= worst) & (least[every, leaf][:, None] <= high)).any(1)
        new = [found]
        for g in np.unique(leaf[wanted]):
            who, rows = np.flatnonzero(wanted & (leaf == g)), tree.members[g]
            scores = q[who] @ x[rows].T
            fit = fits(who, rows)
            for w in range(windows):
                i, j = np.nonzero(fit & (scores <= high[who, w, None].astype(kind)) & (scores >= worst[who, w, None].astype(kind)))
                new.append([who[i], np.full(len(i), w), rows[j], scores[i, j].astype(np.float64)])
        if len(new) == 1:
            continue
        found = [np.concatenate(c) for c in zip(*new, strict=True)]
        group = found[0] * windows + found[1]
        by = np.lexsort((order[found[2]], -found[3], group))
        group = group[by]
        nth = np.arange(len(by)) - np.searchsorted(group, group)
        found, group, full = [c[by[nth < k]] for c in found], group[nth < k], nth[nth < k] == k - 1
        worst[group[full] // windows, group[full] % windows] = found[3][full]
    return tuple(found)
