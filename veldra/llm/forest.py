"""Isolation forest: path lengths over random splits, in numpy, scored inside Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many))


@dataclass
class Forest:
    """Trees in heap order: feature (-1 at leaves), cut, and the path length at leaves.

    Its size depends on ``trees`` and ``sample`` alone, never on the data.
    """

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    norm: float

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 1729) -> Forest:
        rng = np.random.default_rng(seed)
        sample = max(1, min(sample, len(x)))
        depth = int(np.ceil(np.log2(max(sample, 2))))
        nodes = 2 ** (depth + 1) - 1
        feature = np.full((trees, nodes), -1, np.int8)
        cut, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            stack = [(0, 0, x[rng.choice(len(x), sample, replace=False)] if len(x) else np.zeros((0, x.shape[1])))]
            while stack:
                node, d, part = stack.pop()
                spread = np.ptp(part, axis=0) if len(part) else np.zeros(x.shape[1])
                if d == depth or len(part) <= 1 or not spread.any():
                    length[t, node] = d + float(average_path(np.array(len(part))))
                    continue
                f = int(rng.choice(np.flatnonzero(spread)))
                c = rng.uniform(part[:, f].min(), part[:, f].max())
                feature[t, node], cut[t, node] = f, c
                right = part[:, f] > c
                stack += [(2 * node + 1, d + 1, part[~right]), (2 * node + 2, d + 1, part[right])]
        return cls(feature, cut, length, float(max(average_path(np.array(sample)), 1e-9)))

    @classmethod
    def bare(cls, trees: int, depth: int) -> Forest:
        """Trees of a root each, with room down to ``depth``."""
        shape = trees, 2 ** (depth + 1) - 1
        return cls(np.full(shape, -1, np.int8), np.zeros(shape), np.zeros(shape), 1.0)

    def ranges(self, x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of a level that rows reach, numbered over all trees, with the number of rows and the least and greatest values."""
        first, width = 2**level - 1, 2**level
        found = []
        for t, (feature, cut) in enumerate(zip(self.feature, self.cut)):
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            for _ in range(level):
                rows, node = rows[feature[node] >= 0], node[feature[node] >= 0]
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            if len(rows):
                order = np.argsort((node - first).astype(np.uint16), kind="stable")
                node, part = node[order], x[rows[order]]
                at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                found.append((t * width + node[at] - first, np.diff(np.r_[at, len(node)]), np.minimum.reduceat(part, at), np.maximum.reduceat(part, at)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, x.shape[1])), np.zeros((0, x.shape[1]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def grow(self, level: int, place: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> bool:
        """Split the nodes of a level, given their ``ranges`` over all rows; whether there were any to split."""
        order = np.argsort(place)
        place, n, low, high = place[order], n[order], low[order], high[order]
        tree, node = place // 2**level, place % 2**level + 2**level - 1
        draws = rng.random((len(place), 2))
        spread = high > low
        split = spread.any(1) & (2 * node + 2 < self.feature.shape[1])
        self.length[tree, node] = level + np.where(split, 0, average_path(n))
        tree, node, low, high, spread, draws = (z[split] for z in (tree, node, low, high, spread, draws))
        kth = (draws[:, :1] * spread.sum(1, keepdims=True)).astype(int)
        f = ((np.cumsum(spread, axis=1) == kth + 1) & spread).argmax(1)
        rows = np.arange(len(node))
        self.feature[tree, node] = f
        self.cut[tree, node] = low[rows, f] + draws[:, 1] * (high - low)[rows, f]
        self.length[tree, 2 * node + 1] = self.length[tree, 2 * node + 2] = level + 1  # where no row goes
        return bool(len(node))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)
