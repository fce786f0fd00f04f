"""Clusterings: ordered, distinct centers, and an index that finds the nearest of each clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "clustering_id int, center_id int, center array<double>"


class Centers:
    """One clustering. Equal centers count once, in the order of their first place."""

    def __init__(self, points: Sequence[Sequence[float]]):
        seen: dict[tuple, None] = dict.fromkeys(tuple(float(v) + 0.0 for v in p) for p in points)
        if len({len(p) for p in seen}) > 1:
            raise ValueError("centers have one size")
        self.points = np.array(list(seen), float)

    def __len__(self) -> int:
        return len(self.points)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Centers) and set(map(tuple, self.points)) == set(map(tuple, other.points))

    def __hash__(self) -> int:
        return hash(frozenset(map(tuple, self.points)))

    def extended(self, more: Sequence[Sequence[float]]) -> Centers:
        return Centers([*self.points.tolist(), *more])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to every center."""
        x = np.atleast_2d(np.asarray(x, float))
        out = np.empty((len(x), len(self)))
        for k, c in enumerate(self.points):
            d = x - c
            out[:, k] = np.einsum("ij,ij->i", d, d)
        return out

    def closest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the nearest center (the first of equals) and the squared distance."""
        x = np.atleast_2d(np.asarray(x, float))
        if len(self) * self.points.shape[1] > 512:
            rough = (x * x).sum(1)[:, None] + (self.points**2).sum(1) - 2 * x @ self.points.T
            at = rough.argmin(1)
            best = np.take_along_axis(rough, at[:, None], 1)[:, 0]
            # rounding may hide ties: where another center is as near, all distances are taken exactly
            tied = (rough <= (best + 1e-9 * (1 + (x * x).sum(1)))[:, None]).sum(1) > 1
            if tied.any():
                at[tied] = self.distances(x[tied]).argmin(1)
            d = x - self.points[at]
            return at, np.einsum("ij,ij->i", d, d)
        d2 = self.distances(x)
        at = d2.argmin(1)
        return at, d2[np.arange(len(x)), at]

    def squared_difference(self, other: Centers) -> float:
        """Sum of squared distances to another clustering, center by center."""
        if len(self) != len(other):
            raise ValueError("the clusterings differ in size")
        return float(((self.points - other.points) ** 2).sum())


class CentersIndex:
    """Several clusterings; nearest centers exactly, or among the candidates of nearest signatures.

    A signature holds the signs of ``bits`` Gaussian projections. The ``candidates`` centers of
    least Hamming distance, ties by place, are compared exactly.
    """

    def __init__(self, clusterings: Sequence[Centers], bits: int = 128, candidates: int = 32, seed: int = 1729):
        self.clusterings, self.bits, self.candidates = list(clusterings), bits, candidates
        d = next((c.points.shape[1] for c in self.clusterings if len(c)), 0)
        self.directions = np.random.default_rng(seed).standard_normal((d, bits))
        self.signatures = [self.signature(c.points) if len(c) else None for c in self.clusterings]

    def signature(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, float) @ self.directions > 0

    def nearest(self, x: np.ndarray, approx: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each clustering the place of the nearest center and its squared distance."""
        if not approx:
            return [c.closest(x) for c in self.clusterings]
        own = np.where(self.signature(x), np.float32(1), np.float32(-1))
        out = []
        for c, s in zip(self.clusterings, self.signatures):
            if len(c) <= self.candidates:
                out.append(c.closest(x))
                continue
            # products of signs fall as Hamming distances grow; the place decides between equal ones
            rank = (self.bits - own @ np.where(s, np.float32(1), np.float32(-1)).T).astype(np.int64) * len(c) + np.arange(len(c))
            near = np.sort(np.argpartition(rank, self.candidates - 1, axis=1)[:, : self.candidates], axis=1)
            at, d2 = np.empty(len(x), np.int64), np.empty(len(x))
            step = max(1, 4_000_000 // (self.candidates * x.shape[1]))
            for k in range(0, len(x), step):
                d = x[k : k + step, None, :] - c.points[near[k : k + step]]
                some = np.einsum("ijk,ijk->ij", d, d)
                best = some.argmin(1)
                rows = np.arange(len(some))
                at[k : k + step], d2[k : k + step] = near[k : k + step][rows, best], some[rows, best]
            out.append((at, d2))
        return out


def centers_from(df: DataFrame, ids: Sequence[int] | None = None) -> dict[int, Centers]:
    """Clusterings of a centers table (clustering_id, center_id, center) by id; all, or only ``ids``.

    Centers are a model: they come to the driver, and center_id numbers them in order.
    """
    rows = df.where(df.clustering_id.isin(list(ids))) if ids is not None else df
    out: dict[int, list] = {}
    for r in rows.orderBy("clustering_id", "center_id").collect():
        out.setdefault(r.clustering_id, []).append(r.center)
    if ids is not None and (missing := [i for i in ids if i not in out]):
        raise ValueError(f"no clusterings {missing}")
    return {k: Centers(v) for k, v in out.items()}


def centers_table(spark: SparkSession, clusterings: dict[int, Centers]) -> DataFrame:
    rows = [(k, i, p.tolist()) for k, c in clusterings.items() for i, p in enumerate(c.points)]
    return spark.createDataFrame(rows, SCHEMA)
