"""The whole way from a table to assigned clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from veldra.operators.assign import assign
from veldra.operators.centers import Centers
from veldra.operators.kmeans_local import grid, select_best
from veldra.operators.kmeans_parallel import sketch
from veldra.operators.normalize import normalize
from veldra.operators.summary import Summary, summarize


def sketch_arrays(points: DataFrame, folds: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A sketch's vectors and weights on the driver; its size is that of the sketch's parameters."""
    rows = points.where(points.fold.isin(folds)) if folds is not None else points
    got = rows.orderBy("fold", "point_id").collect()
    return np.array([r.features for r in got], float), np.array([r.weight for r in got], float)


def cluster_table(df: DataFrame, id_column: str, k: int, ignored: list[str] = (), transform: str = "z", rounds: int = 3, per_round: int = 50, best_of: int = 3, seed: int = 1729) -> tuple[Summary, Centers, DataFrame]:
    """Profile, normalize, sketch, cluster and assign: the summary, the centers, the assignment."""
    summary = summarize(df, ignored=[id_column, *ignored])
    vectors = normalize(df, summary, id_column, transform)
    x, w = sketch_arrays(sketch(vectors, rounds, per_round, 1, seed=seed))
    runs = grid(x, w, [k], best_of, seed)
    best = runs[select_best(runs, x, w)]
    return summary, best, assign(vectors, {0: best})
