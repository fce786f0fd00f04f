"""Stability of clusterings: prediction strength of a test clustering under a training one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.operators.centers import Centers

STABLE = 0.8
#: The heads of both files and the format of a line of statistics.
STATS_HEADER = "ID,NumClusters,TestCost,TrainCost,PredStrength,StableClusters,StablePoints"
STATS_LINE = "{ID:d},{NumClusters:d},{TestCost:.2f},{TrainCost:.2f},{PredStrength:.4f},{StableClusters:.2f},{StablePoints:.4f}"
DETAILS_HEADER = "ClusteringId,CenterId,NumPoints,PredictionStrength"


def crosstab(points: DataFrame, test: str, train: str, weight: Column | None = None) -> DataFrame:
    """``test_id``, ``train_id``, ``weight`` summed over points."""
    return points.groupBy(F.col(test).alias("test_id"), F.col(train).alias("train_id")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("weight"))


def prediction_strength(table: DataFrame) -> DataFrame:
    """``test_id``, ``points``, ``strength``: the share of a test cluster's pairs that stay together.

    ``table`` is a cross-tabulation. A cluster of one point or less has strength 1.
    """
    total = F.sum("weight")
    pairs = F.sum(F.col("weight") * (F.col("weight") - 1))
    return table.groupBy("test_id").agg(total.alias("points"), F.when(total > 1, pairs / (total * (total - 1))).otherwise(1.0).alias("strength"))


def stability(details: DataFrame, train_clusters: int) -> DataFrame:
    """One row: ``pred_strength`` (least among clusters of more points than there are training
    clusters, infinite if there is none), ``stable_clusters`` and ``stable_points`` as shares."""
    stable = F.col("strength") > STABLE
    return details.agg(
        F.coalesce(F.min(F.when(F.col("points") > train_clusters, F.col("strength"))), F.lit(float("inf"))).alias("pred_strength"),
        F.avg(stable.cast("double")).alias("stable_clusters"),
        (F.sum(F.when(stable, F.col("points")).otherwise(0.0)) / F.sum("points")).alias("stable_points"),
    )


def evaluate_sketch(test: Centers, train: Centers, x: np.ndarray, w: np.ndarray, name: int = 0) -> tuple[dict, list[tuple]]:
    """Statistics of a test and a training clustering over the test sketch, and a row for each test cluster."""
    a, cost_a = test.closest(x)
    b, cost_b = train.closest(x)
    cross = np.zeros((len(test), len(train)))
    np.add.at(cross, (a, b), w)
    total = cross.sum(1)
    with np.errstate(all="ignore"):
        strength = np.where(total > 1, (cross * (cross - 1)).sum(1) / (total * (total - 1)), 1.0)
    large, stable = total > len(train), strength > STABLE
    stats = {
        "ID": name, "NumClusters": len(test), "TestCost": float((cost_a * w).sum()), "TrainCost": float((cost_b * w).sum()),
        "PredStrength": float(strength[large].min()) if large.any() else float("inf"),
        "StableClusters": float(stable.mean()), "StablePoints": float(total[stable].sum() / total.sum()) if total.sum() else 0.0,
    }
    return stats, [(name, i, float(total[i]), float(strength[i])) for i in range(len(test))]


def stats_csv(rows: list[dict]) -> str:
    out = [STATS_HEADER, *(STATS_LINE.format(**r) for r in rows)]
    return "\n".join(out) + "\n"


def details_csv(rows: list[tuple], header: bool = True) -> str:
    return "".join([DETAILS_HEADER + "\n"] * header + [f"{a},{b},{n:g},{s:.4f}\n" for a, b, n, s in rows])
