"""Samples by hashed uniforms: repeatable, independent of partitioning, bounded before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldra.functions.uniform import hash_uniform, row_uniform


def clean_weight(x: Column, invert: bool = False, default: float = 0.0) -> Column:
    """Null, NaN and non-positive weights are ``default``; 0 is null (to drop); then 1/w if ``invert``."""
    w = F.when(x.isNull() | F.isnan(x) | (x <= 0), float(default)).otherwise(x.cast("double"))
    w = F.when(w != 0, w)
    return 1 / w if invert else w


def _draws(ids: Sequence[str] | None, seed: int | str) -> Column:
    return row_uniform(seed) if ids is None else hash_uniform(seed, *ids)


def numbered(df: DataFrame, name: str = "occurrence") -> DataFrame:
    """A column that numbers the equal rows of each kind from 1, so that all columns together identify a row.

    Equal rows are counted before the shuffle; how many there are of a kind doesn't matter to it.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias(name))
    return counted.withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(name))))


# In the samples ``ids`` are columns that identify a row: the same rows are drawn in every run and any
# partitioning, and rows that share their ids share their draw. Without ids every row as read has a draw of its own.


def uniform_sample(df: DataFrame, size: int, ids: Sequence[str] | None = None, seed: int = 1729) -> DataFrame:
    """``size`` rows without replacement, all rows if there are fewer."""
    return df.withColumn("__u", _draws(ids, seed)).orderBy("__u", *ids or ()).limit(size).drop("__u")


def weighted_sample(df: DataFrame, size: int, ids: Sequence[str] | None, weight: Column, seed: int = 1729) -> DataFrame:
    """The ``size`` rows of greatest log(u) / w; rows without a positive weight are left out."""
    scored = df.withColumn("__w", weight).withColumn("__s", F.log(_draws(ids, seed)) / F.when(F.col("__w") > 0, F.col("__w"))).where("__s is not null")
    return scored.orderBy(F.desc("__s"), *ids or ()).limit(size).drop("__s", "__w")


def grouped_sample(df: DataFrame, size: int, groups: Sequence[str], ids: Sequence[str] | None = None, weight: Column | None = None, seed: int = 1729) -> DataFrame:
    """At most ``size`` rows per group. Each task keeps ``size`` rows of a group before the shuffle,
    so a hot group shuffles no more than that per task."""
    scored = df.withColumn("__w", F.lit(1.0) if weight is None else weight).withColumn("__s", F.log(_draws(ids, seed)) / F.when(F.col("__w") > 0, F.col("__w"))).where("__s is not null")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("__s"), *ids or ()))
    return scored.withColumn("__r", rank).where(F.col("__r") <= size).drop("__r", "__s", "__w")


def bernoulli_sample(df: DataFrame, probability: float, ids: Sequence[str] | None = None, seed: int = 1729) -> DataFrame:
    """Each row with the given probability."""
    if not 0 < probability < 1:
        raise ValueError("the probability lies between 0 and 1")
    return df.withColumn("__u", _draws(ids, seed)).where(F.col("__u") < probability).drop("__u")


def crossfold(df: DataFrame, folds: int, ids: Sequence[str], seed: int = 1729) -> DataFrame:
    """A column ``fold`` from 0, the same for the same ids in every run."""
    return df.withColumn("fold", F.floor(hash_uniform(seed, *ids) * folds).cast("int"))


def shuffle_split(df: DataFrame, splits: int, ids: Sequence[str], seed: int = 1729) -> DataFrame:
    """``split`` and ``shuffle_key``, to sort each split by."""
    return df.withColumn("split", F.floor(hash_uniform(seed, *ids) * splits).cast("int")).withColumn("shuffle_key", hash_uniform(f"{seed}s", *ids))


def shuffled(df: DataFrame, splits: int, ids: Sequence[str], seed: int = 1729) -> DataFrame:
    """Rows laid out by split, each in random order."""
    return shuffle_split(df, splits, ids, seed).repartition(splits, "split").sortWithinPartitions("split", "shuffle_key")


def cv_replicate(df: DataFrame, folds: int, ids: Sequence[str], seed: int = 1729) -> DataFrame:
    """Each row once for every fold but its own (``fold``); ``own_fold`` is the one left out."""
    own = df.withColumn("own_fold", F.floor(hash_uniform(seed, *ids) * folds).cast("int"))
    return own.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("own_fold"))))


def weighted_pick(weights: Sequence[float], size: int, rng: np.random.Generator) -> np.ndarray:
    """Places of ``size`` items without replacement by weight, ascending by score; all if there are fewer."""
    w = np.asarray(weights, float)
    at = np.flatnonzero(w > 0)
    score = np.log(rng.random(len(at))) / w[at]
    return at[np.argsort(score)[-size:] if size else []]


def weighted_draws(weights: Sequence[float], size: int, rng: np.random.Generator) -> np.ndarray:
    """Places of ``size`` items with replacement by weight."""
    upto = np.cumsum(np.asarray(weights, float))
    return np.searchsorted(upto, rng.random(size) * upto[-1], side="right")
