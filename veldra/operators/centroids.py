"""Weighted means of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_centroids(df: DataFrame, columns: Sequence[str], weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and the columns' means by weight; rows with a missing value or weight are left out of theirs."""
    w = weight.cast("double")
    mean = lambda c: F.try_divide(F.sum(w * df[c]), F.sum(F.when(df[c].isNotNull(), w))).alias(c)
    return df.groupBy(*by).agg(*[mean(c) for c in columns])
