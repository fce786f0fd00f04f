"""Long to wide with one shuffle: conditional aggregates instead of two-step pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.operators.summary import Summary, as_number
from veldra.roles import is_numeric


def pivot_wide(df: DataFrame, keys: Sequence[str], attribute: str, values: Sequence[str], levels: Sequence[str] | Summary, how: str = "sum") -> DataFrame:
    """``keys`` and, for each value column, a double column ``value_level`` for each level in order.

    ``how`` is ``sum`` or ``mean``; missing values are left out. An absent cell is 0.0; a cell
    whose values are all missing is 0.0 for a sum and NaN for a mean. Levels that aren't listed are
    left out, but their keys come out. Null keys form a key.
    """
    if isinstance(levels, Summary):
        stats = levels[attribute]
        if stats.histogram is None:
            raise ValueError(f"{attribute} must be categorical")
        levels = stats.levels
    levels = sorted(levels)
    if len(levels) == 1:
        raise ValueError(f"{attribute} has a single level")
    if bad := [v for v in values if not is_numeric(df.schema[v].dataType)]:
        raise ValueError(f"not numeric: {', '.join(bad)}")
    if how.lower() not in ("sum", "mean"):
        raise ValueError("the aggregation is sum or mean")
    cells = []
    for v in values:
        x = as_number(df, v)
        for level in levels:
            here = df[attribute].cast("string") == level
            total = F.coalesce(F.sum(F.when(here, x)), F.lit(0.0))
            if how.lower() == "mean":
                n, there = F.count(F.when(here, x)), F.count(F.when(here, 1))
                total = F.when(there == 0, 0.0).when(n == 0, F.lit(float("nan"))).otherwise(total / n)
            cells.append(total.alias(f"{v}_{level}"))
    return df.groupBy(*keys).agg(*cells)
