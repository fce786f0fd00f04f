"""Joins of a large side with one row per key on the other, without tasks that hold a hot key whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(many: DataFrame, one: DataFrame, on: list[str], spread_by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``one`` (a row per key ``on``): rows of a key go to ``salts`` tasks by hashed
    ``spread_by``, and ``one`` is repeated for each. ``how`` is inner, left, left_semi or left_anti.

    If ``one`` is small at run time, Spark broadcasts it instead, and the salt does no harm.
    """
    left = many.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")
