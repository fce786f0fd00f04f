"""Scalar transforms of numeric columns by their summary, and one-hot cells of categorical ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldra.operators.summary import Numeric

Transform = Callable[[Column, Numeric], Column]


def bound(x: Column, s: Numeric) -> Column:
    """x held within the summary's range; every transform starts with it."""
    return F.least(F.lit(s.max), F.greatest(F.lit(s.min), x))


def z(x: Column, s: Numeric) -> Column:
    return (bound(x, s) - s.mean) / s.std_dev if s.std_dev else bound(x, s)


def linear(x: Column, s: Numeric) -> Column:
    return (bound(x, s) - s.min) / (s.max - s.min) if s.max != s.min else bound(x, s)


def log(x: Column, s: Numeric) -> Column:
    b = bound(x, s)
    return F.when(b <= 0, 0.0).otherwise(F.log1p(b))


TRANSFORMS: dict[str, Transform] = {"none": bound, "z": z, "linear": linear, "log": log}


def transform_named(name: str | Transform) -> Transform:
    """A transform by name in any case; a function of (column, numeric summary) passes through."""
    if callable(name):
        return name
    if name.lower() not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}; there are {', '.join(TRANSFORMS)}")
    return TRANSFORMS[name.lower()]


def one_hot(x: Column, levels: list[str], cell: float = 1.0) -> Column:
    """An array with ``cell`` at the level's place; all zero for other values."""
    at = level_index(x, levels)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.when(at.isNull(), zeros(len(levels))).otherwise(F.concat(zeros(at), F.array(F.lit(float(cell))), zeros(F.lit(len(levels) - 1) - at)))


def level_index(x: Column, levels: list[str]) -> Column:
    """Place of a level from 0; null for unknown values."""
    at = F.array_position(F.lit(list(levels)), x)
    return F.when(at > 0, (at - 1).cast("int"))


def scale_vector(features: Column, factors: list[float]) -> Column:
    """Element-wise product."""
    return F.zip_with(features, F.array(*[F.lit(float(f)) for f in factors]), lambda a, b: a * b)
