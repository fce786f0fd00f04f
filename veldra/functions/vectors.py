"""Feature vectors as array<double> columns: making, converting, keys and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of(*values: float) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dense(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def sparse(size: int, entries: dict[int, float]) -> Column:
    """A vector from its non-zero entries."""
    return F.array(*[F.lit(float(entries.get(i, 0.0))) for i in range(size)])


def from_columns(df: DataFrame, columns: list[str]) -> Column:
    return F.array(*[df[c].try_cast("double") for c in columns])


def to_columns(df: DataFrame, features: str, size: int) -> DataFrame:
    """The vector's elements as columns c0 ... beside the other columns."""
    rest = [c for c in df.columns if c != features]
    return df.select(*rest, *[F.get(F.col(features), i).alias(f"c{i}") for i in range(size)])


def to_storage(features: Column, id: Column | None = None, as_sparse: bool = False) -> Column:
    """size, values, indices, id; dense unless there are fewer values than elements."""
    size = F.size(features).alias("size")
    name = (id.cast("string") if id is not None else F.lit("")).alias("id")
    if not as_sparse:
        return F.struct(size, features.alias("values"), F.array().cast("array<int>").alias("indices"), name)
    at = F.filter(F.sequence(F.lit(0), F.size(features) - 1), lambda i: F.get(features, i) != 0)
    return F.struct(size, F.transform(at, lambda i: F.get(features, i)).alias("values"), at.alias("indices"), name)


def from_storage(v: Column) -> Column:
    """array<double> of the storage form: between one non-zero element and the next lie zeros."""
    held = F.array_sort(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("x")))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    before = lambda k: F.when(k > 0, F.get(held, k - 1)["i"]).otherwise(-1)
    pieces = F.transform(held, lambda c, k: F.concat(zeros(c["i"] - before(k) - 1), F.array(c["x"])))
    last = F.coalesce(F.get(held, F.size(held) - 1)["i"], F.lit(-1))
    full = F.concat(F.flatten(pieces), zeros(v["size"] - last - 1))
    return F.when(F.size(v["values"]) == v["size"], v["values"]).otherwise(full)


def long_key(id: Column) -> Column:
    """The id as bigint, 0 for vectors without one."""
    return F.coalesce(id.try_cast("bigint"), F.lit(0).cast("bigint"))


def int_key(id: Column) -> Column:
    return F.coalesce(id.try_cast("int"), F.lit(0))


def text_key(id: Column) -> Column:
    return F.coalesce(id.cast("string"), F.lit(""))


def svmlight(features: Column, id: Column | None = None) -> Column:
    """``[id ]index:value ...`` of the non-zero elements, counted from 0."""
    cells = F.transform(features, lambda x, i: F.when(x != 0, F.concat_ws(":", i.cast("string"), x.cast("string"))))
    text = F.array_join(cells, " ")
    return text if id is None else F.concat_ws(" ", id.cast("string"), F.when(text != "", text))
