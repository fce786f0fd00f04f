"""Population covariances of vectors, whole or per key, from mergeable co-moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial co-moments of a key merge in this many groups first, then once more.
SPREAD = 64
#: Elements of vectors whose pairs are aggregated as columns.
NARROW = 8


@dataclass
class CoMoment:
    """Count, means and the sums of products of deviations."""

    n: int
    mean: np.ndarray
    c: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoment:
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        return cls(len(x), mean, (x - mean).T @ (x - mean))

    def merge(self, other: CoMoment) -> CoMoment:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        d = other.mean - self.mean
        return CoMoment(n, self.mean + d * (other.n / n), self.c + other.c + np.outer(d, d) * (self.n * other.n / n))

    @property
    def covariance(self) -> np.ndarray:
        return self.c / self.n if self.n else self.c


def matrix_of(b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the most common size without missing elements, and their rows in the batch."""
    sizes = np.diff(b.offsets.to_numpy())
    some = sizes[sizes > 0]
    if not len(some):
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    d = int(np.bincount(some).argmax())
    rows = np.flatnonzero((sizes == d) & b.is_valid().to_numpy(zero_copy_only=False))
    x = b.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    fine = np.isfinite(x).all(axis=1)
    return x[fine], rows[fine]


def groups_of(*columns: np.ndarray) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """Each distinct row of small integer columns, with the places that hold it."""
    both = np.column_stack(columns)
    distinct, which = np.unique(both, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    bounds = np.cumsum(np.bincount(which.ravel(), minlength=len(distinct)))[:-1] if len(distinct) else []
    return [(tuple(map(int, d)), at) for d, at in zip(distinct, np.split(order, bounds))]


def covariance(df: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``row``, ``column`` (row <= column), ``n``, ``mean_row``, ``mean_column``, ``cov``.

    Vectors must have one size; null vectors and those with a missing or infinite element are left
    out. Null keys form a key. Each task sends one partial per key, so a hot key is a few numbers per
    task. An empty table gives no rows.

    Narrow vectors are aggregated by built-in co-moments inside code generation; wide ones, whose
    pairs would be too many expressions, by matrix products of Arrow batches.
    """
    by = list(by)
    rows = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(features).cast("array<double>").alias("__x")).where("__x is not null")
    first = rows.where(F.size("__x") > 0).select(F.size("__x")).first()
    d = first[0] if first else 0
    whole = (_by_columns if d <= NARROW else _by_matrices)(rows, len(by), d)
    named = [F.col(f"__k{i}").alias(c) for i, c in enumerate(by)]
    return whole.select(*named, "row", "column", "n", "mean_row", "mean_column", "cov")


def _by_columns(rows: DataFrame, n_keys: int, d: int) -> DataFrame:
    x = [F.get("__x", i) for i in range(d)]
    far = F.lit(float("inf"))
    whole = reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) & (F.abs(v) < far) for v in x], F.size("__x") == d)
    cells = [F.struct(F.lit(i).alias("row"), F.lit(j).alias("column"), F.avg(x[i]).alias("mean_row"), F.avg(x[j]).alias("mean_column"), F.covar_pop(x[i], x[j]).alias("cov")).alias(f"__c{i}_{j}") for i in range(d) for j in range(i, d)]
    keys = [f"__k{i}" for i in range(n_keys)]
    wide = rows.where(whole).groupBy(*keys).agg(F.count("*").alias("n"), *cells).where("n > 0")
    every = F.array(*[f"__c{i}_{j}" for i in range(d) for j in range(i, d)]) if d else F.lit(None).cast("array<struct<row:int,column:int,mean_row:double,mean_column:double,cov:double>>")
    return wide.select(*keys, "n", F.explode(every).alias("c")).select(*keys, "n", "c.*")


def _by_matrices(rows: DataFrame, n_keys: int, d: int) -> DataFrame:
    """Partials of tasks by key, merged in two steps; keys travel as one hash, with their values beside it."""
    keys = [f"__k{i}" for i in range(n_keys)]
    code = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys], F.lit(0))
    coded = rows.withColumn("key", code)
    names = coded.select("key", *keys).groupBy("key").agg(*[F.first(k).alias(k) for k in keys]) if keys else None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, CoMoment] = {}
        for b in batches:
            x, at = matrix_of(b.column(1))
            if x.shape[1] != d:
                continue
            for (k,), own in groups_of(b.column(0).to_numpy()[at]):
                m = CoMoment.of(x[own])
                parts[k] = parts[k].merge(m) if k in parts else m
        yield from _partials(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, CoMoment] = {}
        for b in batches:
            for k, n, mean, c in zip(*(c.to_pylist() for c in b.columns[:4])):
                m = CoMoment(n, np.array(mean), np.array(c).reshape(d, d))
                parts[k] = parts[k].merge(m) if k in parts else m
        yield from _partials(parts)

    shape = "key bigint, n bigint, mean array<double>, c array<double>"
    once = coded.select("key", "__x").mapInArrow(partial, shape).withColumn("part", F.spark_partition_id() % SPREAD)
    some = once.repartition("key", "part").drop("part").mapInArrow(merge, shape)
    whole = some.repartition("key").mapInArrow(merge, shape)
    cells = whole.select("key", "n", "mean", F.posexplode("c").alias("at", "v")).withColumn("row", F.floor(F.col("at") / d).cast("int")).withColumn("column", F.pmod("at", F.lit(d)).cast("int")).where("row <= `column`")
    out = cells.select("key", "n", "row", "column", F.get("mean", F.col("row")).alias("mean_row"), F.get("mean", F.col("column")).alias("mean_column"), (F.col("v") / F.col("n")).alias("cov"))
    return out.join(names, "key") if keys else out


def _partials(parts: dict[int, CoMoment]) -> Iterator[pa.RecordBatch]:
    if parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int64()), pa.array([m.n for m in parts.values()], pa.int64()), pa.array([m.mean.tolist() for m in parts.values()], pa.list_(pa.float64())), pa.array([m.c.ravel().tolist() for m in parts.values()], pa.list_(pa.float64()))],
            names=["key", "n", "mean", "c"],
        )


def dense_matrix(entries: Sequence[tuple[int, int, float]], size: int, symmetric: bool = True) -> np.ndarray:
    out = np.zeros((size, size))
    for r, c, v in entries:
        out[r, c] = v
        if symmetric:
            out[c, r] = v
    return out


def inverse(a: np.ndarray, how: str = "svd") -> np.ndarray:
    """Inverse by ``lu``, ``qr`` or ``svd`` (the pseudo-inverse, also of singular matrices)."""
    if how.lower() == "svd":
        return np.linalg.pinv(a)
    if how.lower() == "qr":
        q, r = np.linalg.qr(a)
        return np.linalg.solve(r, q.T)
    if how.lower() == "lu":
        return np.linalg.inv(a)
    raise ValueError("the method is lu, qr or svd")
