"""Row counts and exact sums per key when a handful of keys hold most rows.

Keys are dictionary-encoded; every input split counts into dense numpy arrays (``bincount``), so a
task's work is its number of rows, whichever keys they have. The arrays travel as blocks of fixed
length and are added element by element in a distributed reduction: a key that holds a third of
all rows sends one element per split, as any other key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.plans.scratch import Scratch

BLOCK = 4096
#: A dictionary of more bytes than this isn't sent to all tasks; splits then encode on their own.
DICTIONARY_BYTES = 32 << 20
#: Distinct keys that a split without the common dictionary holds before it passes its sums on.
LOCAL_KEYS = 1 << 20


def _code(keys: Sequence[str]) -> Column:
    """One string for all key columns; null differs from every value."""
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return reduce(lambda a, b: F.concat(a, F.lit(","), b), parts)


def _add(acc: np.ndarray, codes: np.ndarray, values: pa.Array) -> None:
    """Add a batch to the rows n, with_value, high, low of acc. Sums stay exact: below 2**21 rows
    every float64 partial sum of 32-bit halves is an exact integer."""
    size = acc.shape[1]
    for at in range(0, len(codes), 1 << 20):
        c = codes[at : at + (1 << 20)]
        v = values.slice(at, 1 << 20)
        there = v.is_valid().to_numpy(zero_copy_only=False)
        x = pc.fill_null(v, 0).to_numpy(zero_copy_only=False)
        acc[0] += np.bincount(c, minlength=size)
        acc[1] += np.bincount(c[there], minlength=size)
        acc[2] += np.bincount(c, weights=(x >> 32).astype(np.float64), minlength=size).astype(np.int64)
        acc[3] += np.bincount(c, weights=(x & 0xFFFFFFFF).astype(np.float64), minlength=size).astype(np.int64)


_BLOCKS = "block int, n array<bigint>, m array<bigint>, high array<bigint>, low array<bigint>"


def _dense(dictionary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = {w: i for i, w in enumerate(dictionary.value)}
    acc = np.zeros((4, len(index)), np.int64)
    for b in batches:
        coded = b.column(0).dictionary_encode()
        to = np.array([index[w] for w in coded.dictionary.to_pylist()], np.int64)
        if len(to):
            _add(acc, to[coded.indices.to_numpy(zero_copy_only=False)], b.column(1))
    for k in range(0, acc.shape[1], BLOCK):
        part = acc[:, k : k + BLOCK]
        if part[0].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // BLOCK], pa.int32()), *(pa.array([row.tolist()], pa.list_(pa.int64())) for row in part)],
                names=["block", "n", "m", "high", "low"],
            )


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with a dictionary of the split's own keys."""
    index: dict[str, int] = {}
    acc = np.zeros((4, 1024), np.int64)

    def out():
        keys = pa.array(list(index), pa.string())
        return pa.RecordBatch.from_arrays([keys, *(pa.array(row[: len(index)]) for row in acc)], names=["code", "n", "m", "high", "low"])

    for b in batches:
        coded = b.column(0).dictionary_encode()
        to = np.array([index.setdefault(w, len(index)) for w in coded.dictionary.to_pylist()], np.int64)
        if len(index) > acc.shape[1]:
            acc = np.concatenate([acc, np.zeros((4, 2 * len(index) - acc.shape[1]), np.int64)], axis=1)
        if len(to):
            _add(acc, to[coded.indices.to_numpy(zero_copy_only=False)], b.column(1))
        if len(index) >= LOCAL_KEYS:
            yield out()
            index, acc = {}, np.zeros((4, 1024), np.int64)
    if index:
        yield out()


def key_sums(df: DataFrame, keys: Sequence[str], value: str, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """One row per distinct ``keys``: ``n_rows`` bigint and ``value_sum`` decimal(38,0).

    ``value`` must be an integer column. Null keys form keys of their own. ``value_sum`` leaves null
    values out and is null if a key has no value at all; it can't overflow. Other columns of ``df``
    are neither read nor in the way. An empty table gives no rows.

    A dictionary of at most ``dictionary_bytes`` is sent to all tasks. Beyond that every split
    encodes with the keys it meets, and one row per split and key is reduced: the results are equal.
    """
    spark = df.sparkSession
    rows = df.select(_code(keys).alias("__code"), F.col(value).cast("bigint").alias("__value"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    scratch = Scratch(spark, "keys")
    names = [f"__k{i}" for i in range(len(keys))]
    words = scratch.put(rows.groupBy("__code").agg(*[F.first(k).alias(k) for k in names]), "dictionary")
    n_words, n_bytes = words.agg(F.count("*"), F.sum(F.octet_length("__code"))).first()
    if n_words and n_bytes + 16 * n_words <= dictionary_bytes:
        listed = sorted(r[0] for r in words.select("__code").collect())
        shared = spark.sparkContext.broadcast(listed)
        blocks = rows.select("__code", "__value").mapInArrow(lambda it: _dense(shared, it), _BLOCKS)
        cells = blocks.select("block", F.posexplode(F.arrays_zip("n", "m", "high", "low")).alias("at", "x")).where("x.n > 0")
        summed = cells.groupBy("block", "at").agg(*_sums("x."))
        ids = spark.createDataFrame(pa.table({"__code": pa.array(listed), "block": pa.array(np.arange(n_words, dtype=np.int32) // BLOCK), "at": pa.array(np.arange(n_words, dtype=np.int32) % BLOCK)}))
        summed = summed.join(ids, ["block", "at"])
    else:
        cells = rows.select("__code", "__value").mapInArrow(_local, "code string, n bigint, m bigint, high bigint, low bigint")
        summed = cells.groupBy(F.col("code").alias("__code")).agg(*_sums(""))
    return summed.join(words, "__code").select(*[F.col(a).alias(b) for a, b in zip(names, keys)], "n_rows", "value_sum")


def _sums(at: str) -> list[Column]:
    total = F.sum(F.col(f"{at}high").cast("decimal(28,0)")) * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(F.col(f"{at}low").cast("decimal(28,0)"))
    return [F.sum(f"{at}n").alias("n_rows"), F.when(F.sum(f"{at}m") > 0, total.cast("decimal(38,0)")).alias("value_sum")]


def heavy_keys(df: DataFrame, keys: Sequence[str], value: str, one_in: int = 50) -> DataFrame:
    """The keys without a null part that hold at least one ``one_in``-th of all rows as stored.

    Rows with a null part count in the total only. Columns: ``keys``, ``n_rows``, ``value_sum``.
    """
    scratch = Scratch(df.sparkSession, "heavy")
    sums = scratch.put(key_sums(df, keys, value), "sums")
    total = sums.agg(F.sum("n_rows")).first()[0] or 0
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return sums.where(whole & (F.col("n_rows") * one_in >= F.lit(total)))
