"""Uniform numbers from hashed identity columns: equal in every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: int | str, *ids: str | Column) -> Column:
    """A double strictly between 0 and 1 from the md5 of the seed and the ids.

    Every id goes in with its length before it, so ids don't run together, and null differs from
    every text.
    """
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in ids]
    text = F.concat(F.lit(str(seed)), *[F.coalesce(F.concat(F.lit(":"), F.length(p).cast("string"), F.lit(":"), p), F.lit(":-")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 1) / F.lit(281474976710657.0)


def sql_uniform(seed: int | str, *ids: str) -> str:
    """The same in DuckDB's SQL."""
    one = "coalesce(':' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), ':-')"
    text = " || ".join([f"'{seed}'", *[one.format(c=c) for c in ids]])
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) + 1) / 281474976710657.0"


def row_uniform(seed: int) -> Column:
    """A double in (0, 1] for each row by its place in its input split, for rows that no columns identify.

    Equal rows have numbers of their own. The same splits give the same numbers, also when a task is
    repeated; so use it on rows as they are read, not behind a shuffle.
    """
    return 1 - F.rand(seed)
