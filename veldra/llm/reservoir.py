"""Uniform samples of fixed size from rows that arrive in pieces, with a geometric file per shard.

A shard (an input split of a piece) keeps a reservoir: accepted records gather in a buffer, and a
full buffer is flushed as a new subsample of segments that shrink exponentially. The records it
displaces are taken from the older subsamples, each by a hypergeometric share, so whole segments
fall away, the largest first. Shards then merge by hypergeometric draws weighted by population.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from veldra.plans.scratch import Scratch

#: Bytes of records that a shard's reservoir holds in memory; a larger one keeps its segments in the shared folder.
MEMORY = 64 << 20


class Segments:
    """Where flushed segments lie: in memory, or as files in the shared folder beyond ``memory`` bytes."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.held = folder, memory, 0
        self.fs: pafs.FileSystem | None = None
        self.path = ""

    def put(self, t: pa.Table):
        if self.held + t.nbytes <= self.memory:
            self.held += t.nbytes
            return t
        if self.fs is None:
            self.fs, path = pafs.FileSystem.from_uri(self.folder)
            self.path = f"{path}/{uuid.uuid4().hex}"
            self.fs.create_dir(self.path, recursive=True)
        name = f"{self.path}/{uuid.uuid4().hex}.arrow"
        with self.fs.open_output_stream(name) as out, pa.ipc.new_stream(out, t.schema) as w:
            w.write_table(t)
        return name

    def get(self, x) -> pa.Table:
        if isinstance(x, pa.Table):
            return x
        with self.fs.open_input_stream(x) as f:
            return pa.ipc.open_stream(f).read_all()

    def drop(self, x) -> None:
        if isinstance(x, pa.Table):
            self.held -= x.nbytes
        else:
            self.fs.delete_file(x)

    def close(self) -> None:
        if self.fs is not None:
            self.fs.delete_dir(self.path)


class GeometricFile:
    """A reservoir of ``size`` records fed by Arrow tables, all records equally likely."""

    def __init__(self, size: int, schema: pa.Schema, rng: np.random.Generator, segments: Segments, buffer: int | None = None):
        self.size, self.schema, self.rng, self.segments = size, schema, rng, segments
        self.limit = buffer or max(1, min(size, max(64, size // 16)))
        self.seen = 0
        self.parts: list[list] = []  # subsamples: lists of [segment, rows], the largest segment first
        self.live: list[int] = []  # records that still count of each subsample: its last ones
        self.buffer = schema.empty_table()

    def add(self, t: pa.Table) -> None:
        start = 0
        if self.seen < self.size:  # until the reservoir is full, every record is in it
            start = min(t.num_rows, self.size - self.seen)
            self._append(t.slice(0, start), fills=True)
            self.seen += start
        rest = t.num_rows - start
        if not rest:
            return
        number = self.seen + 1 + np.arange(rest)
        accepted = np.flatnonzero(self.rng.random(rest) < self.size / number) + start
        self.seen += rest
        step = max(1, self.limit // 4)
        for at in range(0, len(accepted), step):
            self._accept(t.take(pa.array(accepted[at : at + step])))

    def _append(self, t: pa.Table, fills: bool) -> None:
        while t.num_rows:
            take = min(t.num_rows, self.limit - self.buffer.num_rows)
            self.buffer = pa.concat_tables([self.buffer, t.slice(0, take)])
            t = t.slice(take)
            if self.buffer.num_rows == self.limit:
                self._flush(0 if fills else self.limit)
        if fills and self.seen + t.num_rows <= self.size and self.buffer.num_rows:
            self._flush(0)

    def _accept(self, t: pa.Table) -> None:
        """Each record takes the place of a random one of the reservoir: of the buffer, or later of the file."""
        slots = list(range(self.buffer.num_rows))
        new = np.arange(t.num_rows)
        place: list[int] = slots  # rows of buffer ++ t that make up the new buffer
        base = self.buffer.num_rows
        for i in new:
            if place and self.rng.random() < len(place) / self.size:
                place[int(self.rng.integers(len(place)))] = base + int(i)
            else:
                place.append(base + int(i))
        merged = pa.concat_tables([self.buffer, t]).take(pa.array(place))
        self.buffer = self.schema.empty_table()
        while merged.num_rows >= self.limit:
            self.buffer = merged.slice(0, self.limit)
            merged = merged.slice(self.limit)
            self._flush(self.limit)
        self.buffer = merged.combine_chunks()

    def _evict(self, n: int) -> None:
        if not n:
            return
        gone = self.rng.multivariate_hypergeometric(self.live, n, method="marginals")
        for i, g in enumerate(gone):
            self.live[i] -= int(g)
            total = sum(rows for _, rows in self.parts[i])
            while self.parts[i] and total - self.parts[i][0][1] >= self.live[i]:
                segment, rows = self.parts[i].pop(0)
                self.segments.drop(segment)
                total -= rows
        keep = [i for i, n_live in enumerate(self.live) if n_live]
        self.parts, self.live = [self.parts[i] for i in keep], [self.live[i] for i in keep]

    def _flush(self, evict: int) -> None:
        self._evict(evict)
        t = self.buffer.take(pa.array(self.rng.permutation(self.buffer.num_rows))).combine_chunks()
        shrink = 1 - min(0.5, self.limit / max(self.size, 1))
        segments, at, rows = [], 0, t.num_rows
        while at < rows:
            n = max(1, min(rows - at, int(np.ceil((rows - at) * (1 - shrink)))))
            n = rows - at if rows - at <= max(16, self.limit // 8) else max(n, self.limit // 8)
            segments.append([self.segments.put(t.slice(at, n).combine_chunks()), n])
            at += n
        if segments:
            self.parts.append(segments)
            self.live.append(rows)
        self.buffer = self.schema.empty_table()

    def sample(self) -> pa.Table:
        """The reservoir's records. The file can't be fed any more."""
        over = sum(self.live) + self.buffer.num_rows - min(self.size, self.seen)
        self._evict(max(0, over))
        out = [self.buffer]
        for segments, n in zip(self.parts, self.live):
            rows = pa.concat_tables([self.segments.get(s) for s, _ in segments])
            out.append(rows.slice(rows.num_rows - n))
        return pa.concat_tables(out)


def _shards(df: DataFrame, size: int, seed: int, folder: str, memory: int) -> DataFrame:
    """shard, population, and the reservoir's records of each input split and run of a piece in it."""
    names = df.columns
    schema = to_arrow_schema(df.schema)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = TaskContext.get().partitionId()
        segments = Segments(folder, memory)
        try:
            file = GeometricFile(size, schema, np.random.default_rng([seed, split]), segments)
            for b in batches:
                file.add(pa.Table.from_batches([b.cast(schema) if b.schema != schema else b]))
            if file.seen:
                # in a random order, so that any first k are a uniform sample of k
                t = file.sample()
                t = t.take(pa.array(np.random.default_rng([seed, split, 1]).permutation(t.num_rows)))
                order = pa.array(np.arange(t.num_rows))
                yield from pa.table([pa.array(np.full(t.num_rows, split)), pa.array(np.full(t.num_rows, file.seen)), order, *t.columns], names=["__shard", "__population", "__order", *names]).to_batches()
        finally:
            segments.close()

    shape = "__shard bigint, __population bigint, __order bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(shard, shape)


def merge_draws(populations: dict, size: int, rng: np.random.Generator) -> dict:
    """How many of ``size`` records each shard gives, by a multivariate hypergeometric draw."""
    keys = sorted(populations)
    counts = [populations[k] for k in keys]
    drawn = rng.multivariate_hypergeometric(counts, min(size, sum(counts)), method="marginals") if keys else []
    return {k: int(n) for k, n in zip(keys, drawn) if n}


def reservoir_sample(df: DataFrame, size: int, seed: int = 1729, memory: int = MEMORY) -> DataFrame:
    """``size`` rows of ``df`` (all of them if there are fewer), each with the same chance.

    Rows count as stored: repeated rows are rows. All columns come out as they are, whatever their
    values; null and NaN don't matter. The total needn't be known, and the sample is uniform in any
    order of arrival. An empty table gives no rows. The same input splits and ``seed`` give the same sample, also when a task is
    repeated. To go on with later pieces use ``Reservoir``.
    """
    state = Reservoir(df.sparkSession, size, seed, memory)
    state.add(df)
    return state.sample()


class Reservoir:
    """A sample that grows with every piece: ``add`` pieces in any number, then ``sample``.

    Each piece's shards merge with the sample so far, which stands for the rows seen before. The
    state is a table of at most ``size`` rows in the shared folder, still by shard: a shard's rows
    are numbered in a random order, so its first k are a uniform draw of k, and how many each shard
    gives is drawn on the driver. Nothing is sorted and no task holds the whole sample.
    """

    def __init__(self, spark, size: int, seed: int = 1729, memory: int = MEMORY):
        if size < 1:
            raise ValueError("size must be at least 1")
        self.spark, self.size, self.seed, self.memory = spark, size, seed, memory
        self.scratch = Scratch(spark, "reservoir")
        self.pieces, self.seen = 0, 0
        self.held: dict[int, int] = {}  # rows of the sample by shard
        self.rows: DataFrame | None = None
        self.names: list[str] | None = None

    def add(self, df: DataFrame) -> None:
        self.pieces += 1
        seed = self.seed + 7919 * self.pieces
        if self.names is None:
            self.names = df.columns
        df = df.toDF(*[f"c{i}" for i in range(len(self.names))])  # columns may have any names
        rng = np.random.default_rng([seed, 2])
        shards = _shards(df, self.size, seed, f"{self.scratch.path}/segments", self.memory).withColumn("__shard", F.col("__shard") + F.lit(self.pieces << 32))
        shards = self.scratch.put(shards, f"shards-{self.pieces}")
        # one number per shard reaches the driver
        populations = {r[0]: r[1] for r in shards.select("__shard", "__population").distinct().collect()}
        n_new = sum(populations.values())
        if n_new:
            shares = merge_draws({0: self.seen, 1: n_new}, self.size, rng)
            draws = merge_draws(self.held, shares.get(0, 0), rng) | merge_draws(populations, shares.get(1, 0), rng)
            both = shards.drop("__population") if self.rows is None else self.rows.unionByName(shards.drop("__population"))
            listed = self.spark.createDataFrame(list(draws.items()), "__shard bigint, __draw bigint")
            merged = both.join(F.broadcast(listed), "__shard").where(F.col("__order") < F.col("__draw")).drop("__draw")
            self.rows, self.held, self.seen = self.scratch.put(merged, f"sample-{self.pieces}"), draws, self.seen + n_new
        elif self.rows is None:
            self.rows = self.scratch.put(shards.drop("__population"), f"sample-{self.pieces}")
        self.scratch.drop(f"shards-{self.pieces}")

    def sample(self) -> DataFrame:
        if self.rows is None:
            raise ValueError("add a piece first")
        return self.rows.drop("__shard", "__order").toDF(*self.names)

    def stream(self, rows: DataFrame):
        """A streaming query that adds every micro-batch as a piece."""
        add: Callable = lambda batch, _: self.add(batch)
        return rows.writeStream.foreachBatch(add).start()
