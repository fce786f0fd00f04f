"""Distributed k-means: the k-means|| sketch, and Lloyd's rounds for many clusterings at once."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldra.functions.uniform import hash_uniform
from veldra.operators.assign import assign
from veldra.operators.centers import Centers, CentersIndex
from veldra.operators.covariance import groups_of, matrix_of
from veldra.operators.sampling import crossfold
from veldra.plans.joins import salted_join
from veldra.plans.scratch import Scratch


def sketch_round(vectors: DataFrame, so_far: dict[int, Centers], per_round: int, seed: int, approx: bool = False, **index) -> DataFrame:
    """``fold``, ``id``, ``features``, ``d2``: a round's new candidates, ``per_round`` in each fold.

    ``vectors`` has ``id``, ``features``, ``fold``. Vectors are drawn by the squared distance to their
    own fold's nearest candidate in ``so_far``: those of greatest log(u) / d2; candidates themselves
    don't take part. A task hands on its own best ``per_round`` of each fold only. ``approx`` looks for the
    nearest among the candidates of nearest signatures; ``index`` has its ``bits`` and ``candidates``.
    """
    shared = vectors.sparkSession.sparkContext.broadcast({f: CentersIndex([c], **index) for f, c in so_far.items()})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for b in batches:
            x, rows = matrix_of(b.column(1))
            if not len(rows):
                continue
            fold, u = b.column(2).to_numpy()[rows], b.column(3).to_numpy()[rows]
            for (f,), at in groups_of(fold):
                d2 = shared.value[f].nearest(x[at], approx)[0][1]
                at, d2 = at[d2 > 0], d2[d2 > 0]
                score = np.log(u[at]) / d2
                if len(score) > per_round:  # all rows as good as the last one that counts, for ties
                    keep = score >= np.partition(score, -per_round)[-per_round]
                    at, d2, score = at[keep], d2[keep], score[keep]
                take = pa.array(rows[at])
                t = pa.table([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(d2), pa.array(score)], names=["id", "features", "fold", "d2", "score"])
                t = pa.concat_tables([held[f], t]) if f in held else t
                held[f] = t.sort_by([("score", "descending"), ("id", "ascending")]).slice(0, per_round).combine_chunks()
        for t in held.values():
            yield from t.to_batches()

    scored = vectors.select("id", "features", "fold", hash_uniform(seed, "id").alias("u")).mapInArrow(best, "id string, features array<double>, fold int, d2 double, score double")
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("score"), "id"))
    return scored.withColumn("r", rank).where(F.col("r") <= per_round).select("fold", "id", "features", "d2")


def _folded(vectors: DataFrame, folds: int, seed: int, scratch: Scratch) -> DataFrame:
    """``id``, ``features``, ``fold`` as a table in the shared folder, in which every row has an id of its own.

    Rows with a null, empty or repeated id get their place in the table behind it.
    """
    rows = vectors.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("features").cast("array<double>").alias("features"))
    rows = scratch.put(crossfold(rows, folds, ["id"], seed).withColumn("place", F.monotonically_increasing_id()), "rows")
    often = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id = ''")
    if often.isEmpty():
        return rows.drop("place")
    named = salted_join(rows.drop("fold"), often, ["id"], ["place"], "left")
    named = named.select(F.when(F.col("n").isNotNull(), F.concat_ws("#", "id", F.col("place").cast("string"))).otherwise(F.col("id")).alias("id"), "features")
    named = scratch.put(crossfold(named, folds, ["id"], seed), "named")
    scratch.drop("rows")
    return named


def sketch(vectors: DataFrame, rounds: int = 5, per_round: int = 100, folds: int = 2, seeds: Sequence[Sequence[float]] | None = None, seed: int = 1729, approx: bool = False, **index) -> DataFrame:
    """``fold``, ``point_id``, ``features``, ``weight``: weighted candidate centers of each fold.

    ``vectors`` has ``id`` and ``features``; without ``seeds`` the vector of the smallest id
    starts each fold. Rows without an id of their own are told apart by their place. A candidate's
    weight is the number of its fold's vectors nearest to it. An empty table gives the seeds, if any,
    with weight 0. The driver holds folds x (seeds + rounds x per_round) vectors, whatever the
    data's size.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "sketch")
    rows = _folded(vectors, folds, seed, scratch)
    if seeds is None:
        first = rows.where("features is not null").orderBy("id").limit(1).collect()
        seeds = [r.features for r in first]
    candidates = {f: Centers(seeds) for f in range(folds)}
    if all(len(c) for c in candidates.values()):
        for k in range(rounds):
            more: dict[int, list] = {}
            for r in sketch_round(rows, candidates, per_round, seed + k + 1, approx, **index).orderBy("fold", "id").collect():
                more.setdefault(r.fold, []).append(r.features)
            candidates = {f: c.extended(more.get(f, [])) for f, c in candidates.items()}
    weights = {(f, i): 0 for f, c in candidates.items() for i in range(len(c))}
    for r in _fold_counts(rows, candidates).collect():
        weights[r.fold, r.center_id] = r.n
    scratch.keep()
    return spark.createDataFrame([(f, i, p.tolist(), float(weights[f, i])) for f, c in candidates.items() for i, p in enumerate(c.points)], "fold int, point_id int, features array<double>, weight double")


def _fold_counts(rows: DataFrame, candidates: dict[int, Centers]) -> DataFrame:
    """``fold``, ``center_id``, ``n``: vectors of each fold nearest to its candidates, in one pass; a task sends one row per candidate."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: np.zeros(len(c), np.int64) for f, c in shared.value.items()}
        for b in batches:
            x, at = matrix_of(b.column(0))
            if len(at):
                for (f,), own in groups_of(b.column(1).to_numpy()[at]):
                    held[f] += np.bincount(shared.value[f].closest(x[own])[0], minlength=len(held[f]))
        for f, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), f, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["fold", "center_id", "n"])

    return rows.select("features", "fold").mapInArrow(count, "fold int, center_id int, n bigint").groupBy("fold", "center_id").agg(F.sum("n").alias("n"))


def lloyds(vectors: DataFrame, clusterings: dict[int, Centers], rounds: int = 1, approx: bool = False) -> dict[int, Centers]:
    """``rounds`` of Lloyd's for all clusterings together; a center without vectors disappears.

    A task sends one sum per center; sums are added element by element before they reach the driver.
    """
    for _ in range(rounds):
        placed = assign(vectors, clusterings, approx, keep_features=True)
        moved = _means(placed)
        after: dict[int, list] = {}
        for r in moved.orderBy("cluster_id", "closest_center_id").collect():
            after.setdefault(r.cluster_id, []).append(r.center)
        for k, c in clusterings.items():
            if len(after.get(k, [])) < len(c):
                warnings.warn(f"clustering {k} lost {len(c) - len(after.get(k, []))} centers without vectors", stacklevel=2)
        clusterings = {k: Centers(after[k]) if k in after else c for k, c in clusterings.items()}
    return clusterings


def _means(placed: DataFrame) -> DataFrame:
    """cluster_id, closest_center_id, center: mean vectors of the assigned."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for b in batches:
            x, rows = matrix_of(b.column(2))
            for group, at in groups_of(b.column(0).to_numpy()[rows], b.column(1).to_numpy()[rows]):
                s = sums.setdefault(group, [0, np.zeros(x.shape[1])])
                s[0] += len(at)
                s[1] += x[at].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([i for _, i in sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([s.tolist() for _, s in sums.values()], pa.list_(pa.float64()))], names=["cluster_id", "closest_center_id", "n", "s"])

    parts = placed.select("cluster_id", "closest_center_id", "features").mapInArrow(partial, "cluster_id int, closest_center_id int, n bigint, s array<double>")
    cells = parts.select("cluster_id", "closest_center_id", "n", F.posexplode("s").alias("at", "v")).groupBy("cluster_id", "closest_center_id", "at").agg((F.sum("v") / F.sum("n")).alias("v"))
    return cells.groupBy("cluster_id", "closest_center_id").agg(F.sort_array(F.collect_list(F.struct("at", "v")))["v"].alias("center"))

