"""Vectors to their nearest centers: assignment, costs, counts, covariances and outliers of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.operators.centers import Centers, CentersIndex
from veldra.operators.covariance import covariance, dense_matrix, groups_of, inverse, matrix_of

_ASSIGNED = "vector_id string, cluster_id int, closest_center_id int, distance double"


def assign(vectors: DataFrame, clusterings: dict[int, Centers], approx: bool = False, keep_features: bool = False, **index) -> DataFrame:
    """``vector_id``, ``cluster_id``, ``closest_center_id``, ``distance`` (squared) for every clustering.

    ``vectors`` has ``id`` and ``features``. Null vectors and those with a missing or infinite
    element are left out; one of another size than the centers is an error. Of equally near centers
    the first is taken. One pass without a shuffle; the centers, a model, go to all tasks.
    """
    ids = list(clusterings)
    shared = vectors.sparkSession.sparkContext.broadcast(CentersIndex([clusterings[i] for i in ids], **index))
    width = next((c.points.shape[1] for c in clusterings.values() if len(c)), 0)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = matrix_of(b.column(1))
            if not len(rows):
                continue
            if x.shape[1] != width:
                raise ValueError(f"vectors have {x.shape[1]} elements, centers {width}")
            names, kept = b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))
            for k, (at, d2) in zip(ids, shared.value.nearest(x, approx)):
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(np.full(len(rows), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(d2), *([kept] if keep_features else [])],
                    names=["vector_id", "cluster_id", "closest_center_id", "distance", *(["features"] if keep_features else [])],
                )

    shape = _ASSIGNED + (", features array<double>" if keep_features else "")
    return vectors.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(nearest, shape)


def costs(vectors: DataFrame, clusterings: dict[int, Centers], approx: bool = False) -> DataFrame:
    """``cluster_id``, ``cost``: the sum of squared distances to the nearest centers."""
    return assign(vectors, clusterings, approx).groupBy("cluster_id").agg(F.sum("distance").alias("cost"))


def closest_counts(vectors: DataFrame, clusterings: dict[int, Centers]) -> DataFrame:
    """``cluster_id``, ``center_id``, ``n``: vectors nearest to each center; 0 for centers without any."""
    spark = vectors.sparkSession
    every = spark.createDataFrame([(k, i) for k, c in clusterings.items() for i in range(len(c))], "cluster_id int, center_id int")
    counts = assign(vectors, clusterings).groupBy("cluster_id", F.col("closest_center_id").alias("center_id")).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, ["cluster_id", "center_id"], "left").select("cluster_id", "center_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def cluster_covariances(vectors: DataFrame, clusterings: dict[int, Centers], approx: bool = False) -> DataFrame:
    """``clustering_id``, ``center_id``, ``count``, ``means``, ``cov``: the non-zero entries of the upper triangle."""
    cells = covariance(assign(vectors, clusterings, approx, keep_features=True), "features", ["cluster_id", "closest_center_id"])
    entry = F.when(F.col("cov") != 0, F.struct("row", "column", F.col("cov").alias("value")))
    mean = F.when(F.col("row") == F.col("column"), F.struct("row", "mean_row"))
    grouped = cells.groupBy(F.col("cluster_id").alias("clustering_id"), F.col("closest_center_id").alias("center_id")).agg(F.first("n").alias("count"), F.sort_array(F.collect_list(mean)).alias("means"), F.sort_array(F.collect_list(entry)).alias("cov"))
    return grouped.withColumn("means", F.col("means.mean_row"))


def outliers(vectors: DataFrame, clusterings: dict[int, Centers], covariances: DataFrame, approx: bool = False) -> DataFrame:
    """``vector_id``, ``cluster_id``, ``closest_center_id``, ``outlier_distance``: squared Mahalanobis
    distance from the mean of the nearest center's cluster, by the pseudo-inverse of its covariance.

    Every center must have a covariance; if one lacks it, that is an error before anything runs.
    """
    params = {}
    for r in covariances.collect():
        d = len(r.means)
        params[r.clustering_id, r.center_id] = (np.array(r.means), inverse(dense_matrix([(e.row, e.column, e.value) for e in r.cov], d)))
    if missing := [(k, i) for k, c in clusterings.items() for i in range(len(c)) if (k, i) not in params]:
        raise ValueError(f"no covariance for clusters {missing}")
    shared = vectors.sparkSession.sparkContext.broadcast(params)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = matrix_of(b.column(4))
            out = np.empty(len(rows))
            for group, at in groups_of(b.column(1).to_numpy()[rows], b.column(2).to_numpy()[rows]):
                mean, inv = shared.value[group]
                d = x[at] - mean
                out[at] = np.einsum("ij,jk,ik->i", d, inv, d)
            t = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), b.column(2).take(t), pa.array(out)], names=["vector_id", "cluster_id", "closest_center_id", "outlier_distance"])

    return assign(vectors, clusterings, approx, keep_features=True).mapInArrow(score, "vector_id string, cluster_id int, closest_center_id int, outlier_distance double")
