"""Samples and sketches of rows that nothing tells apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra import cli
from veldra.functions.uniform import hash_uniform
from veldra.operators import kmeans_parallel, sampling
from veldra.operators.centers import Centers, CentersIndex
from veldra.sources import records


@pytest.fixture
def equal_rows(spark, tmp_path):
    rows = [(f"k{i}", float(i)) for i in range(20) for _ in range(100)]
    path = f"{tmp_path}/equal"
    spark.createDataFrame(rows, "name string, x double").repartition(3).write.parquet(path)
    return path


def counts(spark, path):
    return {r[0]: r[1] for r in spark.read.parquet(path).groupBy("name").count().collect()}


@pytest.mark.parametrize("how", [["--prob", "0.3"], ["--size", "600"], ["--size", "600", "--weight-field", "x", "--weight-default", "1"], ["--size", "30", "--group-fields", "name"]])
def test_equal_rows_have_draws_of_their_own(spark, equal_rows, tmp_path, how):
    args = ["sample", "--input-paths", equal_rows, "--format", "parquet", "--output-path", f"{tmp_path}/out", "--output-type", "parquet", *how]
    assert cli.main(args, spark) == 0
    got = counts(spark, f"{tmp_path}/out")
    assert len(got) == 20 and all(0 < n < 100 for n in got.values())
    if "--size" in how:
        assert sum(got.values()) == 600


def test_lines_without_a_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f'{i},"x y",\n\n' for i in range(300)))
    base = ["sample", "--input-paths", f"{tmp_path}/a.txt", "--output-path", f"{tmp_path}/out"]
    assert cli.main([*base, "--size", "40"], spark) == 0
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert len(set(lines)) == 40 and all(v.endswith(',"x y",') for v in lines)
    assert cli.main([*base, "--size", "40", "--weight-field", "0"], spark) == 1


def test_numbered_rows_and_lengths_before_ids(spark):
    df = spark.createDataFrame([("a:b", "c")] * 3 + [("a", "b:c"), (None, "b"), ("", "b")], "p string, q string")
    got = sampling.numbered(df)
    assert sorted((r.p or "", r.q, r.occurrence) for r in got.collect()) == [("", "b", 1), ("", "b", 1), ("a", "b:c", 1), ("a:b", "c", 1), ("a:b", "c", 2), ("a:b", "c", 3)]
    assert got.select(hash_uniform(1, "p", "q", "occurrence").alias("u")).distinct().count() == 6
    assert sampling.numbered(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [None, "", "same"])
def test_vectors_without_ids_of_their_own(spark, ids):
    rows = [(ids, [float(i % 20), float(i // 20)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, features array<double>").repartition(3)
    got = kmeans_parallel.sketch(df, 3, 10, 2).groupBy("fold").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert len(got) == 2 and sum(r.w for r in got) == 400 and all(140 < r.w < 260 and r.n == 31 for r in got)


def test_sketch_of_nothing_and_by_signatures(spark):
    empty = spark.createDataFrame([], "id string, features array<double>")
    assert kmeans_parallel.sketch(empty, 2, 5, 2).count() == 0
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(str(i), rng.normal(size=8).tolist()) for i in range(300)], "id string, features array<double>")
    near = kmeans_parallel.sketch(df, 3, 30, 1, approx=True, bits=64, candidates=8)
    assert near.count() == 91 and near.agg(F.sum("weight")).first()[0] == 300


def test_signatures_find_the_nearest_of_many(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 16))
    x = points[rng.integers(0, 400, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    index = CentersIndex([Centers(points)], 128, 32)
    exact, near = index.nearest(x)[0][0], index.nearest(x, True)[0][0]
    assert (exact == near).mean() > 0.9


def test_details_are_appended(spark, tmp_path):
    points = spark.createDataFrame([(f, i, [float(i), float(f)], 1.0) for f in range(2) for i in range(12)], "fold int, point_id int, features array<double>, weight double")
    points.write.parquet(f"{tmp_path}/k")
    for _ in range(2):
        assert cli.main(["kmeans", "--input-file", f"{tmp_path}/k", "--clusters", "2", "--best-of", "1", "--centers-file", f"{tmp_path}/c", "--eval-stats-file", f"{tmp_path}/s", "--eval-details-file", f"{tmp_path}/d"], spark) == 0
    lines = (tmp_path / "d").read_text().splitlines()
    assert len(lines) == 5 and lines[0].startswith("ClusteringId") and lines[1:3] == lines[3:5]


def test_lines_reader(spark, tmp_path):
    (tmp_path / "t").write_text("# a\nb\n\n")
    assert [r.value for r in records.read_lines(spark, f"{tmp_path}/t", "#").collect()] == ["b"]
