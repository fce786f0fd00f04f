import numpy as np
from pyspark.sql import Observation

from veldra.functions import vectors
from veldra.operators import normalize
from veldra.operators.covariance import covariance
from veldra.operators.summary import FieldStats, Numeric, Summary, summarize


def rows(spark):
    return spark.createDataFrame([(f"r{i}", f"w{i * 7 % 40:02d}" if i % 9 else None, float(i) if i % 8 else None, "x") for i in range(120)], "id string, word string, x double, __n0 string")


def test_joined_levels_equal_literal_ones(spark, monkeypatch):
    df = rows(spark)
    s = summarize(df, symbolic=["word"], ignored=["id", "__n0"])
    dense = normalize.normalize(df, s, "id").collect()
    sparse = normalize.normalize(df, s, "id", sparse=True).select("id", vectors.from_storage(normalize.F.col("features")).alias("features")).collect()
    monkeypatch.setattr(normalize, "LITERAL_LEVELS", 3)
    joined = normalize.normalize(df, s, "id").collect()
    key = lambda got: sorted((r.id, tuple(r.features)) for r in got)
    assert key(dense) == key(joined) == key(sparse) and len(dense) == sum(1 for i in range(120) if i % 9 and i % 8)
    assert all(sum(v == 1.0 for v in r.features[:-1]) == 1 for r in dense)


def test_a_sparse_vector_of_very_many_levels_stays_small(spark):
    s = Summary([FieldStats("word", histogram=dict.fromkeys([f"v{i:06d}" for i in range(200_000)], 1)), FieldStats("x", Numeric(0, 9, 1, 1))])
    df = spark.createDataFrame([("v000000", 1.0), ("v199999", 0.0), ("other", 2.0)], "word string, x double")
    got = sorted(tuple(r.features.indices) for r in normalize.normalize(df, s, sparse=True).collect())
    assert got == [(0, 200_000), (199_999,)]


def test_dropped_rows_are_counted(spark):
    df, seen = rows(spark), Observation("d")
    s = summarize(df, symbolic=["word"], ignored=["id", "__n0"])
    s["word"].histogram.pop("w07")
    n = normalize.normalize(df, s, "id", dropped=seen).count()
    assert seen.get["rows"] == 120 and seen.get["missing_number"] == 15 and seen.get["unknown_level"] == 14 + 2 and n < 120 - 15


def test_storage_form_of_any_vector(spark):
    data = [[0.0, 0.0, 0.0], [1.0, 0.0, 2.0], [0.0, 5.0, 0.0], [1.0, 2.0, 3.0], []]
    df = spark.createDataFrame([(v,) for v in data], "f array<double>")
    back = df.select("f", vectors.from_storage(vectors.to_storage(df.f, None, True)).alias("g")).collect()
    assert all(list(r.f) == list(r.g) for r in back)


def test_covariance_of_narrow_and_wide_vectors(spark):
    rng = np.random.default_rng(4)
    data = [(k, (rng.normal(size=10) + 1e6).tolist()) for k in ("a", "b", None) for _ in range(50)] + [("a", [float("nan")] * 10), ("b", None)]
    df = spark.createDataFrame(data, "k string, f array<double>").repartition(3)
    wide = {(r.k, r.row, r.column): r for r in covariance(df, "f", ["k"]).collect()}
    narrow = {(r.k, r.row, r.column): r for r in covariance(df.selectExpr("k", "slice(f, 1, 3) as f"), "f", ["k"]).collect()}
    assert len(wide) == 3 * 55 and len(narrow) == 3 * 6
    for key, r in narrow.items():
        x = np.array([v for k, v in data[:150] if k == key[0]])
        want = np.cov(x[:, key[1]], x[:, key[2]], bias=True)[0, 1]
        assert r.n == wide[key].n == 50 and abs(r.cov - want) < 1e-6 and abs(wide[key].cov - want) < 1e-6
    assert covariance(df.limit(0), "f", ["k"]).count() == 0 == covariance(df.limit(0), "f").count()
