import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldra.llm.reservoir import GeometricFile, Reservoir, Segments, merge_draws, reservoir_sample


@pytest.mark.parametrize("memory", [0, 1 << 20])
def test_every_record_is_equally_likely(tmp_path, memory):
    runs, n, k = 200 if memory == 0 else 2000, 300, 30
    counts = np.zeros(n)
    for r in range(runs):
        f = GeometricFile(k, pa.schema([("x", pa.int64())]), np.random.default_rng(r), Segments(f"file://{tmp_path}", memory), buffer=7)
        for a in range(0, n, 41):
            f.add(pa.table({"x": np.arange(a, min(n, a + 41))}))
        s = f.sample()["x"].to_numpy()
        f.segments.close()
        assert len(s) == k == len(set(s.tolist()))
        counts[s] += 1
    e = runs * k / n
    chi2 = ((counts - e) ** 2 / e / (1 - k / n)).sum()
    assert abs(chi2 - (n - 1)) < 5 * np.sqrt(2 * n)
    assert not any(p.is_file() for p in tmp_path.rglob("*"))


def test_segments_shrink_exponentially():
    f = GeometricFile(1000, pa.schema([("x", pa.int64())]), np.random.default_rng(0), Segments("file:///none", 1 << 30), buffer=100)
    f.add(pa.table({"x": np.arange(100_000)}))
    assert sum(f.live) + f.buffer.num_rows >= 1000 and f.seen == 100_000
    assert all(sum(n for _, n in p) >= live for p, live in zip(f.parts, f.live))


def test_merge_draws_follow_populations():
    rng = np.random.default_rng(0)
    got = np.mean([merge_draws({0: 900, 1: 100}, 50, rng).get(1, 0) for _ in range(2000)])
    assert abs(got - 5) < 0.3 and sum(merge_draws({0: 3, 1: 4}, 50, rng).values()) == 7 and merge_draws({}, 5, rng) == {}


def test_sizes_repeats_nulls_and_columns(spark):
    df = spark.createDataFrame([(None, float("nan"), "x")] * 40 + [(1, None, None)] * 10, "__shard bigint, seen double, text string").repartition(3)
    got = reservoir_sample(df, 20)
    assert got.count() == 20 and got.columns == df.columns
    assert reservoir_sample(df, 999).count() == 50 and reservoir_sample(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        Reservoir(spark, 0)


def test_repeatable_and_uniform_over_shards_of_unequal_size(spark):
    hits = np.zeros(3)
    for seed in range(12):
        df = spark.range(0, 60, 1, 1).unionByName(spark.range(60, 90, 1, 1)).unionByName(spark.range(90, 600, 1, 3))
        ids = [r.id for r in reservoir_sample(df, 60, seed).collect()]
        assert len(set(ids)) == 60
        hits += np.histogram(ids, [0, 60, 90, 600])[0]
    assert np.allclose(hits / 12, [6, 3, 51], atol=3)
    a, b = (sorted(r.id for r in reservoir_sample(spark.range(500), 9).collect()) for _ in range(2))
    assert a == b


def test_pieces_of_unequal_size(spark):
    hits = np.zeros(3)
    for seed in range(6):
        r = Reservoir(spark, 40, seed)
        for a, n in ((0, 20), (20, 380), (400, 100)):
            r.add(spark.range(a, a + n, 1, 2))
        ids = [x.id for x in r.sample().collect()]
        assert len(set(ids)) == 40 and r.seen == 500
        hits += np.histogram(ids, [0, 20, 400, 500])[0]
    assert np.allclose(hits / 6, [1.6, 30.4, 8], atol=4)
