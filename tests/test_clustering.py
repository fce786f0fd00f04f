import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldra.operators.assign import assign, closest_counts, cluster_covariances, costs, outliers
from veldra.operators.centers import Centers, CentersIndex, centers_from, centers_table
from veldra.operators.covariance import CoMoment, covariance, dense_matrix, inverse
from veldra.operators.evaluate import details_csv, evaluate_sketch, stability, prediction_strength, stats_csv
from veldra.operators.kmeans_local import grid, kmeans, lloyds as local_lloyds, mini_batch, plus_plus, select_best, weighted_centroid
from veldra.operators.kmeans_parallel import lloyds, sketch
from veldra.operators.sampling import bernoulli_sample, clean_weight, crossfold, cv_replicate, grouped_sample, shuffled, uniform_sample, weighted_draws, weighted_pick, weighted_sample

POINTS = np.array([(1, 1), (5, 4), (4, 3), (2, 1)], float)


@pytest.fixture(scope="module")
def sixteen(spark):
    return spark.createDataFrame([(str(i), POINTS[i % 4].tolist()) for i in range(16)], "id string, features array<double>")


def test_costs_and_lloyds_of_sixteen_points(sixteen):
    one, two, three = Centers([(1, 1)]), Centers([(1, 1), (5, 4)]), Centers([(1, 1), (5, 4), (4, 3)])
    got = {r.cluster_id: r.cost for r in costs(sixteen, {1: Centers([(3, 2.25)]), 2: Centers([(1.5, 1), (4.5, 3.5)]), 3: three}).collect()}
    assert got[2] == 6.0 and got[3] == 4.0 and got[1] == pytest.approx(67.0)
    assert lloyds(sixteen, {0: two}, 3)[0] == Centers([(1.5, 1), (4.5, 3.5)])
    assert lloyds(sixteen, {0: one}, 0)[0] == one
    with pytest.warns(UserWarning):
        assert len(lloyds(sixteen, {0: Centers([(1, 1), (99, 99)])}, 1)[0]) == 1
    assert [r.n for r in closest_counts(sixteen, {0: Centers([(1, 1), (99, 99)])}).orderBy("center_id").collect()] == [16, 0]


def test_assignment_edge_cases(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), (None, [2.0, 0.0]), ("n", None), ("m", [None, 1.0]), ("i", [float("nan"), 1.0]), ("t", [1.0, 0.0])], "id string, features array<double>")
    got = {r.vector_id: (r.closest_center_id, r.distance) for r in assign(df, {0: Centers([(0, 0), (2, 0)])}).collect()}
    assert got == {"a": (0, 0.0), "": (1, 0.0), "t": (0, 1.0)}
    assert assign(df.limit(0), {0: Centers([(0, 0)])}).count() == 0
    with pytest.raises(Exception, match="elements"):
        assign(df, {0: Centers([(0, 0, 0)])}).count()


def test_centers():
    a, b, c = (17, 29), (18, 27), (16, 25)
    assert Centers([a]).distances([a, b, c])[:, 0].tolist() == [0, 5, 17]
    at, d2 = Centers([a, b]).closest([a, b, c])
    assert at.tolist() == [0, 1, 1] and d2.tolist() == [0, 0, 8]
    assert len(Centers([a, b, a])) == 2 and Centers([a, b]) == Centers([b, a]) and len(Centers([a]).extended([b, a])) == 2
    assert Centers([a]).squared_difference(Centers([b])) == 5
    with pytest.raises(ValueError):
        Centers([a]).squared_difference(Centers([a, b]))


def test_matmul_path_equals_direct_and_index_recall():
    rng = np.random.default_rng(0)
    c, x = Centers(rng.standard_normal((200, 16))), rng.standard_normal((2000, 16))
    exact = c.distances(x).argmin(1)
    assert (c.closest(x)[0] == exact).all()
    near = CentersIndex([c], bits=128, candidates=32).nearest(x, True)[0][0]
    assert (near == exact).mean() > 0.9
    tied = Centers(np.concatenate([np.eye(40), -np.eye(40)]))
    assert (tied.closest(np.zeros((3, 40)))[0] == 0).all()


def test_centers_table_round_trip(spark):
    df = centers_table(spark, {0: Centers([(1, 2)]), 4: Centers([(1, 2), (3, 4)])})
    assert centers_from(df)[4] == Centers([(1, 2), (3, 4)]) and list(centers_from(df, [0])) == [0]
    with pytest.raises(ValueError):
        centers_from(df, [9])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=2, max_size=40), st.integers(0, 40))
def test_comoments_merge_like_one_pass(rows, cut):
    x = np.array(rows)
    cut = min(cut, len(x))
    a, b, whole = CoMoment.of(x[:cut]), CoMoment.of(x[cut:]), CoMoment.of(x)
    for m in (a.merge(b), b.merge(a)):
        assert np.allclose(m.c, whole.c, atol=1e-4) and np.allclose(m.mean, whole.mean)


def test_covariances(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (1, [0.0, 1.0, 2.0]), (1, [-1.0, 0.0, 4.0]), (1, [17.0, 29.0, 1729.0]), (2, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (2, None)]
    df = spark.createDataFrame(rows, "key int, features array<double>").repartition(3)
    got = {(r.key, r.row, r.column): r.cov for r in covariance(df, by=["key"]).collect()}
    assert len(got) == 18
    want = np.cov(np.array([r[1] for r in rows[:4]]).T, bias=True)
    assert all(np.isclose(got[1, i, j], want[i, j]) for i in range(3) for j in range(i, 3)) and got[2, 0, 0] == 0 and got[None, 2, 2] == 0
    assert covariance(df.where("key = 1")).count() == 6 and covariance(df.limit(0)).count() == 0


def test_inverses_and_outliers(sixteen):
    m = np.array([[2.0, 1], [1, 3]])
    for how in ("lu", "svd", "QR"):
        assert np.allclose(inverse(m, how) @ m, np.eye(2))
    assert dense_matrix([(0, 1, 5.0)], 2).tolist() == [[0, 5], [5, 0]]
    two = {0: Centers([(1.5, 1), (4.5, 3.5)])}
    cov = cluster_covariances(sixteen, two)
    got = {r.vector_id: r.outlier_distance for r in outliers(sixteen, two, cov).collect()}
    assert len(got) == 16 and got["0"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="no covariance"):
        outliers(sixteen, {0: Centers([(1, 1), (9, 9), (99, 99)])}, cov)


def test_local_kmeans():
    w = np.ones(4)
    assert weighted_centroid(POINTS, w).tolist() == [3, 2.25] and weighted_centroid(POINTS[:2], np.array([1.0, 3])).tolist() == [4, 3.25]
    assert kmeans(POINTS, w, 2, update=local_lloyds(10)) == Centers([(1.5, 1), (4.5, 3.5)])
    assert len(plus_plus(POINTS, w, 9, np.random.default_rng(0))) == 4
    assert len(kmeans(POINTS, w, 2, "random", mini_batch(10, 4))) == 2
    runs = grid(POINTS, w, [1, 2], best_of=3, update=local_lloyds(10))
    assert [len(r) for r in runs] == [1, 2, 2, 2] and select_best(runs, POINTS, w) > 0


def test_sketch_reaches_all_points(sixteen):
    rows = sketch(sixteen, rounds=3, per_round=4, folds=2).collect()
    assert sum(r.weight for r in rows) == 16 and {r.fold for r in rows} == {0, 1}


def test_stability(spark):
    stats, details = evaluate_sketch(Centers([(1.5, 1), (4.5, 3.5)]), Centers([(1.5, 1), (4.5, 3.5)]), np.repeat(POINTS, 4, axis=0), np.ones(16))
    assert stats["PredStrength"] == 1.0 and stats["TestCost"] == 6.0 and stats["StablePoints"] == 1.0
    assert stats_csv([stats]).splitlines()[1] == "0,2,6.00,6.00,1.0000,1.00,1.0000" and details_csv(details).count("\n") == 3
    cross = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (1, 1, 1.0)], "test_id int, train_id int, weight double")
    got = {r.test_id: r.strength for r in prediction_strength(cross).collect()}
    assert got == {0: 0.5, 1: 1.0} and stability(prediction_strength(cross), 2).first().pred_strength == 0.5
    assert stability(prediction_strength(cross), 9).first().pred_strength == float("inf")


def test_samples(spark):
    items = spark.createDataFrame([(f"i{k}", 1.0, k % 2) for k in range(50)], "id string, w double, g int")
    assert uniform_sample(items, 5, ["id"]).count() == 5 and uniform_sample(items, 99, ["id"]).count() == 50 and uniform_sample(items.limit(0), 5, ["id"]).count() == 0
    assert grouped_sample(items, 3, ["g"], ["id"]).groupBy("g").count().collect()[0][1] == 3
    assert 0 < bernoulli_sample(items, 0.5, ["id"]).count() < 50
    with pytest.raises(ValueError):
        bernoulli_sample(items, 1.0, ["id"])
    folds = crossfold(items, 4, ["id"])
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, crossfold(items.repartition(7), 4, ["id"]).collect()))
    assert cv_replicate(items, 4, ["id"]).count() == 150 and shuffled(items, 3, ["id"]).count() == 50
    w = spark.createDataFrame([(2.0,), (0.0,), (-1.0,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in w.select(clean_weight(w.x, True, 4.0)).collect()] == [0.5, 0.25, 0.25, 0.25, 0.25]
    assert weighted_sample(w.withColumn("id", F.col("x")), 9, ["id"], clean_weight(w.x)).count() == 1


def test_weighted_inclusion_frequencies():
    w, counts = [200, 400, 100, 100], np.zeros(4)
    for k in range(4000):
        counts[weighted_pick(w, 2, np.random.default_rng(k))] += 1
    # exact inclusion chances of two draws without replacement
    want = [sum(a / 800 * b / (800 - a) for i, a in enumerate(w) for j, b in enumerate(w) if i != j and k in (i, j)) for k in range(4)]
    assert np.allclose(counts / 4000, want, atol=0.03)
    assert len(weighted_pick([], 3, np.random.default_rng(0))) == 0 and len(weighted_pick([1, 1], 5, np.random.default_rng(0))) == 2
    assert np.allclose(np.bincount(weighted_draws([0, 3, 1], 4000, np.random.default_rng(0)), minlength=3) / 4000, [0, 0.75, 0.25], atol=0.03)
