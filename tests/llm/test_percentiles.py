import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.llm import percentiles as P

NAN, INF = float("nan"), float("inf")
ROWS = [("a", x, i % 3) for i, x in enumerate([3.0, 1.0, 1.0, -2.5, 0.0, -0.0, NAN, None, 1e-300, INF, -INF, 7.0])] + [(None, 5.0, 0), ("b", None, 1), ("", 4.0, 2)]


def brute(values, pct):
    v = sorted(x + 0.0 for x in values if x is not None and x == x)
    return v[max(1, -(-pct * len(v) // 1000)) - 1] if v else None


def groups():
    return {"k": F.col("g"), "all": F.lit("x")}


def test_exact_with_nulls_ties_and_infinities(spark):
    df = spark.createDataFrame(ROWS, "g string, kind double, total int").withColumnRenamed("kind", "v")
    got = {(r.kind, r.value_of, r.pct): r.value for r in P.exact_percentiles(df, groups(), "v", [0, 250, 500, 990, 1000]).collect()}
    for g in ("a", None, ""):
        for p in (0, 250, 500, 990, 1000):
            assert got["k", g, p] == brute([v for k, v, _ in ROWS if k == g], p), (g, p)
    assert ("k", "b", 500) not in got
    assert got["all", "x", 500] == brute([v for _, v, _ in ROWS], 500)
    assert P.exact_percentiles(df.limit(0), groups(), "v").count() == 0


@pytest.mark.parametrize(("bits", "few"), [(3, 200_000), (13, 0), (64, 200_000), (7, 0)])
def test_any_number_of_bisections_and_both_joins(spark, monkeypatch, bits, few):
    monkeypatch.setattr(P, "FEW", few)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(3, 4, 500), np.zeros(300), -rng.lognormal(0, 1, 200)])
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, v double").repartition(5)
    bits = min(bits, 63)
    got = {r.pct: r.value for r in P.exact_percentiles(df, {"k": F.col("g")}, "v", [1, 333, 500, 999], bits).collect()}
    assert got == {p: brute(x.tolist(), p) for p in (1, 333, 500, 999)}


def test_bounded_relative_error(spark):
    x = np.random.default_rng(1).lognormal(0, 3, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for r in P.exact_percentiles(df, {"k": F.lit("a")}, "v", [100, 500, 900], relative_error=0.01).collect():
        assert abs(r.value - brute(x.tolist(), r.pct)) <= 0.011 * r.value


def test_combined_pieces_keep_their_bound(spark):
    rng = np.random.default_rng(2)
    rows = [("g" if i % 4 else None, float(v), int(piece)) for i, (v, piece) in enumerate(zip(rng.lognormal(2, 2, 6000).round(1), rng.integers(0, 6, 6000) ** 2))] + [("g", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, piece int")
    grids = P.percentile_grids(df, {"k": F.col("g")}, "v", F.col("piece"), steps=20)
    assert grids.groupBy("piece", "value_of").count().agg(F.max("count")).first()[0] <= 21
    for r in P.combine_grids(grids, steps=20).collect():
        v = np.sort([x for g, x, _ in rows if g == r.value_of])
        goal = max(1, -(-r.pct * len(v) // 1000))
        low, high = np.searchsorted(v, r.combined if hasattr(r, "combined") else r.value, "left") + 1, np.searchsorted(v, r.value, "right")
        assert r.n == len(v) and low - r.rank_error <= goal <= high + r.rank_error
    small = P.combine_grids(P.percentile_grids(df.limit(15), {"k": F.lit("x")}, "v", F.col("piece"), 20), [500], 20).first()
    assert small.rank_error == 0 and small.value == brute([r.v for r in df.limit(15).collect()], 500)
