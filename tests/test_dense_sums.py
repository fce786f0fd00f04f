import random

import pytest
from pyspark.sql import functions as F

from veldra.operators.dense_sums import heavy_keys, key_sums

SCHEMA = "a string, b string, v bigint, n_rows int, __code string"


def plain(rows):
    out = {}
    for a, b, v, *_ in rows:
        n, s = out.get((a, b), (0, None))
        out[a, b] = (n + 1, s if v is None else (s or 0) + v)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equals_brute_force_with_nulls_ties_skew_and_clashing_columns(spark, limit):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "x", "x", None, "", "1:a"]), rng.choice(["p", None, "q,-"]), rng.choice([None, 0, -5, 2**62, 7]), 1, "z") for _ in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.a, r.b): (r.n_rows, None if r.value_sum is None else int(r.value_sum)) for r in key_sums(df, ["a", "b"], "v", limit).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_empty_table(spark, limit):
    assert key_sums(spark.createDataFrame([], SCHEMA), ["a", "b"], "v", limit).count() == 0
    assert heavy_keys(spark.createDataFrame([], SCHEMA), ["a", "b"], "v").count() == 0


def test_heavy_keys_count_null_parts_in_the_total_only(spark):
    rows = [("h", "h", 1)] * 2 + [(None, "h", 1)] * 60 + [("l", "l", 1)] + [(f"k{i}", "k", 1) for i in range(37)]
    df = spark.createDataFrame(rows, "a string, b string, v bigint")
    assert [(r.a, r.n_rows) for r in heavy_keys(df, ["a", "b"], "v", 50).collect()] == [("h", 2)]


def test_a_hot_key_is_one_element_per_split(spark):
    df = spark.range(200_000, numPartitions=4).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("a"), F.lit("b").alias("b"), F.col("id").alias("v"))
    got = {r.a: r.n_rows for r in key_sums(df, ["a", "b"], "v").collect()}
    assert got["hot"] == 133_333 and sum(got.values()) == 200_000
