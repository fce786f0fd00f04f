import math

import pytest

from veldra.functions.transforms import TRANSFORMS, scale_vector, transform_named
from veldra.functions.vectors import from_storage, int_key, long_key, sparse, svmlight, text_key, to_columns, to_storage
from veldra.operators.formula import INTERCEPT, Term, model_matrix
from veldra.operators.normalize import normalize
from veldra.operators.pivot import pivot_wide
from veldra.operators.summary import Numeric, Summary, level_counts, numeric_profile, summarize
from veldra.roles import Header, resolve
from pyspark.sql import functions as F


def features(df):
    return [list(r.features) for r in df.collect()]


def test_z_of_a_square(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 1.0), (3.0, 1.0), (3.0, 3.0)], "c0 double, c1 double")
    assert features(normalize(df, summarize(df), transform="Z")) == [[-1, 1], [-1, -1], [1, -1], [1, 1]]


def test_missing_values(spark):
    df = spark.createDataFrame([("1.0", "NA", "2.0"), ("1.0", "2.0", "3.0")], "field1 string, field2 string, field3 string")
    s = summarize(df, Header(["field1", "field2", "field3"], ["numeric", "numeric", "ignored"]))
    assert s["field2"].numeric == Numeric(2.0, 2.0, 2.0, 0.0, 1) and s["field3"].is_empty and s.field_count == 2
    assert features(normalize(df, s)) == [[1.0, 2.0]]


def test_one_hot_layout_and_names(spark):
    df = spark.createDataFrame([(1.0, "a", 3.0, "y"), (0.4, "b", 1.0, "x"), (3.2, "c", 29.0, "z")], "p double, q string, r double, s string")
    assert features(normalize(df, summarize(df))) == [[1, 1, 0, 0, 3, 0, 1, 0], [0.4, 0, 1, 0, 1, 1, 0, 0], [3.2, 0, 0, 1, 29, 0, 0, 1]]
    named = normalize(df, summarize(df, ignored=["q"]), "q").collect()
    assert [(r.id, list(r.features)) for r in named] == [("a", [1, 3, 0, 1, 0]), ("b", [0.4, 1, 1, 0, 0]), ("c", [3.2, 29, 0, 0, 1])]


@pytest.mark.parametrize(("name", "x", "want"), [("none", -1.0, 0.0), ("none", 0.2, 0.2), ("none", 10.3, 1.0), ("log", -1.0, 0.0), ("log", 0.0, 0.0), ("log", 1.0, math.log(2)), ("z", 0.7, 2.0), ("linear", 0.25, 0.25)])
def test_transforms(spark, name, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(TRANSFORMS[name](F.col("x"), Numeric(0.0, 1.0, 0.5, 0.1)).alias("y")).first().y
    assert got == pytest.approx(want)


def test_constant_columns_stay_and_unknown_transform_fails(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert features(normalize(df, summarize(df), transform="z")) == [[4.0], [4.0]]
    with pytest.raises(ValueError):
        transform_named("cube")


def test_profile_edge_cases(spark):
    df = spark.createDataFrame([(None, "a", 1), (float("nan"), None, 1), (2.0, "", 1)], "x double, field string, n int")
    r = numeric_profile(df, ["x"]).first()
    assert (r.min, r.max, r.mean, r.std_dev, r.missing, r.n) == (2.0, 2.0, 2.0, 0.0, 2, 3)
    assert sorted((x.level, x.n) for x in level_counts(df, ["field"]).collect()) == [("", 1), ("a", 1)]
    e = numeric_profile(df.limit(0), ["x"]).first()
    assert (e.min, e.mean, e.missing, e.n) == (0.0, 0.0, 0, 0)
    s = summarize(df.limit(0))
    assert s.record_count == 0 and normalize(df.limit(0), s).count() == 0
    assert normalize(df, summarize(df)).count() == 1  # nulls are missing or no level


def test_levels_are_trimmed_in_order_with_exact_counts(spark):
    df = spark.createDataFrame([(x,) for x in "ddccba"], "x string")
    s = summarize(df, max_levels=3)
    assert s["x"].histogram == {"a": 1, "b": 1, "c": 2} and s["x"].trimmed


def test_json_round_trip():
    s = Summary.from_json('{"stats":[{"name":"a","numeric":{"min":0,"max":1,"mean":0.5,"stdDev":0.1,"transform":"Z"},"scale":2.0},{"name":"b","histogram":{"y":{"count":2},"x":{"count":1}}},{"name":"c"}],"recordCount":3,"fieldCount":2}')
    assert Summary.from_json(s.to_json()) == s and s.ignored == ["c"] and s.net_levels() == 1 and s["b"].levels == ["x", "y"]
    assert '"missing"' not in s.to_json() and s.has_stats("a") and not s.has_stats("c")


def test_header():
    h = Header.parse("k,identifier\na,continuous\nb,Symbolic\n\nc,ignore me\nd\n")
    assert h.roles == ["id", "numeric", "symbolic", "ignored", "numeric"] and h.id_column == "k"
    assert Header.parse(h.text()) == h and h.schema()["a"].dataType.simpleString() == "double"
    for bad in ("a,b,c", "a,odd", "a,id\nb,id"):
        with pytest.raises(ValueError):
            Header.parse(bad)
    assert resolve(["a", "b"], "b,a") == ["b", "a"] and resolve(["a", "b"], "1") == ["b"]
    with pytest.raises(ValueError):
        resolve(["a", "b"], "a,z")


def test_svmlight_and_storage(spark):
    df = spark.createDataFrame([("foo", [1.0, 2.0, 3.0])], "id string, f array<double>")
    assert df.select(svmlight(df.f).alias("t"), svmlight(df.f, df.id).alias("u")).first() == ("0:1.0 1:2.0 2:3.0", "foo 0:1.0 1:2.0 2:3.0")
    s = df.select("id", sparse(10, {3: 7.2, 6: 12.0}).alias("f"))
    assert s.select(svmlight(s.f, F.lit("bar")).alias("t")).first().t == "bar 3:7.2 6:12.0"
    back = s.select(from_storage(to_storage(s.f, s.id, True)).alias("f")).first().f
    assert list(back) == [0, 0, 0, 7.2, 0, 0, 12.0, 0, 0, 0]
    assert to_columns(df, "f", 4).first().c3 is None
    keys = spark.createDataFrame([("7",), (None,), ("x",)], "i string")
    assert [tuple(r) for r in keys.select(long_key(keys.i), int_key(keys.i), text_key(keys.i)).collect()] == [(7, 7, "7"), (0, 0, ""), (0, 0, "x")]


def test_scaling(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],)], "f array<double>")
    assert [list(r[0]) for r in df.select(scale_vector(df.f, [0.5, 0.25])).collect()] == [[0.5, 0.5], [1.0, 0.25]]


def test_pivot(spark):
    rows = [("g", "x", 1.0), ("g", "x", 3.0), ("g", "y", None), ("h", "w", 5.0), (None, "y", 2.0)]
    df = spark.createDataFrame(rows, "k string, a string, v double")
    got = {r.k: (r.v_x, r.v_y) for r in pivot_wide(df, ["k"], "a", ["v"], ["y", "x"], "mean").collect()}
    assert got["g"][0] == 2.0 and math.isnan(got["g"][1]) and got["h"] == (0.0, 0.0) and got[None] == (0.0, 2.0)
    assert {r.k: r.v_y for r in pivot_wide(df, ["k"], "a", ["v"], ["y", "x"]).collect()} == {"g": 0.0, "h": 0.0, None: 2.0}
    assert pivot_wide(df.limit(0), ["k"], "a", ["v"], ["x", "y"]).count() == 0
    for kw in ({"levels": ["x"]}, {"levels": ["x", "y"], "how": "max"}):
        with pytest.raises(ValueError):
            pivot_wide(df, ["k"], "a", ["v"], **kw)


def test_formula(spark):
    df = spark.createDataFrame([(17.29, "z"), (1.2, "x"), (2.0, "y"), (1.0, None)], "a double, b string")
    terms = sorted([Term.of("b", "a"), INTERCEPT, Term.of("a")])
    assert [str(t) for t in terms] == ["1", "a", "a:b"]
    got = [list(r[0]) for r in df.select(model_matrix(df, terms, summarize(df))).collect()]
    assert got[:3] == [[1, 17.29, 0, 17.29], [1, 1.2, 0, 0], [1, 2, 2, 0]] and got[3][2] is None
    with pytest.raises(ValueError):
        Term.of()
