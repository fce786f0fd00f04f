import os

import duckdb
import pytest

import __spark_entry__
from veldra.plans.joins import salted_join
from veldra.plans.scratch import Scratch, drop_all

SMALL = "/root/testdata/sf0.001"
SOME = ["summary_dirty", "summary_levels", "normalize_z", "normalize_onehot", "pivot_multi", "sample_grouped", "covar_by_group", "kassign_two_clusterings", "closest_counts", "lloyds_3", "koutlier_topk", "stability", "sketch_round1", "formula_matrix", "csv_roundtrip", "p2_key_sums", "p2_key_sums_local", "p4_found", "p4_report", "sketch_full", "vectors_sequence", "external_table", "typed_records", "summary_json", "evaluation_files", "normalize_joined_levels", "rules_of_arguments", "lsh_recall", "shuffled_layout", "sample_equal_rows", "normalize_dropped"]


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plain(rows):
    show = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    df = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


def test_salted_joins_equal_plain_ones(spark):
    many = spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(50)], "k int, id int")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, salted_join(many, one, ["k"], ["id"], how).collect())) == sorted(map(str, many.join(one, ["k"], how).collect()))


def test_scratch_tables_go_when_told(spark):
    first, second = Scratch(spark, "a"), Scratch(spark, "b")
    for s in (first, second):
        for n in ("x", "y", "z"):
            assert s.put(spark.range(3), n).count() == 3
    first.keep("y")
    assert first.size("y") > 0
    with pytest.raises(Exception, match="does not exist"):
        first.size("x")
    drop_all(spark)
    for s in (first, second):
        with pytest.raises(Exception, match="does not exist"):
            s.size("y")
