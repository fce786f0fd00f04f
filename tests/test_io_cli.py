import json

import pytest
from pyspark.sql import functions as F

from veldra import cli
from veldra.operators.summary import summarize
from veldra.roles import Header
from veldra.sources import records
from veldra.streaming import maps


def test_text_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1.0,"a,b,c",3.0,y\n# note\n\n0.4,"d ""e""",NA,x\n')
    (tmp_path / "b.csv").write_text("1.0,z,3.0,y\n")
    h = Header.parse("p\nq,symbolic\nr\ns,symbolic")
    df = records.read_records(spark, "TEXT", f"{tmp_path}/a.csv,{tmp_path}/b.csv", h, comment="#")
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows == [(0.4, 'd "e"', None, "x"), (1.0, "a,b,c", 3.0, "y"), (1.0, "z", 3.0, "y")]
    with pytest.raises(ValueError):
        records.read_records(spark, "text", "x")
    with pytest.raises(ValueError):
        records.read_records(spark, "odd", "x")


@pytest.mark.parametrize("format", ["parquet", "seq"])
@pytest.mark.parametrize("sparse", [False, True])
def test_vectors_round_trip(spark, tmp_path, format, sparse):
    df = spark.createDataFrame([("7", [1.0, 0.0, 3.5]), ("8", [0.0, 0.0, 0.0])], "id string, features array<double>")
    for _ in range(2):  # the second one overwrites
        records.write_vectors(df, f"file://{tmp_path}/v", format, sparse=sparse, key="long")
    got = {r.id: list(r.features) for r in records.read_vectors(spark, f"file://{tmp_path}/v", format).collect()}
    assert got == {"7": [1.0, 0.0, 3.5], "8": [0.0, 0.0, 0.0]}
    assert records.read_records(spark, "seq", f"file://{tmp_path}/v").columns == ["c0", "c1", "c2"] if format == "seq" else True


def test_record_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None)], "n int, t string, e double")
    records.write_records(df, f"{tmp_path}/q", "csv")
    assert spark.read.schema(df.schema).csv(f"{tmp_path}/q", escape='"').collect() == df.collect()
    records.write_records(df, f"{tmp_path}/x", "csv", "|", exact=True)
    assert spark.read.text(f"{tmp_path}/x").first().value == '1|a "b", c|'
    records.write_vectors(spark.createDataFrame([("", [0.0, 2.0])], "id string, features array<double>"), f"{tmp_path}/s", "svmlight")
    assert spark.read.text(f"{tmp_path}/s").first().value == "1:2.0"


def test_external_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "x")], "n tinyint, f float, s string")
    records.drop_table(spark, "default.veldra_t")
    records.write_records(df, f"file://{tmp_path}/t", "parquet", table="veldra_t")
    assert not records.external_table(spark, "veldra_t", df.schema, f"file://{tmp_path}/t")
    got = records.read_records(spark, "hive", "veldra_t", where="n = 1")
    assert got.dtypes == [("n", "int"), ("f", "double"), ("s", "string")] and got.count() == 1
    records.drop_table(spark, "veldra_t")
    assert records.table_name("foo") == ("default", "foo") and records.table_name("foo.bar.baz") == ("foo", "bar.baz")


def test_streaming_normalize_equals_batch(spark, tmp_path):
    from veldra.operators.normalize import normalize

    df = spark.createDataFrame([(f"i{k}", float(k)) for k in range(20)], "id string, x double")
    df.write.parquet(f"{tmp_path}/in")
    s = summarize(df, ignored=["id"])
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    maps.to_table(maps.normalize_stream(stream, s, "id", "z"), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(normalize(df, s, "id", "z").collect())


def run(spark, *args):
    return cli.main([str(a) for a in args], spark)


def test_the_whole_way_by_commands(spark, tmp_path, capsys):
    rows = [(f"v{k}", float(k % 2 * 10 + k % 5), "a" if k % 2 else "b", float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, x double, kind string, w double").repartition(2)
    records.write_records(df, f"{tmp_path}/data", "csv")
    (tmp_path / "h").write_text("id,id\nx,continuous\nkind,symbolic\nw,ignored\n")
    data = ["--input-paths", f"{tmp_path}/data", "--format", "text", "--header-file", f"{tmp_path}/h"]
    assert run(spark, "summary", *data, "--summary-file", f"{tmp_path}/s.json") == 0
    assert json.loads((tmp_path / "s.json").read_text())["recordCount"] == 60
    assert run(spark, "normalize", "--input-paths", f"{tmp_path}/data", "--format", "text", "--summary-file", f"{tmp_path}/s.json", "--id-column", "id", "--transform", "Z", "--output-path", f"{tmp_path}/v") == 0
    vectors = ["--input-paths", f"{tmp_path}/v", "--format", "parquet"]
    assert run(spark, "showvec", *vectors, "--count", 3) == 0 and "v" in capsys.readouterr().out
    assert run(spark, "ksketch", *vectors, "--points-per-iteration", 8, "--iterations", 2, "--output-file", f"{tmp_path}/k") == 0
    assert run(spark, "kmeans", "--input-file", f"{tmp_path}/k", "--clusters", "1,2", "--best-of", 2, "--centers-file", f"{tmp_path}/c", "--eval-stats-file", f"{tmp_path}/stats.csv", "--eval-details-file", f"{tmp_path}/d.csv") == 0
    assert (tmp_path / "stats.csv").read_text().startswith("ID,NumClusters") and len((tmp_path / "stats.csv").read_text().splitlines()) == 4
    centers = ["--centers-file", f"{tmp_path}/c", "--center-ids", "1"]
    assert run(spark, "lloyds", *vectors, *centers, "--output-centers-file", f"{tmp_path}/c2", "--compute-costs") == 0 and "CenterId,Cost" in capsys.readouterr().out
    assert run(spark, "kassign", *vectors, *centers, "--output-path", f"{tmp_path}/a", "--output-type", "parquet") == 0
    assert spark.read.parquet(f"{tmp_path}/a").groupBy("closest_center_id").count().count() == 2
    assert run(spark, "kcovar", *vectors, *centers, "--output-file", f"{tmp_path}/cov") == 0
    assert run(spark, "koutlier", *vectors, *centers, "--covariance-file", f"{tmp_path}/cov", "--output-path", f"{tmp_path}/o", "--output-type", "parquet") == 0
    assert spark.read.parquet(f"{tmp_path}/o").count() == 60
    assert run(spark, "sample", *data, "--size", 5, "--group-fields", "kind", "--output-path", f"{tmp_path}/g", "--output-type", "parquet") == 0
    assert spark.read.parquet(f"{tmp_path}/g").groupBy("kind").count().collect()[0][1] == 5
    assert run(spark, "pivot", *data, "--id-fields", "id", "--value-fields", "x", "--var-field", "kind", "--var-levels", "a,b", "--output-path", f"{tmp_path}/p", "--output-type", "parquet") == 0
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["id", "x_a", "x_b"]
    assert run(spark, "help") == 0 and run(spark) == 1 and run(spark, "nothing") == 1
    assert run(spark, "sample", *data, "--output-path", f"{tmp_path}/z") == 1 and "Command Error" in capsys.readouterr().err


def test_header_command(spark, tmp_path):
    records.drop_table(spark, "veldra_h")
    spark.createDataFrame([(1, "a")], "n int, s string").write.option("path", f"file://{tmp_path}/t").saveAsTable("veldra_h")
    assert run(spark, "header", "--table", "veldra_h", "--header-file", f"{tmp_path}/h") == 0
    assert (tmp_path / "h").read_text() == "n,numeric\ns,symbolic\n"
    records.drop_table(spark, "veldra_h")
