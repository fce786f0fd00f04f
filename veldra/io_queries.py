"""Queries of sources, sinks and small models: written, read back and compared with what the tables hold."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.catalog import Catalog, table
from veldra.functions import transforms, vectors
from veldra.functions.uniform import sql_uniform
from veldra.operators import assign, centers, evaluate, normalize, pivot, sampling, summary
from veldra.operators.covariance import covariance, dense_matrix, inverse
from veldra.plans.scratch import Scratch
from veldra.roles import Header, resolve
from veldra.sources import records

CATALOG = Catalog()
query = CATALOG.query

_LINE = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


def _place(spark, label: str) -> str:
    return f"{Scratch(spark, label).path}/data"


def _vectors(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return rows.select(F.expr(_LINE).alias("id"), F.array((rows.l_linenumber - 1).cast("double"), rows.l_quantity.cast("double"), rows.l_discount.cast("double")).alias("features"))


_VECTORS_SQL = f"SELECT {_LINE} AS id, CAST(l_linenumber - 1 AS DOUBLE) AS c0, CAST(l_quantity AS DOUBLE) AS c1, round(CAST(l_discount AS DOUBLE), 6) + 0.0 AS c2 FROM lineitem"


def _columns(v: DataFrame) -> DataFrame:
    wide = vectors.to_columns(v, "features", 3)
    return wide.withColumn("c2", F.round("c2", 6) + 0.0)


@query(_VECTORS_SQL)
def vectors_parquet(spark, folder):
    """Vectors of all of lineitem in the sparse storage form, and back."""
    path = _place(spark, "vp")
    records.write_vectors(_vectors(spark, folder), path, "parquet", sparse=True)
    return _columns(records.read_vectors(spark, path))


@query(_VECTORS_SQL)
def vectors_sequence(spark, folder):
    """Vectors as a keyed sequence file, and back."""
    path = _place(spark, "vs")
    records.write_vectors(_vectors(spark, folder), path, "seq", key="text")
    return _columns(records.read_vectors(spark, path, "seq"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, round(CAST(o_totalprice AS DOUBLE), 4) + 0.0 AS c0 FROM orders")
def vectors_long_keys(spark, folder):
    """A sequence file keyed by 64-bit numbers, compressed."""
    rows = table(spark, folder, "orders")
    path = _place(spark, "vk")
    records.write_vectors(rows.select(rows.o_orderkey.cast("string").alias("id"), F.array(rows.o_totalprice.cast("double")).alias("features")), path, "seq", key="long")
    return records.read_vectors(spark, path, "seq").select("id", (F.round(F.col("features")[0], 4) + 0.0).alias("c0"))


@query("SELECT CAST(c0 AS DOUBLE) AS c0, CAST(c1 AS DOUBLE) AS c1 FROM (SELECT l_linenumber - 1 AS c0, l_quantity AS c1 FROM lineitem)")
def sequence_records(spark, folder):
    """Vectors of a sequence file as records."""
    path = _place(spark, "sr")
    records.write_vectors(_vectors(spark, folder).withColumn("features", F.slice("features", 1, 2)), path, "seq")
    return records.read_records(spark, "seq", path)


@query(f"SELECT {_LINE} || CASE WHEN l_linenumber > 1 THEN ' 0:' || CAST(CAST(l_linenumber - 1 AS DOUBLE) AS VARCHAR) ELSE '' END || ' 1:' || CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR) AS value FROM lineitem")
def svmlight_files(spark, folder):
    path = _place(spark, "sv")
    records.write_vectors(_vectors(spark, folder).withColumn("features", F.slice("features", 1, 2)), path, "svmlight")
    return spark.read.text(path)


@query("SELECT o_orderkey, o_orderstatus, round(CAST(o_totalprice AS DOUBLE), 4) AS o_totalprice FROM orders")
def records_parquet(spark, folder):
    """Typed records written as parquet and read by format name."""
    path = _place(spark, "rp")
    records.write_records(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice").cast("double"), 4).alias("o_totalprice")), path, "parquet", compress=True)
    return records.read_records(spark, "parquet", path)


@query("SELECT CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus AS value FROM orders")
def records_sequence(spark, folder):
    """Records as texts of a sequence file."""
    path = _place(spark, "rs")
    records.write_records(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), path, "seq", "|")
    return records.read_sequence_lines(spark, path)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def external_table(spark, folder):
    """An external table over written files, scanned with a partition filter, then dropped."""
    name, path = f"veldra_{uuid.uuid4().hex}", _place(spark, "et")
    records.write_records(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), path, "parquet", table=name)
    kept = Scratch(spark, "external").put(records.read_records(spark, "hive", name, where="o_orderstatus = 'F'"), "rows")
    records.drop_table(spark, name)
    return kept


_EXACT = "o_orderkey, o_custkey, o_orderstatus"


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus FROM orders")
def text_with_comments(spark, folder):
    """Delimited text with comments and empty lines between the rows."""
    rows, path = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), _place(spark, "tc")
    lines = records.csv_lines(rows, ";")
    noise = lines.select(F.explode(F.array(F.lit("# no row; 1; 2"), F.lit(""))).alias("value"))
    lines.unionByName(noise).write.text(path)
    return records.read_records(spark, "text", path, Header.of_schema(rows.schema), delimiter=";", comment="#")


@query("SELECT value FROM (SELECT CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus AS value FROM orders)")
def text_lines(spark, folder):
    """Lines without a header, as they are sampled."""
    path = _place(spark, "tl")
    records.write_records(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), path, "csv", exact=True)
    return records.read_lines(spark, path)


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS INTEGER) AS p_size, p_size > 25 AS large, p_brand FROM part")
def typed_records(spark, folder):
    """Text to records of a schema of long, int, boolean and string columns."""
    rows = table(spark, folder, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"), (F.col("p_size") > 25).alias("large"), "p_brand")
    path = _place(spark, "tr")
    records.write_records(rows, path, "csv")
    return records.read_typed(spark, path, rows.schema)


@query("""SELECT 'c_acctbal' AS field, round(min(c_acctbal), 4) AS low, round(max(c_acctbal), 4) AS high, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std_dev, CAST(NULL AS BIGINT) AS n FROM customer
UNION ALL SELECT c_mktsegment, NULL, NULL, NULL, NULL, count(*) FROM customer GROUP BY 1""")
def summary_json(spark, folder):
    """A summary written as JSON and read again."""
    s = summary.summarize(table(spark, folder, "customer").select("c_acctbal", "c_mktsegment"))
    with tempfile.NamedTemporaryFile("r", suffix=".json") as f:  # on the driver, as the command's file is
        s.save(f.name)
        s = summary.Summary.load(f.name)
    n = s["c_acctbal"].numeric
    rows = [("c_acctbal", *(round(v, 4) for v in (n.min, n.max, n.mean, n.std_dev)), None)] + [(k, None, None, None, None, v) for k, v in s["c_mktsegment"].histogram.items()]
    return spark.createDataFrame(rows, "field string, low double, high double, mean double, std_dev double, n bigint")


@query("SELECT 'ID,NumClusters,TestCost,TrainCost,PredStrength,StableClusters,StablePoints' AS line UNION ALL SELECT '0,2,2.00,2.00,1.0000,1.00,1.0000' UNION ALL SELECT 'ClusteringId,CenterId,NumPoints,PredictionStrength' UNION ALL SELECT '0,0,' || CAST(count(*) AS VARCHAR) || ',1.0000' FROM region WHERE r_regionkey < 3 UNION ALL SELECT '0,1,2,1.0000' FROM region WHERE r_regionkey = 3")
def evaluation_files(spark, folder):
    """Lines of the statistics and details files of a clustering of the five regions' numbers."""
    x = np.array([[float(r.r_regionkey if r.r_regionkey < 3 else r.r_regionkey + 6.5 * (r.r_regionkey > 2))] for r in table(spark, folder, "region").orderBy("r_regionkey").collect()])
    x[3:] = 10.0
    both = centers.Centers([[1.0], [10.0]])
    stats, details = evaluate.evaluate_sketch(both, both, x, np.ones(len(x)))
    lines = (evaluate.stats_csv([stats]) + evaluate.details_csv(details)).splitlines()
    return spark.createDataFrame([(v,) for v in lines], "line string")


@query(f"SELECT {_LINE} AS id, round(CAST(l_tax AS DOUBLE), 6) + 0.0 AS c0, CAST(l_quantity AS DOUBLE) AS c1 FROM lineitem")
def normalize_unknown_columns(spark, folder):
    """A column that the summary doesn't know passes raw; one without statistics gives nothing."""
    rows = table(spark, folder, "lineitem").select(F.expr(_LINE).alias("id"), "l_tax", "l_quantity", "l_discount")
    s = summary.summarize(rows.select("l_quantity"))
    s.fields.append(summary.FieldStats("l_discount"))
    v = vectors.to_columns(normalize.normalize(rows, s, "id"), "features", 2)
    return v.withColumn("c0", F.round("c0", 6) + 0.0)


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 6 AS size, CAST(i AS INTEGER) AS place FROM part JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT p_brand AS v FROM part)) ON v = p_brand".replace("6 AS size", "(SELECT CAST(count(DISTINCT p_brand) AS INTEGER) FROM part) AS size"))
def normalize_joined_levels(spark, folder):
    """Levels looked up by a join, as they are when there are very many."""
    rows = table(spark, folder, "part").select("p_partkey", "p_brand")
    s, most = summary.summarize(rows, ignored=["p_partkey"]), normalize.LITERAL_LEVELS
    try:
        normalize.LITERAL_LEVELS = 1
        v = normalize.normalize(rows, s, "p_partkey", sparse=True)
    finally:
        normalize.LITERAL_LEVELS = most
    return v.select("id", F.col("features.size").alias("size"), F.col("features.indices")[0].alias("place"))


@query("SELECT 'by name' AS how, 'o_custkey,o_orderstatus' AS found UNION ALL SELECT 'by place', 'o_custkey,o_orderstatus' UNION ALL SELECT 'unknown', 'error' UNION ALL SELECT 'transform', 'log' UNION ALL SELECT 'unknown transform', 'error' UNION ALL SELECT 'one level', 'error' UNION ALL SELECT 'value is text', 'error'")
def rules_of_arguments(spark, folder):
    """Columns by name or place, transforms by name in any case, and what is refused."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")

    def tried(f) -> str:
        try:
            return f()
        except ValueError:
            return "error"

    found = {
        "by name": lambda: ",".join(resolve(orders.columns, "o_custkey,o_orderstatus")),
        "by place": lambda: ",".join(resolve(orders.columns, "1,2")),
        "unknown": lambda: ",".join(resolve(orders.columns, "nothing")),
        "transform": lambda: transforms.transform_named("LOG").__name__,
        "unknown transform": lambda: transforms.transform_named("cube").__name__,
        "one level": lambda: str(pivot.pivot_wide(orders, ["o_custkey"], "o_orderstatus", ["o_orderkey"], ["F"])),
        "value is text": lambda: str(pivot.pivot_wide(orders, ["o_custkey"], "o_orderstatus", ["o_orderstatus"], ["F", "O"])),
    }
    return spark.createDataFrame([(k, tried(f)) for k, f in found.items()], "how string, found string")


_EMBEDDED = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_D2 = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _embedded(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def _first(spark, folder, k: int) -> centers.Centers:
    rows = table(spark, folder, "embeddings").where(F.col("vec_id") < k).orderBy("vec_id").collect()
    return centers.Centers([r.embedding for r in rows])


@query(f"""WITH p AS ({_EMBEDDED}), d AS (SELECT p.id, CAST(c.id AS INTEGER) AS c, {_D2} AS d2 FROM p, p AS c WHERE CAST(c.id AS INTEGER) < 40)
SELECT id AS vector_id, c AS closest_center_id, round(d2, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, c) AS r FROM d) WHERE r = 1""")
def kassign_many_centers(spark, folder):
    """Forty centers, whose distances are taken by matrix products first."""
    out = assign.assign(_embedded(spark, folder), {0: _first(spark, folder, 40)}).drop("cluster_id")
    return out.withColumn("distance", F.round("distance", 6) + 0.0)


@query("SELECT count(*) AS n, TRUE AS enough FROM embeddings")
def lsh_recall(spark, folder):
    """Whether the index by signatures finds the nearest center for at least nine of ten vectors."""
    # centers near the vectors, as those of a clustering are: means of pairs of them
    first = _first(spark, folder, 200).points
    known = {0: centers.Centers(((first[::2] + first[1::2]) / 2).tolist())}
    rows = _embedded(spark, folder)
    near, exact = assign.assign(rows, known, approx=True, bits=256, candidates=32), assign.assign(rows, known)
    both = near.alias("a").join(exact.alias("b"), "vector_id")
    same = F.avg((F.col("a.closest_center_id") == F.col("b.closest_center_id")).cast("double"))
    return both.agg(F.count("*").alias("n"), (same >= 0.9).alias("enough"))


@query("SELECT how, TRUE AS is_inverse FROM (VALUES ('lu'), ('qr'), ('svd')) AS t(how)")
def matrix_inverses(spark, folder):
    """The covariance of three columns of lineitem, inverted in each way and multiplied back."""
    rows = table(spark, folder, "lineitem")
    cells = covariance(rows.select(F.array(*[rows[c].cast("double") for c in ("l_quantity", "l_discount", "l_tax")]).alias("features"))).collect()
    a = dense_matrix([(r.row, r.column, r.cov) for r in cells], 3)
    return spark.createDataFrame([(how, bool(np.allclose(a @ inverse(a, how), np.eye(3)))) for how in ("lu", "qr", "svd")], "how string, is_inverse boolean")


@query("SELECT 'dense' AS how, 3 AS size, 0.0 AS total UNION ALL SELECT 'of', 2, 3.5 UNION ALL SELECT 'sparse', 4, 7.0".replace("0.0 AS", "CAST(0 AS DOUBLE) AS"))
def vector_factory(spark, folder):
    made = {"dense": vectors.dense(3), "of": vectors.of(1.5, 2), "sparse": vectors.sparse(4, {2: 7.0})}
    rows = table(spark, folder, "region").where("r_regionkey = 0").select(F.explode(F.array(*[F.struct(F.lit(k).alias("how"), v.alias("v")) for k, v in made.items()])).alias("x"))
    return rows.select("x.how", F.size("x.v").alias("size"), F.aggregate("x.v", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("SELECT 'without replacement' AS how, 50 AS n, TRUE AS fits UNION ALL SELECT 'with replacement', 50, TRUE")
def weighted_picks(spark, folder):
    """In-memory draws by weight: customers with ten times the weight come up more often."""
    n = table(spark, folder, "customer").count()
    w, rng = np.where(np.arange(n) % 2 == 0, 10.0, 1.0), np.random.default_rng(1)
    a, b = sampling.weighted_pick(w, 50, rng), sampling.weighted_draws(w, 50, rng)
    rows = [("without replacement", len(a), bool(len(set(a.tolist())) == len(a) and (w[a] == 10).sum() > 30)), ("with replacement", len(b), bool((w[b] == 10).sum() > 30))]
    return spark.createDataFrame(rows, "how string, n int, fits boolean")


@query(f"SELECT CAST(floor({sql_uniform(1729, 'o_orderkey')} * 3) AS INTEGER) AS split, count(*) AS n, TRUE AS in_order FROM orders GROUP BY 1")
def shuffled_layout(spark, folder):
    """Rows laid out by split in random order: each split lies in one partition, sorted by its key."""
    laid = sampling.shuffled(table(spark, folder, "orders").select("o_orderkey"), 3, ["o_orderkey"]).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    kept = Scratch(spark, "layout").put(laid, "rows")
    return kept.groupBy("split").agg(F.count("*").alias("n"), ((F.count_distinct("part") == 1) & (F.corr(F.col("at").cast("double"), "shuffle_key") > 0.9)).alias("in_order"))


_OCCURRENCE = "SELECT field_name, level_name, level_count, row_number() OVER (PARTITION BY field_name, level_name, level_count) AS occurrence FROM summary_histogram"


@query(f"SELECT field_name, level_name, level_count, occurrence FROM ({_OCCURRENCE}) WHERE {sql_uniform(1729, 'field_name', 'level_name', 'level_count', 'occurrence')} < 0.3")
def sample_equal_rows(spark, folder):
    """A sample of rows of which very many are equal: each has a draw of its own."""
    rows = sampling.numbered(table(spark, folder, "summary_histogram").select("field_name", "level_name", "level_count"))
    return sampling.bernoulli_sample(rows, 0.3, ["field_name", "level_name", "level_count", "occurrence"])


@query("SELECT protocol_type, count(*) AS n, count(*) - count(CASE WHEN NOT isnan(duration) THEN 1 END) AS missing_number, CAST(0 AS BIGINT) AS unknown_level FROM connections WHERE FALSE GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) - count(CASE WHEN NOT isnan(duration) THEN 1 END), count(*) - count(protocol_type) FROM connections")
def normalize_dropped(spark, folder):
    """How many rows normalize saw and why it dropped some."""
    from pyspark.sql import Observation

    rows, seen = table(spark, folder, "connections").select("duration", "protocol_type"), Observation("dropped")
    s = summary.summarize(rows)
    normalize.normalize(rows, s, dropped=seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("all", seen.get["rows"], seen.get["missing_number"], seen.get["unknown_level"])], "protocol_type string, n bigint, missing_number bigint, unknown_level bigint")
