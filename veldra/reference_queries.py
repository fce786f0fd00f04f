"""Queries of the reference's own operators, over the whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.catalog import Catalog, table
from veldra.functions import transforms, vectors
from veldra.functions.uniform import sql_uniform
from veldra.operators import assign, centers, evaluate, kmeans_local, kmeans_parallel, normalize, pivot, sampling, summary
from veldra.operators.centroids import weighted_centroids
from veldra.operators.covariance import covariance
from veldra.operators.formula import INTERCEPT, Term, model_matrix
from veldra.plans.scratch import Scratch
from veldra.plans.workflow import cluster_table, sketch_arrays
from veldra.roles import Header
from veldra.sources import records
from veldra.streaming import maps

CATALOG = Catalog()
query = CATALOG.query

_ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 as 0.0."""
    return df.select(*[(F.round(df[c], digits) + 0.0).alias(c) if t == "double" else df[c] for c, t in df.dtypes])


def _lineitem(spark, folder, *columns):
    return table(spark, folder, "lineitem").select(F.expr(_ID).alias("id"), *columns)


# Profiles


def _profile_sql(rows: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS field, round(coalesce(min(x), 0.0), 6) + 0.0 AS min, round(coalesce(max(x), 0.0), 6) + 0.0 AS max, round(coalesce(avg(x), 0.0), 6) AS mean,
round(coalesce(stddev_pop(x), 0.0), 6) AS std_dev, count(*) - count(x) AS missing, count(*) AS n
FROM (SELECT CASE WHEN NOT isnan(y) THEN y + 0.0 END AS x FROM (SELECT TRY_CAST({c} AS DOUBLE) AS y FROM {rows}))"""
    return " UNION ALL ".join(one.format(c=c, rows=rows) for c in columns)


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(_profile_sql("lineitem", _NUMBERS))
def summary_numeric(spark, folder):
    return _rounded(summary.numeric_profile(table(spark, folder, "lineitem"), _NUMBERS))


@query(_profile_sql("(SELECT CASE WHEN value > 10 THEN CAST(value AS VARCHAR) ELSE 'NA' END AS v_text FROM events)", ["v_text"]))
def summary_missing(spark, folder):
    events = table(spark, folder, "events").select(F.when(F.col("value") > 10, F.col("value").cast("string")).otherwise("NA").alias("v_text"))
    return _rounded(summary.numeric_profile(events, ["v_text"]))


@query(_profile_sql("connections", ["duration", "hot", "serror_rate"]))
def summary_dirty(spark, folder):
    return _rounded(summary.numeric_profile(table(spark, folder, "connections"), ["duration", "hot", "serror_rate"]))


def _levels_sql(name: str, columns: list[str], most: int = 1_000_000) -> str:
    one = "SELECT field, level, n FROM (SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS level, count(*) AS n, row_number() OVER (ORDER BY CAST({c} AS VARCHAR)) AS r FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= {m}"
    return " UNION ALL ".join(one.format(c=c, t=name, m=most) for c in columns)


@query(_levels_sql("lineitem", ["l_returnflag", "l_linestatus"]) + " UNION ALL " + _levels_sql("connections", ["protocol_type", "service", "flag", "category"]))
def summary_levels(spark, folder):
    a = summary.level_counts(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])
    return a.unionByName(summary.level_counts(table(spark, folder, "connections"), ["protocol_type", "service", "flag", "category"]))


@query(_levels_sql("part", ["p_brand"], 10))
def summary_levels_trimmed(spark, folder):
    return summary.level_counts(table(spark, folder, "part"), ["p_brand"], 10)


@query("SELECT count(*) AS record_count, 5 AS field_count, count(DISTINCT c_mktsegment) - 1 AS net_levels FROM customer")
def summary_counts(spark, folder):
    s = summary.summarize(table(spark, folder, "customer").drop("c_name").withColumn("extra", F.lit(1.0)))
    return spark.createDataFrame([(s.record_count, s.field_count, s.net_levels())], "record_count bigint, field_count int, net_levels bigint")


# Normalization

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _normalize_sql(cell: str) -> str:
    stats = ", ".join(f"min({c}) + 0.0 AS lo{i}, max({c}) AS hi{i}, avg({c}) AS mean{i}, stddev_pop({c}) AS sd{i}" for i, c in enumerate(_MEASURES))
    cells = ", ".join("round(" + cell.format(b=f"least(hi{i}, greatest(lo{i}, {c}))", i=i) + f", 6) + 0.0 AS c{i}" for i, c in enumerate(_MEASURES))
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT {_ID} AS id, {cells} FROM lineitem, s"


def _normalized(spark, folder, how):
    rows = _lineitem(spark, folder, *_MEASURES)
    s = summary.summarize(rows, ignored=["id"])
    return _rounded(vectors.to_columns(normalize.normalize(rows, s, "id", how), "features", 3))


for _name, _cell in {"none": "{b}", "z": "({b} - mean{i}) / sd{i}", "linear": "({b} - lo{i}) / (hi{i} - lo{i})", "log": "CASE WHEN {b} <= 0 THEN 0.0 ELSE ln(1 + {b}) END"}.items():
    query(_normalize_sql(_cell), f"normalize_{_name}")(lambda spark, folder, how=_name: _normalized(spark, folder, how))


@query(f"SELECT {_ID} AS id, round(ln(1 + l_quantity) * 2, 6) AS c0, round(l_discount, 6) + 0.0 AS c1 FROM lineitem")
def normalize_override_scale(spark, folder):
    """A field's own transform and scale go before the given transform."""
    rows = _lineitem(spark, folder, "l_quantity", "l_discount")
    s = summary.summarize(rows, ignored=["id"])
    s["l_quantity"].numeric.transform, s["l_quantity"].scale = "log", 2.0
    return _rounded(vectors.to_columns(normalize.normalize(rows, s, "id", "none"), "features", 2))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)),
s AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT DISTINCT o_orderstatus AS v FROM orders))
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST((SELECT count(*) FROM l) + (SELECT count(*) FROM s) AS INTEGER) AS width,
CAST(s.i AS INTEGER) AS hot_status, CAST((SELECT count(*) FROM s) + l.i AS INTEGER) AS hot_priority
FROM orders JOIN l ON l.v = o_orderpriority JOIN s ON s.v = o_orderstatus""")
def normalize_onehot(spark, folder):
    """Cells of two categorical columns: the vector's width and the places of its ones."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    v = normalize.normalize(rows, summary.summarize(rows, ignored=["o_orderkey"]), "o_orderkey")
    hot = F.filter(F.transform("features", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return v.select("id", F.size("features").alias("width"), F.get(hot, 0).alias("hot_status"), F.get(hot, 1).alias("hot_priority"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, round(value, 6) + 0.0 AS c0, CASE event_type WHEN 'click' THEN 1.0 ELSE 0.0 END AS c1, CASE event_type WHEN 'error' THEN 1.0 ELSE 0.0 END AS c2,
CASE event_type WHEN 'purchase' THEN 1.0 ELSE 0.0 END AS c3, CASE event_type WHEN 'signup' THEN 1.0 ELSE 0.0 END AS c4 FROM events WHERE value > 10 AND event_type <> 'view'""".replace("1.0 ELSE 0.0", "CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE)"))
def normalize_row_drop(spark, folder):
    """Rows with a missing number or a level that isn't listed are dropped."""
    rows = table(spark, folder, "events").select("event_id", F.when(F.col("value") > 10, F.col("value").cast("string")).otherwise("NA").alias("value"), "event_type")
    s = summary.summarize(rows, symbolic=["event_type"], ignored=["event_id"])
    del s["event_type"].histogram["view"]
    return _rounded(vectors.to_columns(normalize.normalize(rows, s, "event_id"), "features", 5))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CAST((SELECT count(DISTINCT p_brand) FROM part) + 1 AS INTEGER) AS size, 2 AS n_indices, CAST(p_size + 1 AS DOUBLE) AS total FROM part")
def normalize_sparse(spark, folder):
    """One-hot vectors in the storage form with indices."""
    rows = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    v = normalize.normalize(rows, summary.summarize(rows, ignored=["p_partkey"]), "p_partkey", sparse=True)
    return v.select("id", F.col("features.size").alias("size"), F.size("features.indices").alias("n_indices"), F.aggregate("features.values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT p_partkey, CAST(i AS INTEGER) AS level FROM part JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT p_type AS v FROM part)) ON v = p_type")
def level_index(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_type")
    levels = summary.summarize(rows, ignored=["p_partkey"])["p_type"].levels
    return rows.select("p_partkey", transforms.level_index(rows.p_type, levels).alias("level"))


# Pivots


def _pivot_sql(name: str, key: str, attribute: str, values: list[str], levels: list[str], how: str) -> str:
    cells = []
    for v in values:
        for level in sorted(levels):
            here = f"CASE WHEN {attribute} = '{level}' THEN {v} END"
            cells.append(f"round(coalesce({'sum' if how == 'sum' else 'avg'}({here}), 0.0), 6) + 0.0 AS \"{v}_{level}\"")
    return f"SELECT {key}, {', '.join(cells)} FROM {name} GROUP BY {key}"


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(_pivot_sql("events", "user_id", "event_type", ["value"], _TYPES, "sum"))
def pivot_sum(spark, folder):
    events = table(spark, folder, "events")
    s = summary.summarize(events.select("event_type"))
    return _rounded(pivot.pivot_wide(events, ["user_id"], "event_type", ["value"], s, "sum"))


@query(_pivot_sql("events", "user_id", "event_type", ["value"], _TYPES, "mean"))
def pivot_mean(spark, folder):
    return _rounded(pivot.pivot_wide(table(spark, folder, "events"), ["user_id"], "event_type", ["value"], _TYPES, "mean"))


@query(_pivot_sql("lineitem", "l_linenumber", "l_returnflag", ["l_quantity", "l_extendedprice"], ["A", "N", "R"], "mean"))
def pivot_multi(spark, folder):
    return _rounded(pivot.pivot_wide(table(spark, folder, "lineitem"), ["l_linenumber"], "l_returnflag", ["l_quantity", "l_extendedprice"], ["A", "N", "R"], "mean"))


@query(_pivot_sql("events", "user_id", "event_type", ["value"], ["click", "purchase"], "sum"))
def pivot_subset_levels(spark, folder):
    return _rounded(pivot.pivot_wide(table(spark, folder, "events"), ["user_id"], "event_type", ["value"], ["click", "purchase"], "SUM"))


# Samples and folds

_U = sql_uniform(1729, *_KEYS)
_BAL = "CASE WHEN c_acctbal <= 0 THEN 1.0 ELSE c_acctbal END"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem ORDER BY {_U}, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 100")
def sample_uniform(spark, folder):
    return sampling.uniform_sample(table(spark, folder, "lineitem").select(*_KEYS), 100, _KEYS)


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem ORDER BY ln({_U}) / l_quantity DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 100")
def sample_weighted(spark, folder):
    rows = table(spark, folder, "lineitem")
    return sampling.weighted_sample(rows, 100, _KEYS, sampling.clean_weight(rows.l_quantity)).select(*_KEYS)


@query(f"SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY ln({_U}) / l_quantity DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r <= 25")
def sample_grouped(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", *_KEYS)
    return sampling.grouped_sample(rows, 25, ["l_returnflag"], _KEYS, rows.l_quantity).drop("l_quantity")


@query(f"SELECT c_custkey FROM customer ORDER BY ln({sql_uniform(7, 'c_custkey')}) / (1 / ({_BAL})) DESC, c_custkey LIMIT 50")
def sample_invert_default(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return sampling.weighted_sample(rows, 50, ["c_custkey"], sampling.clean_weight(rows.c_acctbal, True, 1.0), 7).select("c_custkey")


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE {_U} < 0.05")
def sample_bernoulli(spark, folder):
    return sampling.bernoulli_sample(table(spark, folder, "lineitem").select(*_KEYS), 0.05, _KEYS)


@query(f"SELECT o_orderkey, CAST(floor({sql_uniform(1729, 'o_orderkey')} * 4) AS INTEGER) AS fold FROM orders")
def crossfold(spark, folder):
    return sampling.crossfold(table(spark, folder, "orders").select("o_orderkey"), 4, ["o_orderkey"])


@query(f"SELECT o_orderkey, CAST(floor({sql_uniform(1729, 'o_orderkey')} * 3) AS INTEGER) AS split, {sql_uniform('1729s', 'o_orderkey')} AS shuffle_key FROM orders")
def shuffle_split(spark, folder):
    return sampling.shuffle_split(table(spark, folder, "orders").select("o_orderkey"), 3, ["o_orderkey"])


@query(f"WITH o AS (SELECT o_orderkey, CAST(floor({sql_uniform(1729, 'o_orderkey')} * 3) AS INTEGER) AS own_fold FROM orders) SELECT o_orderkey, own_fold, CAST(f AS INTEGER) AS fold FROM o, range(3) AS r(f) WHERE f <> own_fold")
def cv_replicate(spark, folder):
    return sampling.cv_replicate(table(spark, folder, "orders").select("o_orderkey"), 3, ["o_orderkey"])


# Covariances

_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def _covar_sql(by: str = "") -> str:
    one = "SELECT {by}{i} AS \"row\", {j} AS \"column\", count(*) AS n, round(avg({a}), 5) AS mean_row, round(avg({b}), 5) AS mean_column, round(covar_pop({a}, {b}), 3) + 0.0 AS cov FROM lineitem {g}"
    return " UNION ALL ".join(one.format(by=f"{by}, " if by else "", i=i, j=j, a=_MEASURES[i], b=_MEASURES[j], g=f"GROUP BY {by}" if by else "") for i, j in _PAIRS)


def _covar_rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"mean_row": F.round("mean_row", 5), "mean_column": F.round("mean_column", 5), "cov": F.round("cov", 3) + 0.0})


@query(_covar_sql())
def covar_global(spark, folder):
    rows = table(spark, folder, "lineitem")
    return _covar_rounded(covariance(rows.select(vectors.from_columns(rows, _MEASURES).alias("features"))))


@query(_covar_sql("l_returnflag"))
def covar_by_group(spark, folder):
    rows = table(spark, folder, "lineitem")
    return _covar_rounded(covariance(rows.select("l_returnflag", vectors.from_columns(rows, _MEASURES).alias("features")), by=["l_returnflag"]))


@query("""WITH x AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS r(i))
SELECT CAST(a.i AS INTEGER) AS "row", CAST(b.i AS INTEGER) AS "column", count(*) AS n, round(covar_pop(a.v, b.v), 8) + 0.0 AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")
def covar_embeddings(spark, folder):
    cells = covariance(table(spark, folder, "embeddings"), "embedding")
    return cells.select("row", "column", "n", (F.round("cov", 8) + 0.0).alias("cov"))


# Assignment


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _nearest_sql(points: str, centers_sql: str) -> str:
    """CTEs p (id, v), c (cluster_id, center_id, center) and a, the assignment."""
    return f"""WITH p AS (SELECT row_number() OVER () AS pid, * FROM ({points})), c AS ({centers_sql}),
d AS (SELECT pid, id, v, cluster_id, center_id, {_d2('v', 'center')} AS d2 FROM p, c),
a AS (SELECT id, v, cluster_id, center_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY pid, cluster_id ORDER BY d2, center_id) AS r FROM d) WHERE r = 1)
"""


_EMBEDDED = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def _first_centers(k: int, start: int = 0, cluster: int = 0) -> str:
    return f"SELECT {cluster} AS cluster_id, CAST(vec_id - {start} AS INTEGER) AS center_id, CAST(embedding AS DOUBLE[]) AS center FROM embeddings WHERE vec_id >= {start} AND vec_id < {start + k}"


def _embedded(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def _from_first(spark, folder, k: int, start: int = 0) -> centers.Centers:
    rows = table(spark, folder, "embeddings").where((F.col("vec_id") >= start) & (F.col("vec_id") < start + k)).orderBy("vec_id").collect()
    return centers.Centers([r.embedding for r in rows])


_ASSIGNMENT = "SELECT id AS vector_id, cluster_id, center_id AS closest_center_id, round(d2, 6) AS distance FROM a"


@query(_nearest_sql(_EMBEDDED, _first_centers(8)) + _ASSIGNMENT)
def kassign_fixed(spark, folder):
    return _rounded(assign.assign(_embedded(spark, folder), {0: _from_first(spark, folder, 8)}))


_COUNTS = ["duration", "src_bytes", "dst_bytes", "conn_count", "srv_count"]
_RATES = ["serror_rate", "rerror_rate", "same_srv_rate", "diff_srv_rate", "dst_host_same_srv_rate", "dst_host_serror_rate"]


def _sessions(spark, folder) -> DataFrame:
    rows = table(spark, folder, "session_vectors").dropDuplicates(["vector_id", *_COUNTS, *_RATES])
    cells = [F.when(F.col(c) > -1, F.log1p(c) / 10) for c in _COUNTS] + [F.col(c) for c in _RATES]
    return rows.select(F.col("vector_id").alias("id"), F.array(*cells).alias("features"))


_SESSIONS = f"""SELECT id, v FROM (SELECT DISTINCT vector_id AS id, [{', '.join([f"CASE WHEN {c} > -1 THEN ln(1 + {c}) / 10 END" for c in _COUNTS] + _RATES)}] AS v FROM session_vectors)
WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 11"""


@query(_nearest_sql(_SESSIONS, "SELECT clustering_id AS cluster_id, center_id, center FROM centers") + _ASSIGNMENT)
def kassign_two_clusterings(spark, folder):
    """All clusterings of the centers table in one pass over session_vectors."""
    return _rounded(assign.assign(_sessions(spark, folder), centers.centers_from(table(spark, folder, "centers"))))


@query(_nearest_sql(_SESSIONS, "SELECT clustering_id AS cluster_id, center_id, center FROM centers WHERE clustering_id = 1") + "SELECT cluster_id, round(sum(d2), 4) AS cost FROM a GROUP BY 1")
def center_costs(spark, folder):
    found = centers.centers_from(table(spark, folder, "centers"), [1])
    return _rounded(assign.costs(_sessions(spark, folder), found), 4)


@query(_nearest_sql(_SESSIONS, "SELECT clustering_id AS cluster_id, center_id, center FROM centers") + "SELECT c.cluster_id, c.center_id, count(a.id) AS n FROM c LEFT JOIN a ON a.cluster_id = c.cluster_id AND a.center_id = c.center_id GROUP BY 1, 2")
def closest_counts(spark, folder):
    return assign.closest_counts(_sessions(spark, folder), centers.centers_from(table(spark, folder, "centers")))


def _lloyds_sql(rounds: int) -> str:
    sql = f"WITH p AS ({_EMBEDDED}), c0 AS ({_first_centers(5)})"
    for k in range(rounds):
        sql += f""", a{k} AS (SELECT id, v, center_id FROM (SELECT id, v, center_id, row_number() OVER (PARTITION BY id ORDER BY {_d2('v', 'center')}, center_id) AS r FROM p, c{k}) WHERE r = 1),
c{k + 1} AS (SELECT 0 AS cluster_id, center_id, list(m ORDER BY i) AS center FROM (SELECT center_id, i, avg(v[i]) AS m FROM a{k}, range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY center_id)"""
    return sql + f" SELECT center_id, CAST(i - 1 AS INTEGER) AS at, round(center[i], 6) + 0.0 AS value FROM c{rounds}, range(1, 65) AS r(i)"


def _lloyds(spark, folder, rounds: int) -> DataFrame:
    moved = kmeans_parallel.lloyds(_embedded(spark, folder), {0: _from_first(spark, folder, 5)}, rounds)
    return _rounded(centers.centers_table(spark, moved).select("center_id", F.posexplode("center").alias("at", "value")))


for _rounds in (1, 3):
    query(_lloyds_sql(_rounds), f"lloyds_{_rounds}")(lambda spark, folder, n=_rounds: _lloyds(spark, folder, n))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_extendedprice), 6) AS l_quantity, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS l_discount FROM lineitem GROUP BY 1")
def weighted_centroid(spark, folder):
    rows = table(spark, folder, "lineitem")
    return _rounded(weighted_centroids(rows, ["l_quantity", "l_discount"], rows.l_extendedprice, ["l_returnflag"]))


_PLANE = f"SELECT {_ID} AS id, [CAST(l_quantity AS DOUBLE), l_discount * 100] AS v FROM lineitem"
_THREE = "SELECT 0 AS cluster_id, i AS center_id, [10.0 + 15 * i, 5.0] AS center FROM range(3) AS r(i)".replace("10.0 + 15 * i, 5.0", "CAST(10 + 15 * i AS DOUBLE), CAST(5 AS DOUBLE)")


def _plane(spark, folder) -> tuple[DataFrame, dict]:
    rows = _lineitem(spark, folder, F.array("l_quantity", F.col("l_discount") * 100).alias("features"))
    return rows, {0: centers.Centers([[10, 5], [25, 5], [40, 5]])}


@query(_nearest_sql(_PLANE, _THREE) + """, e AS (SELECT CAST(center_id AS INTEGER) AS center_id, v[1] AS x, v[2] AS y FROM a)
SELECT center_id, count(*) AS n, 0 AS "row", 0 AS "column", round(var_pop(x), 5) AS value FROM e GROUP BY 1 UNION ALL
SELECT center_id, count(*), 0, 1, round(covar_pop(x, y), 5) FROM e GROUP BY 1 UNION ALL SELECT center_id, count(*), 1, 1, round(var_pop(y), 5) FROM e GROUP BY 1""")
def kcovar(spark, folder):
    rows, three = _plane(spark, folder)
    cells = assign.cluster_covariances(rows, three).select("center_id", F.col("count").alias("n"), F.explode("cov").alias("e"))
    return _rounded(cells.select("center_id", "n", "e.row", "e.column", "e.value"), 5)


def _mahalanobis_sql(by: str) -> str:
    return f""", e AS (SELECT id, CAST(center_id AS INTEGER) AS center_id, v[1] AS x, v[2] AS y FROM a),
m AS (SELECT id, center_id, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, var_pop(x) OVER w AS p, covar_pop(x, y) OVER w AS q, var_pop(y) OVER w AS r FROM e WINDOW w AS (PARTITION BY {by}))
SELECT id AS vector_id, center_id AS closest_center_id, round((r * dx * dx - 2 * q * dx * dy + p * dy * dy) / (p * r - q * q), 5) AS outlier_distance FROM m"""


@query(_nearest_sql(_PLANE, "SELECT 0 AS cluster_id, 0 AS center_id, [CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)] AS center") + _mahalanobis_sql("1"))
def mahalanobis_2d(spark, folder):
    """Squared Mahalanobis distances of all rows from their mean."""
    rows, one = _plane(spark, folder)[0], {0: centers.Centers([[0, 0]])}
    return _rounded(assign.outliers(rows, one, assign.cluster_covariances(rows, one)).drop("cluster_id"), 5)


@query(_nearest_sql(_PLANE, _THREE) + "SELECT * FROM (" + _mahalanobis_sql("center_id").lstrip(", ").replace("e AS (", "WITH e AS (", 1) + ") ORDER BY outlier_distance DESC, vector_id LIMIT 20")
def koutlier_topk(spark, folder):
    """The twenty rows farthest from their clusters."""
    rows, three = _plane(spark, folder)
    scored = _rounded(assign.outliers(rows, three, assign.cluster_covariances(rows, three)).drop("cluster_id"), 5)
    return scored.orderBy(F.desc("outlier_distance"), "vector_id").limit(20)


# Stability

_CROSS = f"""WITH p AS ({_EMBEDDED}), ct AS ({_first_centers(6)}), cr AS ({_first_centers(6, 6)}),
t AS (SELECT id, center_id AS test_id FROM (SELECT id, center_id, row_number() OVER (PARTITION BY id ORDER BY {_d2('v', 'center')}, center_id) AS r FROM p, ct) WHERE r = 1),
s AS (SELECT id, center_id AS train_id FROM (SELECT id, center_id, row_number() OVER (PARTITION BY id ORDER BY {_d2('v', 'center')}, center_id) AS r FROM p, cr) WHERE r = 1),
x AS (SELECT test_id, train_id, CAST(count(*) AS DOUBLE) AS weight FROM t JOIN s USING (id) GROUP BY 1, 2),
g AS (SELECT test_id, sum(weight) AS points, CASE WHEN sum(weight) > 1 THEN sum(weight * (weight - 1)) / (sum(weight) * (sum(weight) - 1)) ELSE 1 END AS strength FROM x GROUP BY 1) """


def _cross(spark, folder) -> DataFrame:
    both = assign.assign(_embedded(spark, folder), {0: _from_first(spark, folder, 6), 1: _from_first(spark, folder, 6, 6)})
    points = both.groupBy("vector_id").agg(F.max(F.when(F.col("cluster_id") == 0, F.col("closest_center_id"))).alias("t"), F.max(F.when(F.col("cluster_id") == 1, F.col("closest_center_id"))).alias("s"))
    return evaluate.crosstab(points, "t", "s")


@query(_CROSS + "SELECT test_id, train_id, weight FROM x")
def assignment_crosstab(spark, folder):
    return _cross(spark, folder)


@query(_CROSS + "SELECT test_id, points, round(strength, 6) AS strength FROM g")
def prediction_strength(spark, folder):
    return _rounded(evaluate.prediction_strength(_cross(spark, folder)))


@query(_CROSS + "SELECT round(coalesce(min(CASE WHEN points > 6 THEN strength END), CAST('inf' AS DOUBLE)), 6) AS pred_strength, round(avg(CASE WHEN strength > 0.8 THEN 1 ELSE 0 END), 6) AS stable_clusters, round(sum(CASE WHEN strength > 0.8 THEN points ELSE 0 END) / sum(points), 6) AS stable_points FROM g")
def stability(spark, folder):
    return _rounded(evaluate.stability(evaluate.prediction_strength(_cross(spark, folder)), 6))


# Sketches and clusterings


@query(f"""WITH p AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(floor({sql_uniform(1729, 'vec_id')} * 2) AS INTEGER) AS fold FROM embeddings),
s AS (SELECT id, fold, {_d2('v', '(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)')} AS d2 FROM p)
SELECT fold, id, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY ln({sql_uniform(1730, 'id')}) / d2 DESC, id) AS r FROM s WHERE d2 > 0) WHERE r <= 20""")
def sketch_round1(spark, folder):
    """The candidates of a sketch's first round, in two folds."""
    rows = sampling.crossfold(_embedded(spark, folder), 2, ["id"])
    seed = _from_first(spark, folder, 1)
    return _rounded(kmeans_parallel.sketch_round(rows, {0: seed, 1: seed}, 20, 1730).drop("features"))


def _sketch_sql(rounds: int, per_round: int) -> str:
    """The rounds of a sketch in two folds: m holds the distance to the nearest candidate so far, c the candidates in order."""
    seed = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY CAST(vec_id AS VARCHAR) LIMIT 1)"
    sql = f"""WITH p AS MATERIALIZED (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(floor({sql_uniform(1729, 'CAST(vec_id AS VARCHAR)')} * 2) AS INTEGER) AS fold FROM embeddings),
m0 AS MATERIALIZED (SELECT id, fold, v, {_d2('v', seed)} AS d2 FROM p), c0 AS MATERIALIZED (SELECT f AS fold, 0 AS point_id, {seed} AS center FROM range(2) AS r(f))"""
    for k in range(rounds):
        sql += f""", n{k} AS MATERIALIZED (SELECT fold, id, v FROM (SELECT fold, id, v, row_number() OVER (PARTITION BY fold ORDER BY ln({sql_uniform(1730 + k, 'id')}) / d2 DESC, id) AS r FROM m{k} WHERE d2 > 0) WHERE r <= {per_round}),
c{k + 1} AS MATERIALIZED (SELECT fold, point_id, center FROM c{k} UNION ALL SELECT fold, {1 + k * per_round} + row_number() OVER (PARTITION BY fold ORDER BY id) - 1, v FROM n{k}),
m{k + 1} AS MATERIALIZED (SELECT m.id, m.fold, m.v, least(any_value(m.d2), min({_d2('m.v', 'n.v')})) AS d2 FROM m{k} m JOIN n{k} n ON n.fold = m.fold GROUP BY m.id, m.fold, m.v)"""
    return sql + f""", a AS (SELECT fold, point_id, count(*) AS w FROM (SELECT p.fold, c.point_id, row_number() OVER (PARTITION BY p.id ORDER BY {_d2('p.v', 'c.center')}, c.point_id) AS r FROM p JOIN c{rounds} c ON c.fold = p.fold) WHERE r = 1 GROUP BY 1, 2)
SELECT CAST(c.fold AS INTEGER) AS fold, CAST(c.point_id AS INTEGER) AS point_id, round(c.center[1], 6) + 0.0 AS first, CAST(coalesce(a.w, 0) AS DOUBLE) AS weight FROM c{rounds} c LEFT JOIN a USING (fold, point_id)"""


@query(_sketch_sql(5, 20))
def sketch_full(spark, folder):
    """Weighted candidates of five rounds in two folds."""
    points = kmeans_parallel.sketch(_embedded(spark, folder), 5, 20, 2)
    return _rounded(points.select("fold", "point_id", F.col("features")[0].alias("first"), "weight"))


def _kmeans(spark, folder, ks: list[int], **how) -> DataFrame:
    x, w = sketch_arrays(kmeans_parallel.sketch(_embedded(spark, folder), 3, 40, 1))
    runs = kmeans_local.grid(x, w, ks, 2, **how)
    return centers.centers_table(spark, dict(enumerate(runs)))


@query()
def kmeans_plusplus(spark, folder):
    return _kmeans(spark, folder, [1, 5, 10], update=kmeans_local.lloyds(20))


@query()
def kmeans_random(spark, folder):
    return _kmeans(spark, folder, [5], init="random", update=kmeans_local.lloyds(20))


@query()
def kmeans_minibatch(spark, folder):
    return _kmeans(spark, folder, [5], update=kmeans_local.mini_batch(20, 50))


@query()
def kmeans_evaluation(spark, folder):
    """Statistics of clusterings of the last fold against those of the first."""
    points = kmeans_parallel.sketch(_embedded(spark, folder), 3, 40, 2)
    (x, w), (y, v) = sketch_arrays(points, [0]), sketch_arrays(points, [1])
    ks = [2, 5, 10]
    pairs = zip(kmeans_local.grid(y, v, ks, 1), kmeans_local.grid(x, w, ks, 1))
    rows = [evaluate.evaluate_sketch(test, train, y, v, i)[0] for i, (test, train) in enumerate(pairs)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], "ID int, NumClusters int, TestCost double, TrainCost double, PredStrength double, StableClusters double, StablePoints double")


@query()
def lsh_assign(spark, folder):
    """Assignment among the candidates of nearest signatures."""
    return assign.assign(_embedded(spark, folder), {0: _from_first(spark, folder, 100)}, approx=True, bits=128, candidates=32)


@query()
def workflow_assignments(spark, folder):
    """Profile, normalize, sketch, cluster and assign all of lineitem."""
    rows = _lineitem(spark, folder, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return cluster_table(rows, "id", 8)[2]


# Vectors, formulas, sources and sinks


@query("SELECT CAST(vec_id AS VARCHAR) AS id, round(CAST(embedding[1] AS DOUBLE) * 0.5, 6) + 0.0 AS first, round(CAST(embedding[64] AS DOUBLE) * 32, 6) + 0.0 AS last FROM embeddings")
def vector_scale(spark, folder):
    v = _embedded(spark, folder).select("id", transforms.scale_vector(F.col("features"), [(i + 1) / 2 for i in range(64)]).alias("f"))
    return _rounded(v.select("id", F.col("f")[0].alias("first"), F.col("f")[63].alias("last")))


@query(f"""SELECT {_ID} || CASE WHEN l_linenumber > 1 THEN ' 0:' || CAST(CAST(l_linenumber - 1 AS DOUBLE) AS VARCHAR) ELSE '' END || ' 1:' || CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR) AS line FROM lineitem""")
def svmlight(spark, folder):
    rows = _lineitem(spark, folder, F.array((F.col("l_linenumber") - 1).cast("double"), F.col("l_quantity").cast("double")).alias("features"))
    return rows.select(vectors.svmlight(rows.features, rows.id).alias("line"))


@query("SELECT c_name, c_custkey AS by_long, CAST(c_custkey AS INTEGER) AS by_int, 0 AS unnamed, CAST(c_custkey AS VARCHAR) AS by_text FROM customer")
def vector_keys(spark, folder):
    c, id = table(spark, folder, "customer"), F.col("c_custkey").cast("string")
    return c.select("c_name", vectors.long_key(id).alias("by_long"), vectors.int_key(id).alias("by_int"), vectors.int_key(F.col("c_name")).alias("unnamed"), vectors.text_key(id).alias("by_text"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(64 AS INTEGER) AS size, round(CAST(embedding[10] AS DOUBLE), 6) + 0.0 AS tenth FROM embeddings")
def vector_storage(spark, folder):
    """To the sparse storage form and back."""
    v = _embedded(spark, folder)
    stored = v.select("id", vectors.to_storage(v.features, v.id, True).alias("s"))
    return _rounded(stored.select("id", F.col("s.size").alias("size"), vectors.from_storage(F.col("s"))[9].alias("tenth")))


@query()
def show_vectors(spark, folder):
    return records.first_vectors(_embedded(spark, folder), 20)


@query("SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS center_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM embeddings WHERE vec_id < 5")
def dedup_centers(spark, folder):
    """Equal centers count once, in order."""
    c = _from_first(spark, folder, 5)
    return _rounded(centers.centers_table(spark, {0: c.extended(c.points.tolist())}).select("center_id", F.col("center")[0].alias("first")))


@query(f"SELECT round(sum({_d2('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')}), 6) AS d2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 5 WHERE a.vec_id < 5")
def centers_difference(spark, folder):
    d = _from_first(spark, folder, 5).squared_difference(_from_first(spark, folder, 5, 5))
    return spark.createDataFrame([(float(np.round(d, 6)),)], "d2 double")


@query("SELECT clustering_id, center_id, round(center[1], 6) + 0.0 AS first FROM centers WHERE clustering_id = 1")
def centers_subset(spark, folder):
    """Some clusterings of a centers file, by id."""
    chosen = centers.centers_from(table(spark, folder, "centers"), [1])
    return _rounded(centers.centers_table(spark, chosen).select("clustering_id", "center_id", F.col("center")[0].alias("first")))


@query(f"SELECT {_ID} AS id, CAST(1 AS DOUBLE) AS c0, CAST(l_quantity AS DOUBLE) AS c1, CAST(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS DOUBLE) AS c2, CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS DOUBLE) AS c3 FROM lineitem")
def formula_matrix(spark, folder):
    """1 + quantity + quantity:returnflag."""
    rows = _lineitem(spark, folder, "l_quantity", "l_returnflag")
    terms = sorted([Term.of("l_quantity", "l_returnflag"), Term.of("l_quantity"), INTERCEPT])
    v = rows.select("id", model_matrix(rows, terms, summary.summarize(rows, ignored=["id"])).alias("features"))
    return vectors.to_columns(v, "features", 4)


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def csv_roundtrip(spark, folder):
    nation = table(spark, folder, "nation")
    path = f"{Scratch(spark, 'csv').path}/nation"
    records.write_records(nation, path, "csv")
    return records.read_records(spark, "text", path, Header.of_schema(nation.schema))


@query("SELECT CAST(n_nationkey AS VARCHAR) || '|' || n_name || '|' || CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def csv_lines(spark, folder):
    return records.csv_lines(table(spark, folder, "nation"), "|")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def union_inputs(spark, folder):
    path = f"{folder}/region.parquet"
    return records.read_records(spark, "parquet", [path, path])


@query("SELECT * FROM (VALUES ('n_nationkey', 'numeric'), ('n_name', 'symbolic'), ('n_regionkey', 'numeric')) AS t(name, role)")
def header_spec(spark, folder):
    h = Header.parse(Header.of_schema(table(spark, folder, "nation").schema).text())
    return spark.createDataFrame(list(zip(h.names, h.roles)), "name string, role string")


@query(CATALOG.sql["normalize_z"])
def stream_normalize(spark, folder):
    """The same as normalize_z, by a stream over lineitem's files."""
    rows = _lineitem(spark, folder, *_MEASURES)
    s = summary.summarize(rows, ignored=["id"])
    path = f"{folder}/lineitem.parquet"
    schema = table(spark, folder, "lineitem").schema
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "lineitem.parquet").parquet(folder)
    out = Scratch(spark, "stream").path
    vs = maps.normalize_stream(stream.select(F.expr(_ID).alias("id"), *_MEASURES), s, "id", "z")
    maps.to_table(vs, f"{out}/rows", f"{out}/log").awaitTermination()
    return _rounded(vectors.to_columns(spark.read.schema(vs.schema).parquet(f"{out}/rows"), "features", 3))
