"""Queries of the problems for training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.catalog import Catalog, table
from veldra.llm.clusters import cluster_members, describe_clusters
from veldra.llm.percentiles import FEW, PERCENTILES, combine_grids, exact_percentiles, percentile_grids, ranks_within
from veldra.llm.leaks import leaked_items
from veldra.llm.repetition import repetition_scores, repetitive_documents
from veldra.llm.reservoir import Reservoir, reservoir_sample
from veldra.llm.tokens import encode_corpus
from veldra.plans.scratch import Scratch

CATALOG = Catalog()

def _kinds():
    return {"protocol": F.col("protocol_type"), "sensor": F.col("sensor_id"), "category": F.col("category"), "day": F.date_format("captured_at", "yyyy-MM-dd")}


_GROUPS_SQL = """WITH rows_of AS (
  SELECT 'protocol' AS kind, protocol_type AS value_of, duration AS v FROM connections
  UNION ALL SELECT 'sensor', sensor_id, duration FROM connections
  UNION ALL SELECT 'category', category, duration FROM connections
  UNION ALL SELECT 'day', strftime(captured_at, '%Y-%m-%d'), duration FROM connections
  UNION ALL SELECT 'field', field_name, mean_value FROM summary_numeric),
ranked AS (SELECT kind, value_of, v + 0.0 AS v, count(*) OVER (PARTITION BY kind, value_of) AS n,
  row_number() OVER (PARTITION BY kind, value_of ORDER BY v) AS r FROM rows_of WHERE v IS NOT NULL AND NOT isnan(v))
"""


def _exact(spark, folder, few: int = FEW):
    durations = exact_percentiles(table(spark, folder, "connections"), _kinds(), "duration", few=few)
    means = exact_percentiles(table(spark, folder, "summary_numeric"), {"field": F.col("field_name")}, "mean_value", few=few)
    return durations.unionByName(means)


def _combined(spark, folder):
    durations = percentile_grids(table(spark, folder, "connections"), _kinds(), "duration", F.col("batch_id"))
    means = percentile_grids(table(spark, folder, "summary_numeric"), {"field": F.col("field_name")}, "mean_value", F.col("batch_id"))
    return combine_grids(durations.unionByName(means))


@CATALOG.query()
def p1_combined(spark, folder):
    """Percentiles combined from the results of the single pieces, with the bound of their rank error, beside the exact ones."""
    combined = _combined(spark, folder).withColumnRenamed("value", "combined")
    a, b = combined.alias("a"), _exact(spark, folder).alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & F.col("a.value_of").eqNullSafe(F.col("b.value_of")) & (F.col("a.pct") == F.col("b.pct"))
    return a.join(b, same).select("a.kind", "a.value_of", "a.n", "a.pct", "b.value", "a.combined", "a.rank_error")


_EXACT_SQL = _GROUPS_SQL + f"SELECT kind, value_of, n, CAST(pct AS INTEGER) AS pct, v AS value FROM ranked, unnest({list(PERCENTILES)}) AS p(pct) WHERE r = greatest(1, (pct * n + 999) // 1000)"


@CATALOG.query(_EXACT_SQL.replace("v AS value", "TRUE AS within"))
def p1_rank_bounds(spark, folder):
    """Whether the rank of each combined percentile differs from its target by no more than the bound stated with it."""
    combined = Scratch(spark, "combined").put(_combined(spark, folder), "values")
    durations = ranks_within(table(spark, folder, "connections"), _kinds(), "duration", combined.where("kind <> 'field'"))
    return durations.unionByName(ranks_within(table(spark, folder, "summary_numeric"), {"field": F.col("field_name")}, "mean_value", combined.where("kind = 'field'")))


@CATALOG.query(_EXACT_SQL)
def p1_percentiles_joined(spark, folder):
    """The same as p1_percentiles with open intervals met by a join, as when they are too many to send to all tasks."""
    return _exact(spark, folder, few=0)


@CATALOG.query(_EXACT_SQL)
def p1_percentiles(spark, folder):
    """Exact percentiles of duration by protocol, sensor, category and day, and of mean_value by field."""
    return _exact(spark, folder)


@CATALOG.query()
def p3_found(spark, folder):
    """Members of clusters of three or more alike vectors, each with the cluster's first id."""
    members = cluster_members(table(spark, folder, "session_vectors"))
    return members.where("vector_id <> first_id").select("first_id", "vector_id")


@CATALOG.query()
def p3_clusters(spark, folder):
    """Size and the three most typical members of every cluster."""
    return describe_clusters(cluster_members(table(spark, folder, "session_vectors")))


@CATALOG.query()
def p5_sample(spark, folder):
    """A uniform sample of 1000 of the connections as stored."""
    rows = table(spark, folder, "connections").select("conn_id", "batch_id", "sensor_id", "captured_at", "arrived_at", "duration")
    return reservoir_sample(rows, 1000)


@CATALOG.query("SELECT least(1000, count(*)) AS n, TRUE AS all_stored FROM connections")
def p5_sample_pieces(spark, folder):
    """The same, piece by piece as they came in, with all segments of the shards in files: how many rows, and whether all are stored ones."""
    rows = table(spark, folder, "connections")
    state = Reservoir(spark, 1000, memory=0)
    for piece in rows.select("batch_id").distinct().orderBy("batch_id").collect():
        state.add(rows.where(F.col("batch_id").eqNullSafe(F.lit(piece.batch_id))))
    got = state.sample()
    stored = rows.groupBy("conn_id", "arrived_at").agg(F.count("*").alias("stored"))
    drawn = got.groupBy("conn_id", "arrived_at").agg(F.count("*").alias("drawn"))
    both = drawn.join(stored, ["conn_id", "arrived_at"], "left")
    return both.agg(F.sum("drawn").alias("n"), F.bool_and(F.coalesce(F.col("drawn") <= F.col("stored"), F.lit(False))).alias("all_stored"))


@CATALOG.query()
def p6_ids(spark, folder):
    """Token ids of every document."""
    return encode_corpus(table(spark, folder, "documents"))


@CATALOG.query()
def p6_ids_blocks(spark, folder):
    """The same with a word table that is joined to blocks of documents, as when it is too large to send to all tasks."""
    return encode_corpus(table(spark, folder, "documents"), table_bytes=0)


@CATALOG.query("SELECT count(*) AS n, count(*) AS same FROM documents")
def p6_both_ways(spark, folder):
    """How many documents have the same ids in both ways."""
    a, b = p6_ids(spark, folder).alias("a"), p6_ids_blocks(spark, folder).alias("b")
    return a.join(b, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("a.ids") == F.col("b.ids")).alias("same"))


@CATALOG.query()
def p7_found(spark, folder):
    """Documents with each held-out item that leaked into them."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@CATALOG.query()
def p8_found(spark, folder):
    """Documents of which at least 0.30 is repeated."""
    return repetitive_documents(table(spark, folder, "documents"))


@CATALOG.query()
def p8_shares(spark, folder):
    """Share of repeated words, statistics and score of every document."""
    return repetition_scores(table(spark, folder, "documents"))
