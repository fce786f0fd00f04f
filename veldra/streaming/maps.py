"""The stateless operators on streams: a fitted summary or clustering meets rows as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veldra.operators.assign import assign
from veldra.operators.centers import Centers
from veldra.operators.normalize import normalize
from veldra.operators.summary import Summary


def normalize_stream(rows: DataFrame, summary: Summary, id_column: str, transform: str = "none") -> DataFrame:
    return normalize(rows, summary, id_column, transform)


def assign_stream(vectors: DataFrame, clusterings: dict[int, Centers]) -> DataFrame:
    return assign(vectors, clusterings)


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows to parquet files, each once."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
