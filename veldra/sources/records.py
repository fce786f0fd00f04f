"""Readers and writers of records and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.functions.vectors import from_storage, int_key, long_key, svmlight, text_key, to_storage
from veldra.operators.summary import Summary
from veldra.roles import Header

FORMATS = ("text", "parquet", "avro", "seq", "hive")
#: Types that a table column may have; others are refused.
TABLE_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType)
VECTOR = "id string, size int, values array<double>, indices array<int>"


def paths_of(paths: str | Sequence[str]) -> list[str]:
    return [p.strip() for p in paths.split(",") if p.strip()] if isinstance(paths, str) else list(paths)


def read_text(spark: SparkSession, paths: str | Sequence[str], header: Header | Summary, delimiter: str = ",", quote: str = '"', comment: str | None = None, typed: bool = True) -> DataFrame:
    """Delimited lines of one or more paths (a union that keeps repeated rows).

    Every line stands alone; null and empty lines and those that start with ``comment`` are skipped.
    Columns are strings; with ``typed`` the numeric ones become double, null where they can't.
    """
    roles = header.header() if isinstance(header, Summary) else header
    strings = T.StructType([T.StructField(n, T.StringType()) for n in roles.names])
    options = {"sep": delimiter, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "multiLine": False, "emptyValue": "", "nullValue": "\u0000"}
    raw = spark.read.schema(strings).options(**options | ({"comment": comment} if comment else {})).csv(paths_of(paths))
    if not typed:
        return raw
    kinds = roles.schema()
    return raw.select(*[raw[f.name].try_cast("double").alias(f.name) if isinstance(f.dataType, T.DoubleType) else raw[f.name] for f in kinds])


def read_lines(spark: SparkSession, paths: str | Sequence[str], comment: str | None = None) -> DataFrame:
    """``value``: the lines of text files as they are, without empty ones and those that start with ``comment``."""
    lines = spark.read.text(paths_of(paths)).where(F.col("value") != "")
    return lines.where(~F.col("value").startswith(comment)) if comment else lines


def read_typed(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, delimiter: str = ",", quote: str = '"', comment: str | None = None) -> DataFrame:
    """Delimited lines as records of a schema of boolean, int, bigint, double and string columns; null where a text doesn't fit."""
    if bad := [f.name for f in schema if not isinstance(f.dataType, TABLE_TYPES)]:
        raise ValueError(f"columns of unsupported types: {', '.join(bad)}")
    texts = read_text(spark, paths, Header(schema.names, ["symbolic"] * len(schema)), delimiter, quote, comment, typed=False)
    return texts.select(*[texts[f.name] if isinstance(f.dataType, T.StringType) else texts[f.name].try_cast(f.dataType).alias(f.name) for f in schema])


def read_table(spark: SparkSession, name: str, where: str | None = None) -> DataFrame:
    """A table ``db.table`` (database ``default`` without a dot). ``where`` prunes its partitions."""
    db, table = table_name(name)
    df = spark.table(f"`{db}`.`{table}`")
    if bad := [f.name for f in df.schema if not isinstance(f.dataType, TABLE_TYPES)]:
        raise ValueError(f"columns of unsupported types: {', '.join(bad)}")
    wide = {T.ByteType: "int", T.ShortType: "int", T.FloatType: "double"}
    kept = df.where(where) if where else df
    return kept.select(*[kept[f.name].cast(wide[type(f.dataType)]).alias(f.name) if type(f.dataType) in wide else kept[f.name] for f in df.schema])


def table_name(name: str) -> tuple[str, str]:
    """Database and table, split at the first dot."""
    db, dot, table = name.partition(".")
    return (db, table) if dot else ("default", name)


def read_records(spark: SparkSession, format: str, paths: str | Sequence[str], header: Header | Summary | None = None, **options) -> DataFrame:
    """Records by format name: text, parquet, avro (where its source is installed), seq (vectors as records), hive."""
    kind = format.lower()
    if kind == "text":
        if header is None:
            raise ValueError("text input needs a header or a summary")
        return read_text(spark, paths, header, **options)
    if kind == "hive":
        return read_table(spark, paths if isinstance(paths, str) else paths[0], **options)
    if kind in ("parquet", "avro"):
        return spark.read.format(kind).load(paths_of(paths))
    if kind == "seq":
        vectors = read_sequence_vectors(spark, paths)
        size = vectors.agg(F.max(F.size("features"))).first()[0] or 0
        return vectors.select(*[F.get("features", i).alias(f"c{i}") for i in range(size)])
    raise ValueError(f"unknown format {format}; there are {', '.join(FORMATS)}")


def read_vectors(spark: SparkSession, paths: str | Sequence[str], format: str = "parquet") -> DataFrame:
    """``id``, ``features`` from the storage form or from columns of these names."""
    if format.lower() == "seq":
        return read_sequence_vectors(spark, paths)
    df = spark.read.format(format.lower()).load(paths_of(paths))
    if "features" in df.columns:
        return df.select(F.col("id").cast("string").alias("id"), F.col("features").cast("array<double>").alias("features"))
    return df.select("id", from_storage(F.struct(*[df[c] for c in ("size", "values", "indices")])).alias("features"))


def read_sequence_vectors(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Vectors that ``write_vectors(..., "seq")`` wrote: key and vector text of a sequence file."""
    both = None
    for p in paths_of(paths):
        rdd = spark.sparkContext.sequenceFile(p)
        df = spark.createDataFrame(rdd.map(lambda kv: (str(kv[0]), str(kv[1]))), "id string, text string")
        both = df if both is None else both.unionByName(df)
    return both.select("id", F.transform(F.split("text", ","), lambda x: x.try_cast("double")).alias("features"))


def read_sequence_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``value``: the texts of sequence files that ``write_records(..., "seq")`` wrote."""
    parts = [spark.createDataFrame(spark.sparkContext.sequenceFile(p).map(lambda kv: (str(kv[1]),)), "value string") for p in paths_of(paths)]
    return union_all(parts)


def write_vectors(vectors: DataFrame, path: str, format: str = "parquet", key: str = "text", sparse: bool = False, compress: bool = False) -> None:
    """Vectors in storage form (parquet, avro), as svmlight lines, or as a keyed sequence file. Overwrites."""
    kind = format.lower()
    if kind in ("parquet", "avro"):
        stored = vectors.select(to_storage(F.col("features"), F.col("id"), sparse).alias("v")).select("v.id", "v.size", "v.values", "v.indices")
        stored.write.mode("overwrite").option("compression", "snappy" if compress else "zstd" if kind == "parquet" else "uncompressed").format(kind).save(path)
    elif kind == "svmlight":
        name = F.when(F.col("id") != "", F.col("id"))
        lines = vectors.select(svmlight(F.col("features"), name).alias("value"))
        lines.write.mode("overwrite").option("compression", "snappy" if compress else "none").text(path)
    elif kind == "seq":
        keys = {"int": int_key, "long": long_key, "text": text_key}
        if key not in keys:
            raise ValueError("the key is int, long or text")
        pairs = vectors.select(keys[key](F.col("id")).alias("k"), F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("v"))
        _save_sequence(pairs, path, compress)
    else:
        raise ValueError(f"unknown vector format {format}")


def _save_sequence(pairs: DataFrame, path: str, compress: bool = False) -> None:
    jvm = pairs.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(pairs.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    pairs.rdd.map(lambda r: (r[0], r[1])).saveAsSequenceFile(path, "org.apache.hadoop.io.compress.SnappyCodec" if compress else None)


def csv_lines(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """One ``value`` per row: the fields' texts, joined without quoting; null is empty."""
    return df.select(F.concat_ws(delimiter, *[F.coalesce(df[c].cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def write_records(df: DataFrame, path: str, format: str = "csv", delimiter: str = ",", exact: bool = False, compress: bool = False, table: str | None = None) -> None:
    """Records as csv (quoted, or plain joined text if ``exact``), parquet, avro or seq. Overwrites.

    ``table`` registers the output as an external table unless there is one of that name.
    """
    kind = format.lower()
    if kind == "csv" and exact:
        csv_lines(df, delimiter).write.mode("overwrite").option("compression", "snappy" if compress else "none").text(path)
    elif kind == "csv":
        df.write.mode("overwrite").options(sep=delimiter, quote='"', escape='"', compression="snappy" if compress else "none").csv(path)
    elif kind in ("parquet", "avro"):
        df.write.mode("overwrite").option("compression", "snappy" if compress else "zstd" if kind == "parquet" else "uncompressed").format(kind).save(path)
    elif kind == "seq":
        _save_sequence(csv_lines(df, delimiter).select(F.lit(0).alias("k"), "value"), path, compress)
    else:
        raise ValueError(f"unknown record format {format}")
    if table:
        external_table(df.sparkSession, table, df.schema, path, kind, delimiter)


def external_table(spark: SparkSession, name: str, schema: T.StructType, path: str, format: str = "parquet", delimiter: str = ",") -> bool:
    """Register files as a table; False, with nothing changed, if the table exists."""
    db, table = table_name(name)
    if spark.catalog.tableExists(f"{db}.{table}"):
        return False
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    options = f" OPTIONS (sep '{delimiter}')" if format == "csv" else ""
    spark.sql(f"CREATE TABLE `{db}`.`{table}` ({columns}) USING {format}{options} LOCATION '{path}'")
    return True


def drop_table(spark: SparkSession, name: str) -> None:
    db, table = table_name(name)
    spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{table}`")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of inputs of one schema, repeated rows too."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def first_vectors(vectors: DataFrame, count: int = 20) -> DataFrame:
    """``count`` vectors to look at, in no order."""
    return vectors.limit(count)
