"""Tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a session without that setting (tests, one machine) gets a temporary folder.
    """
    found = spark.sparkContext.getConf().get(KEY) or spark.conf.get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veldra-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


#: Folders that this process wrote to and hasn't dropped.
_WRITTEN: set[str] = set()


def drop_all(spark: SparkSession) -> None:
    """Delete all tables of this process. For callers that have stored the results they wanted: results read these tables."""
    for path in list(_WRITTEN):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        _WRITTEN.discard(path)


class Scratch:
    """Named tables of one query under the shared folder.

    ``put`` writes a DataFrame and returns it read back: the plan starts anew at the files, whose
    size the optimizer knows. ``drop`` removes tables that nothing reads any more; a result's own
    tables stay until its reader calls ``drop_all``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/veldra/{label}-{uuid.uuid4().hex}"
        _WRITTEN.add(self.path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def size(self, name: str) -> int:
        """Bytes of a table's files."""
        path, fs = self._file(name)
        return fs.getContentSummary(path).getLength()

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._file(name)
            fs.delete(path, True)

    def keep(self, *names: str) -> None:
        """Drop all tables but these."""
        path, fs = self._file("")
        for found in fs.listStatus(path):
            if found.getPath().getName() not in names:
                fs.delete(found.getPath(), True)

    def _file(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
