"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a local folder only where that is unset and Spark runs locally, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Whether Spark removes shuffle files when the query that wrote them ends, rather than when the driver happens to collect its garbage. Fixed for a DataFrame when that is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Workspace:
    """A folder of its own for the tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def new_path(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` once and read it back: a lost executor costs a re-read, never a re-computation. What it was shuffled by is removed."""
        path = self.new_path(name)
        with shuffles_removed(self.spark):
            df.select("*").write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, table: DataFrame) -> None:
        """Remove the files of a table that nothing reads any more."""
        _, path = self._paths.pop(id(table))
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows up to which a table of a few numbers a row is sent to every executor; beyond it, joins shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for a broadcast join only if its counted `rows` are within `limit`."""
    return df.hint("broadcast") if rows <= limit else df
