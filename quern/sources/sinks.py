"""Sinks: compressed CSV exports and change logs that can be undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str) -> None:
    """Gzipped CSV with a header and quoted quotes; arrays are joined by a vertical bar."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)


def log_changes(plan: DataFrame, path: str, run_label: str) -> None:
    """Append a plan (key, old_value, new_value) to the log under `path`, one folder for each run."""
    plan.withColumn("run_label", F.lit(run_label)).write.mode("append").partitionBy("run_label").parquet(path)


def undo(spark: SparkSession, table: DataFrame, path: str, run_label: str, key: str, column: str) -> DataFrame:
    """`table` as it was before the run, where it still holds what the run wrote."""
    log = spark.read.parquet(path).where(F.col("run_label") == run_label).select(key, "old_value", "new_value")
    joined = table.join(log, key, "left")
    still = F.col("new_value").eqNullSafe(F.col(column)) & (F.col("old_value").isNotNull() | F.col("new_value").isNotNull())
    return joined.withColumn(column, F.when(still, F.col("old_value")).otherwise(F.col(column))).drop("old_value", "new_value")


def append_run(counts: DataFrame, path: str, file_name: str) -> None:
    """Append what a run matched (source, records) to the log of runs under `path`."""
    counts.select("source", F.col("records").cast("long"), F.lit(file_name).alias("file_name")).write.mode("append").parquet(path)
