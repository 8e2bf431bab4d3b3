"""Connected components over edge tables of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, component (the smallest node that edges reach): a row for each node of `edges` (src, dst), but for the smallest of each
    component, which needs none. Edges from a node to itself or with a null count for nothing."""
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, seen = work.table(pairs, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        both = now.union(now.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        large = work.table(large, "large")
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(nearest.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = work.table(moved.union(nearest.select("u", "m")).where("u <> v").distinct(), "small")
