"""Operator 8: token counts as an exact length histogram.

Each task counts the encoded lengths of its documents; the counts are added up by length. Suffix sums over
the histogram answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.storage import Workspace
from quern.llm.tokens import encoded_slices


def _lengths(tokenizer: str, spaced: bool, extra: int):
    def run(batches):
        held: Counter = Counter()
        for _, encoded in encoded_slices(batches, tokenizer, spaced):
            held.update(len(e) // 4 + extra for e in encoded)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], names=["length", "n"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", spaced: bool = True, extra: int = 0) -> DataFrame:
    """length, n_docs: how many documents have that many ids (plus `extra` for ids added to each).

    A null or empty text has no ids and counts under 0 + `extra`. Rows that repeat a document count again. Other
    columns are ignored. An empty table gives an empty histogram.
    """
    counted = docs.select("text").mapInArrow(_lengths(tokenizer, spaced, extra), "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, as a context limit: documents and tokens of at least L, and the tokens left if all
    documents are cut at L.

    Rows of the histogram are distinct lengths, so they grow with the longest document, not with the corpus. They are summed in
    buckets of nearby lengths first, so no task holds them all.
    """
    bucket = F.floor(F.log2(F.greatest(F.col("length"), F.lit(1)) + 0.0) * 16)
    rows = histogram.withColumn("bucket", bucket).withColumn("tokens", F.col("length") * F.col("n_docs"))
    sums = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most 16 rows a doubling
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = sums.select("bucket", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c) for c in "dt"), F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    within = Window.partitionBy("bucket").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("wd", F.sum("n_docs").over(within)).withColumn("wt", F.sum("tokens").over(within)).join(F.broadcast(later), "bucket")
    out = held.withColumn("docs_from", F.col("wd") + F.col("d")).withColumn("tokens_from", F.col("wt") + F.col("t"))
    return out.select("length", "n_docs", "docs_from", "tokens_from", (F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("tokens_cut_at"), "total_docs", "total_tokens")


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share `q` of the documents don't exceed."""
    return sums.where(F.col("total_docs") - F.col("docs_from") + F.col("n_docs") >= F.ceil(F.lit(q) * F.col("total_docs"))).agg(F.min("length").alias("length"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens kept if every document is cut at `limit`, any limit."""
    at = F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("length") >= limit, F.col("length")))
    held = sums.agg(at.alias("x"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"))
    return held.select((F.col("total") - F.coalesce(F.col("x.tokens_from") - F.lit(limit) * F.col("x.docs_from"), F.lit(0))).alias("tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return with_suffix_sums(Workspace(spark, "lengths").table(histogram, "histogram"))
