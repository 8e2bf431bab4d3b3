"""A corpus pipeline of five stages of quern.llm; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import language_id, line_dedup, mixing, ngram_join, packing
from quern.llm.storage import Workspace


#: Pieces of words that a Python worker remembers while it packs: fewer than by default, as executors still hold what the stages before needed.
PACKING_ENTRIES = 300_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # so that no name of a column clashes with a prediction's
    return language_id.predict(rows, model, ["row"]).where(~F.col("rejected")).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occurred earlier, exactly or nearly."""
    return line_dedup.apply_line_dedup(docs, line_dedup.dedup_lines(spark, docs))


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(spark, docs, ngram_join.jaccard_classes(spark, docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    weights = mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.apply_mix(docs, mixing.mix(spark, docs, weights))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in packed sequences."""
    return packing.pack(spark, docs, entries=PACKING_ENTRIES).drop("ids")


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("ngram_join", join_ngrams), ("mixing", mix_sources), ("packing", pack_documents)]

#: Tokenizers, shingles and centroids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), False
    for name, stage in STAGES:
        done = work.table(stage(spark, docs, sf_dir), name)
        if written:  # the next stage has all that it needs of it
            work.drop(docs)
        docs, written = done, True
    return docs
