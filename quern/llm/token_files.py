"""Operator 2: token ids as Parquet list columns.

Files are in doc_id order. Ids are dictionary encoded where that is smaller and delta encoded past it (second
version of the page format); row groups and pages are kept small, and page indexes let a reader fetch the tokens of few
documents, or only their metadata.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import workers
from quern.llm.storage import Workspace, small
from quern.llm.tokens import encoded_slices

#: Parquet writer settings: bytes of a row group, bytes and rows of a page.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "512", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "compression": "zstd"}
#: Bytes of text that a file stands for, and the least that a file of its own is worth where there are more cores than files.
FILE_BYTES, LEAST_FILE_BYTES = 256 << 20, 4 << 20
#: Pieces that a worker remembers while it encodes: each once, so fewer than elsewhere do.
ENTRIES = 500_000
STORED = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _encode(tokenizer: str, spaced: bool, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch, encoded in encoded_slices(batches, tokenizer, spaced, entries=ENTRIES):
            sizes = np.array([len(e) // 4 + 1 for e in encoded], dtype=np.int64)
            starts = at + np.concatenate([[0], np.cumsum(sizes)])
            offsets = pa.array(starts - at, pa.int32())
            values = pa.array(np.frombuffer(b"".join(e + end for e in encoded), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(starts[:-1]), pa.array(sizes), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            at = int(starts[-1])

    return run


def file_count(size: int, cores: int) -> int:
    return max(1, -(-size // FILE_BYTES), min(4 * cores, -(-size // LEAST_FILE_BYTES)))


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", spaced: bool = False, end_id: int = 1, files: int | None = None) -> None:
    """Write the ids of `docs` (doc_id, text) to Parquet files under `path`, in ascending doc_id order over all files.

    A null or empty text is the end id alone. Rows without a doc_id come first; rows that repeat one are
    stored one after another, in several files if they are many. Other columns are ignored. An empty table gives files without rows. The number of files follows
    the bytes of the texts unless `files` says it.
    """
    n = files or file_count(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, spark.sparkContext.defaultParallelism)
    order = F.col("doc_id").asc_nulls_first()
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.rand(11).alias("spread")).repartitionByRange(n, order, "spread")
    dealt.sortWithinPartitions(order).select("doc_id", "text").mapInArrow(_encode(tokenizer, spaced, end_id), STORED).write.options(**LAYOUT).parquet(path)


def read_token_files(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids. A range of doc_id is pushed down to row groups and pages; unselected columns aren't read."""
    stored = spark.read.schema(STORED).parquet(path)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = sizes.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
    if low is not None:
        stored = stored.where(F.col("doc_id") >= low)
    if high is not None:
        stored = stored.where(F.col("doc_id") <= high)
    joined = stored.join(small(bases, bases.count()), "part")
    return joined.select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    workers.works_for("token_files")  # what was remembered for encoding isn't needed any more
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        sizes = np.diff(offsets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").new_path("ids")
    write_token_files(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path).select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
