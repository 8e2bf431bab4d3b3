"""Operator 1: best-fit packing of token sequences (best-two-fit).

Piece lengths are whole numbers up to the sequence length, so a histogram of them, of bounded size, is all
that the packing rule needs. The rule fills a bin greedily with the longest pieces that fit and then replaces the bin's smallest
piece by two unpacked ones that fit the widened gap more tightly. A bin's pattern is repeated as often as the counts
allow, so the plan has a few thousand lines whatever the corpus; pieces find their place in it by their rank among
the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.storage import Workspace, small
from quern.llm.tokens import MEMO_ENTRIES, encoded_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, place long"


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), by best-two-fit over a histogram of lengths from 1 to `capacity`."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan = []

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            lengths.remove(n)

    def give(n: int) -> None:
        if not left[n]:
            insort(lengths, n)
        left[n] += 1

    while lengths:
        before = dict.fromkeys(lengths)
        bin_, gap = [], capacity
        while gap and (k := bisect_right(lengths, gap)):
            n = lengths[k - 1]
            take(n)
            bin_.append(n)
            gap -= n
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room, best = gap + smallest, (smallest, 0, 0)
            lo, hi = 0, bisect_right(lengths, room) - 1
            while lo <= hi:
                a, b = lengths[lo], lengths[hi]
                if a + b > room or (lo == hi and left[a] < 2):
                    hi -= 1
                    continue
                if a + b > best[0]:
                    best = (a + b, b, a)
                lo += 1
            if best[0] > smallest:
                bin_.pop()
                give(smallest)
                for n in best[1:]:
                    take(n)
                    bin_.append(n)
        used = Counter(bin_)
        more = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= more * c
        lengths = [n for n in before if left[n]]
        plan.append((bin_, 1 + more))
    return plan


def plan_runs(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first, offset): where the pieces of a length go, by rank."""
    ranks: Counter = Counter()
    runs, sequence = [], 0
    for bin_, times in plan:
        at = 0
        for n in bin_:
            runs.append((n, ranks[n], ranks[n] + times, sequence, at))
            ranks[n] += times
            at += n
        sequence += times
    return runs


def _cut(tokenizer: str, end_id: int, capacity: int, narrow: bool, entries: int = MEMO_ENTRIES):
    """Cuts documents into pieces and ranks those of a length within the task."""

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch, encoded in encoded_slices(batches, tokenizer, True, entries=entries):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                total = len(ids) // 4
                if narrow and np.frombuffer(ids, "<u4").max() > 0xFFFF:
                    raise ValueError("ids of more than 16 bits; packing stores 16")
                first = (total - 1) % capacity + 1
                cuts = [0, *range(first, total + 1, capacity)]
                for k in range(len(cuts) - 1):
                    raw = ids[4 * cuts[k] : 4 * cuts[k + 1]]
                    n = cuts[k + 1] - cuts[k]
                    rows.append((doc, k, cuts[k], n, zlib.crc32(raw), np.frombuffer(raw, "<u4").astype("<u2").tobytes() if narrow else raw, part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "place"])

    return run


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, entries: int = MEMO_ENTRIES) -> DataFrame:
    """Pieces of `docs` (doc_id, text) with the sequence and offset that each is packed at.

    Returns doc_id, piece, start, length, ids_crc32, ids (little-endian 16-bit ids; a larger id is an error),
    sequence_id, offset. A null or empty text is a piece of the end id alone. Rows that repeat a
    doc_id, or have none, are documents of their own. A document of more than `capacity` ids is cut into pieces of
    `capacity`, the first one shorter where it doesn't come out even. Other columns of `docs`, whatever their names, are
    ignored. An empty table gives none. `entries` bounds what a Python worker remembers of words; it changes no result.
    """
    work = Workspace(spark, "pack")
    pieces = work.table(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_cut(tokenizer, end_id, capacity, True, entries), PIECES), "pieces")
    return place(spark, pieces, capacity, work)


def place(spark: SparkSession, pieces: DataFrame, capacity: int, work: Workspace) -> DataFrame:
    """Adds sequence_id and offset. `pieces` has length and its rank `place` among the pieces of that length in `part`."""
    held = work.table(pieces.groupBy("part", "length").count(), "held")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    runs = plan_runs(best_two_fit(counts, capacity))
    plan = spark.createDataFrame(runs, "run_length long, rank_from long, rank_to long, run_sequence long, offset long")
    ranked = pieces.join(small(bases, held.count()), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    fits = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.join(F.broadcast(plan), fits).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("run_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (16-bit), pieces (doc_id, piece, offset, length)."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(held.alias("held"))
    return grouped.select(
        "sequence_id",
        F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"),
        F.aggregate("held", F.lit(b""), lambda ids, x: F.concat(ids, x["ids"])).alias("ids"),
        F.transform("held", lambda x: x.dropFields("ids")).alias("pieces"),
    )


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
