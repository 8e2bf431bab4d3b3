"""Operator 11: importance resampling towards the distribution of a target text, over hashed word n-grams.

An integer dictionary maps the distinct words of a block to ids; n-grams are tuples of ids, each distinct tuple is spelt out and hashed once, and
its bucket is joined back to all of its occurrences by id. A dictionary of the whole corpus would need a shuffle of every occurrence;
buckets are the same in every block, so only bucket counts leave a task. One pass counts the buckets of the documents, one those of the target, a
last one weighs documents by the mean gain of their n-grams. Gumbel noise from a hash of the id makes the highest scores a weighted sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.storage import Workspace
from quern.llm.words import Block, blocks, table_without

BUCKETS = 10_000
#: Words have digits, ASCII letters and everything beyond ASCII.
IS_WORD = table_without((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)) | np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Drawn documents that one task ranks, about.
RANKED_ROWS = 500_000


def _features(block: Block, longest: int, carried: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Row and bucket of every run of 1 to `longest` words that ends in `block`; words of each row; the last words, for the next part of a long text."""
    words = len(carried)
    if carried:
        lead = np.frombuffer(b" ".join(carried) + b" ", dtype=np.uint8)
        block = Block(block.row, 1, np.concatenate([lead, block.data]), np.array([0, len(lead) + len(block.data)]), block.last)
    rows, ids, spelt = Block(block.row, block.rows, _LOWER[block.data], block.offsets, block.last).words(IS_WORD)
    ids = ids.astype(np.int64)
    out_rows, out_buckets, tuples, runs = [], [], list(spelt), ids
    for n in range(1, longest + 1):
        if n > 1:
            keys, runs = np.unique(runs[:-1] * len(spelt) + ids[n - 1 :], return_inverse=True) if len(runs) > 1 else (np.zeros(0, np.int64), runs[:0])
            tuples = [tuples[k // len(spelt)] + b" " + spelt[k % len(spelt)] for k in keys.tolist()]
        hashed = np.fromiter((zlib.crc32(t) % buckets for t in tuples), dtype=np.int64, count=len(tuples))
        ends = np.arange(n - 1, n - 1 + len(runs))
        taken = (rows[ends] == rows[: len(runs)]) & (ends >= words)
        out_rows.append(rows[: len(runs)][taken])
        out_buckets.append(hashed[runs[taken]])
    last = [spelt[i] for i in ids[max(0, len(ids) - longest + 1) :].tolist()] if longest > 1 and not block.last else []
    return np.concatenate(out_rows), np.concatenate(out_buckets), np.bincount(rows[words:], minlength=block.rows), last


def _by_block(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray]]:
    carried: list[bytes] = []
    for block in blocks(column, IS_WORD):
        rows, found, words, carried = _features(block, longest, carried, buckets)
        yield block, rows, found, words


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the column `text` of all rows; null texts have no words."""

    def count(batches):
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found, _ in _by_block(batch.column("text"), longest, buckets):
                held += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["bucket", "n"])

    rows = texts.where("text IS NOT NULL").select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths, from counts smoothed by one a bucket."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(text: Column, gain: np.ndarray, longest: int = 1) -> Column:
    """Struct of n_words, n_features and weight, the floored mean of the gains of a text's features; all 0 for null or a text without words."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            words, features, total = (np.zeros(len(column), dtype=np.int64) for _ in range(3))
            for block, rows, found, counted in _by_block(column.fill_null(b""), longest, len(gain)):
                here = slice(block.row, block.row + block.rows)
                words[here] += counted
                features[here] += np.bincount(rows, minlength=block.rows)
                np.add.at(total[here], rows, gain[found])
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(features), pa.array(total // np.maximum(features, 1))], names=["n_words", "n_features", "weight"])

    return F.arrow_udf(run, "n_words long, n_features long, weight long").asNondeterministic()(text.cast("binary"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from SHA-256 of `seed:doc_id`; a null id counts as the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranks(spark: SparkSession, rows: DataFrame, n: int, order: list[str], work: Workspace) -> DataFrame:
    """`rows` (`n` of them) with `rank` from 1 in descending order of the first column of `order`, ascending of the rest. Rows are dealt by range, equal ones
    by a random number, so that no task holds more than its share; a rank is the place in a range behind all earlier ranges."""
    by = [F.col(order[0]).desc(), *(F.col(c).asc_nulls_last() for c in order[1:])]
    dealt = rows.withColumn("spread", F.rand(17)).repartitionByRange(max(1, -(-n // RANKED_ROWS)), *by, "spread").withColumn("span", F.spark_partition_id())
    dealt = work.table(dealt.drop("spread"), "dealt")
    spans = sorted((r["span"], r["count"]) for r in dealt.groupBy("span").count().collect())  # a row for each range
    upto = np.cumsum([0, *(c for _, c in spans)]).tolist()
    before = spark.createDataFrame([(s, b) for (s, _), b in zip(spans, upto[:-1], strict=True)], "first_of int, before long")
    placed = dealt.join(F.broadcast(before), F.col("span") == F.col("first_of"))  # as many rows as ranges
    return placed.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("span").orderBy(*by))).drop("span", "first_of", "before")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, least_words: int = 20, seed: str = "2024", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of `docs` (doc_id, text), drawing `percent` of those with `least_words` words or more towards `target` (text).

    A null or empty text has no features, weight 0 and is never drawn. A null id is hashed as the empty text and comes last among ties. Repeated rows are
    documents of their own: equal ones get ranks next to each other. Texts of any length are read in parts. Other columns are not touched. Without documents
    there are no rows; without target texts only the smoothing counts.
    """
    work = Workspace(spark, "resample")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    weighed = docs.select("doc_id", weigh(F.col("text"), gain, longest).alias("found"))
    scored = weighed.select("doc_id", "found.n_words", "found.n_features", "found.weight", (F.col("found.weight") + noise(F.col("doc_id"), seed)).alias("score"))
    scored = work.table(scored, "scored")
    fit = F.col("n_words") >= least_words
    counts = scored.where(fit).groupBy("score").count().toArrow()  # a row for each score in thousandths: some ten thousand, however many documents
    order = np.argsort(-counts["score"].to_numpy())
    scores, upto = counts["score"].to_numpy()[order], np.cumsum(counts["count"].to_numpy()[order])
    take = percent * int(upto[-1] if len(upto) else 0) // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not take:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = int(np.searchsorted(upto, take))
    drawable = fit & (F.col("score") >= int(scores[last]))
    ranked = ranks(spark, scored.where(drawable).select(*columns), int(upto[last]), ["score", "doc_id", "n_features"], work)
    drawn = ranked.select(*columns, F.when(F.col("rank") <= take, F.col("rank")).alias("rank"))
    return drawn.union(scored.where(~drawable).select(*columns, F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
low AS (SELECT doc_id, row_number() OVER () AS row, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT row, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM low),
held AS (SELECT row, w, count(*) AS n FROM words GROUP BY ALL),
goal AS (
  SELECT w, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
spelt AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM held UNION SELECT w FROM goal)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM spelt, crc_table),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM held JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS n FROM goal JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::BIGINT AS s, coalesce((SELECT sum(n) FROM t), 0)::BIGINT AS t),
gains AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (sums.s + 10000))::DOUBLE / ((s.n + 1) * (sums.t + 10000))::DOUBLE))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT row, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM held JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM low LEFT JOIN weights USING (row)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM placed
"""
