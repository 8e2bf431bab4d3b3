"""Operator 12: what each of five filters removes, in every order in which they can be applied, by lookup of the first failure.

A document fails some subset of the filters: a mask of five bits. A table of 32 masks by 120 orders says at which step a document is
removed. Tasks index it by the masks of their rows and count removals by part, order, step and label; these partial arrays are
summed. All other figures follow from them: what a filter would remove alone stands at step 1 of an order that begins with it, what nothing else
would remove at step 5 of one that ends with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.storage import Workspace, small
from quern.llm.words import blocks, table_without

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS) + 1  # the last: kept
IS_WORD = table_without((0x20, 0x20), (0x09, 0x0D))
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_SIGN = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", dtype=np.uint8))
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
#: Rows that are looked up at a time; parts whose counts a task holds before it hands them on.
ROWS, PARTS = 1024, 256
#: A text is hot if more than one in so many documents has it; there are at most as many hot texts.
HOT = 1000


def removal_table() -> np.ndarray:
    """Step (from 0) at which a document that fails the filters of a mask is removed by each order; 5 if it is kept."""
    out = np.full((1 << len(FILTERS), len(ORDERS)), STEPS - 1, dtype=np.int64)
    for mask in range(1, len(out)):
        failed = {f for k, f in enumerate(FILTERS) if mask >> k & 1}
        out[mask] = [min(order.index(f) for f in failed) for order in ORDERS]
    return out


def failures(text: Column, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> Column:
    """Struct of the mask of filters A to D that a text fails (A: bit 0) and the SHA-256 of its bytes. A null text is the empty one."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            column = column.fill_null(b"")
            n = len(column)
            words, distinct, capitals, points, signs = (np.zeros(n, dtype=np.int64) for _ in range(5))
            seen: set[bytes] = set()  # words of a text that comes in parts
            for b in blocks(column, IS_WORD):
                rows, ids, spelt = b.words(IS_WORD)
                here = slice(b.row, b.row + b.rows)
                words[here] += np.bincount(rows, minlength=b.rows)
                if b.last and not seen:
                    distinct[here] = np.bincount(np.unique(rows * (len(spelt) + 1) + ids) // (len(spelt) + 1), minlength=b.rows)
                else:
                    seen.update(spelt)
                    distinct[b.row] = len(seen)
                    if b.last:
                        seen = set()
                for out, of in ((capitals, _CAPITAL), (points, _FIRST_BYTE), (signs, _SIGN)):
                    upto = np.concatenate([[0], np.cumsum(of[b.data], dtype=np.int64)])
                    out[here] += upto[b.offsets[1:]] - upto[b.offsets[:-1]]
            failed = (words < least_words, 100 * distinct < distinct_percent * words, 100 * capitals > capital_percent * points, signs > 0)
            mask = sum(f.astype(np.int32) << k for k, f in enumerate(failed))
            digest = [hashlib.sha256(t.as_buffer() or b"").digest() for t in column]
            yield pa.StructArray.from_arrays([pa.array(mask, pa.int32()), pa.array(digest, pa.binary())], names=["mask", "digest"])

    return F.arrow_udf(run, "mask int, digest binary").asNondeterministic()(text.cast("binary"))


def repeats(facts: DataFrame, work: Workspace) -> DataFrame:
    """`facts` (doc_id, digest, mask, part) with bit 4 set in the mask of each document whose text a smaller doc_id has.

    Texts that very many documents share meet their smallest id by a broadcast of at most HOT rows, the others by a join on the digest."""
    groups = facts.groupBy(F.col("digest").alias("text_digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    groups = work.table(groups, "texts")
    total = facts.count()
    hot = F.col("n") > max(total // HOT, 1)
    common, rare = F.broadcast(groups.where(hot)), groups.where(~hot)  # at most HOT rows
    same = F.col("digest") == F.col("text_digest")
    rest = facts.join(common, same, "left_anti").join(small(rare, rare.count()), same, "left")
    found = facts.join(common, same).unionByName(rest)
    late = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return found.select("doc_id", "part", F.when(late, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask"))


def label_codes(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """`facts` with `label`: 1 for a document that a label calls good, plus 2 for one that a label calls toxic. Ids without a label, and null ids, have 0."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id"))
    codes = known.agg((F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("label")).where("label > 0")
    joined = facts.where("doc_id IS NOT NULL").join(small(codes, codes.count()), F.col("doc_id") == F.col("label_id"), "left")
    coded = joined.select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"))
    return coded.union(facts.where("doc_id IS NULL").select("part", "mask", F.lit(0)))


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, orders = removal_table(), np.arange(len(ORDERS))
    width = len(ORDERS) * STEPS * 4
    held: dict[str, np.ndarray] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["part", "counts"])

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            parts = piece.column("part").dictionary_encode()
            step = table[piece.column("mask").to_numpy()]
            cell = ((parts.indices.to_numpy()[:, None] * len(ORDERS) + orders) * STEPS + step) * 4 + piece.column("label").to_numpy()[:, None]
            counts = np.bincount(cell.ravel(), minlength=len(parts.dictionary) * width).reshape(-1, width)
            for part, row in zip(parts.dictionary.to_pylist(), counts, strict=True):
                held[part] = held[part] + row if part in held else row
            if len(held) > PARTS:
                yield out()
                held.clear()
    if held:
        yield out()


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each source of `docs` (doc_id, text, source).

    `labels` has doc_id, quality, toxic; with several rows for an id, one that says 1 is enough. A null text is empty, a null source is the part "". A null id
    is no smaller and no larger than any: it fails no filter E. Rows repeated under one id don't repeat each other. Very long texts
    are read in parts, other columns not at all. An empty table has no parts and no rows.
    """
    work = Workspace(spark, "audit")
    found = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(F.col("text")).alias("found"))
    facts = work.table(found.select("doc_id", "part", "found.mask", "found.digest"), "facts")
    partial = label_codes(repeats(facts, work), labels).mapInArrow(_removals, "part string, counts array<long>")
    cells = partial.select("part", F.posexplode("counts").alias("cell", "n")).groupBy("part", "cell").agg(F.sum("n").alias("n"))
    step, label = F.floor(F.col("cell") / 4) % STEPS, F.col("cell") % 4
    of = lambda wanted: F.sum(F.when(wanted, F.col("n")).otherwise(0))
    steps = cells.groupBy("part", F.floor(F.col("cell") / (4 * STEPS)).cast("int").alias("at"), (step + 1).cast("int").alias("step")).agg(
        F.sum("n").alias("removed"), of(label % 2 == 1).alias("good_lost"), of(label >= 2).alias("toxic_lost")
    )
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("at") + 1)
    later = Window.partitionBy("part", "at").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)  # six rows
    named = steps.withColumn("kept", F.sum("removed").over(later)).where(F.col("step") < STEPS).withColumn("filter_order", order)
    named = named.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    every = Window.partitionBy("part", "filter")  # one row for each order
    fails, alone = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(every), F.max(F.when(F.col("step") == STEPS - 1, F.col("removed"))).over(every)
    return named.select(
        "part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(every).alias("shapley")
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM texts LEFT JOIN known USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
ends AS (
  SELECT part, filter_order, fails, n, good, toxic, coalesce(list_min(list_transform(string_split(fails, ''), lambda c: CASE WHEN c <> '' THEN strpos(filter_order, c) END)), 6) AS gone
  FROM masks, orders),
rows AS (
  SELECT part, filter_order, step, any_value(f) AS f, coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
    coalesce(sum(n) FILTER (gone < step AND contains(fails, f)), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
  FROM ends JOIN steps USING (filter_order) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM rows
"""
