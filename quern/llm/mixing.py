"""Operator 9: mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A document's key is exponential with a rate of its quality weight; in ascending order of keys, documents form a weighted sample
without replacement. A source whose target exceeds its size gives complete epochs first; the rest of its target is the prefix of
its documents, by key, that comes nearest to it. Keys fall into buckets that partition a source of any size, and only
the bucket in which the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.storage import Workspace, small

#: A run of characters other than space and the five control characters that separate words.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in code-point order, repeating.
CYCLE = (3.0, 1.0, 2.0)
#: Documents that a bucket of keys holds, about.
BUCKET_DOCS = 4096
#: Quality weight by label: good, bad, none.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """In (0, 1], from the first 52 bits of the MD5 of the id as text ("null" for none); the same in every run."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(2**52))


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: GOOD where most of a document's quality labels are 1, else BAD. Null labels and ids count for nothing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg(F.when(F.avg("quality") >= 0.5, GOOD).otherwise(BAD).alias("weight"))


def targets(sources: DataFrame, share: float, most: float, work: Workspace) -> DataFrame:
    """source, source_size, n, target. Every source gets its weight's part of `share` times all sizes; what exceeds `most` times a
    source's size is shared anew among the others until none is above."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    cycle = F.element_at(F.array(*map(F.lit, CYCLE)), ((F.row_number().over(order) - 1) % len(CYCLE) + 1).cast("int"))
    weighed = work.table(sources.withColumn("share", cycle).withColumn("cap", F.col("source_size") * most), "sources")
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, F.lit(False)
    while True:
        full, weights = weighed.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("share")))).first()
        new = (total - (full or 0.0)) / weights if weights else level
        if new <= level:
            break
        level = new
        capped = F.col("share") * level > F.col("cap")
    return weighed.select("source", "source_size", "n", F.least(F.col("share") * level, F.col("cap")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies: a row for each row of `docs` (doc_id, source, text).

    `copies` is how often the mix takes the document: the epochs of its source, and one more if it is selected. `weights` has doc_id
    and weight; documents without one weigh UNKNOWN. A null text has size 0. A null source is a source, the last one. Rows
    equal in id, source and text share their decision. With an empty table, or no words, nothing is taken.
    """
    work = Workspace(spark, "mix")
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("size"))
    known = F.col("doc_id").isNotNull()  # rows without an id have no weight; a join would send all of them to one task
    weighed = sized.where(known).join(weights.select(F.col("doc_id").alias("weight_id"), F.col("weight").alias("w")), F.col("doc_id") == F.col("weight_id"), "left")
    keyed = weighed.drop("weight_id").unionByName(sized.where(~known).withColumn("w", F.lit(None).cast("double")))
    key = -F.log(uniform(F.col("doc_id"))) / F.coalesce(F.col("w"), F.lit(UNKNOWN))
    rows = work.table(keyed.select("doc_id", "source", "text_hash", "size", key.alias("key")), "keys")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = work.table(
        targets(sources, share, most, work)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_DOCS)),
        "goals",
    )
    n_sources = goals.count()
    goal = lambda *names: small(goals.select(F.col("source").alias("goal_source"), *names), n_sources)
    same = F.col("source").eqNullSafe(F.col("goal_source"))
    bucket = F.floor(F.col("buckets") * (1 - F.exp(-F.col("key"))))
    placed = rows.join(goal("rest", "buckets"), same).withColumn("bucket", bucket)
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # a source's buckets
    ends = sums.withColumn("upto", F.sum("held").over(upto)).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("held") <= F.col("rest")))
    last = ends.groupBy(F.col("source").alias("end_source")).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("held")).alias("before")), "bucket").alias("end"))
    final = placed.join(small(last, n_sources), F.col("source").eqNullSafe(F.col("end_source")) & (F.col("bucket") == F.col("end.bucket")))
    units = final.groupBy("source", "key", "doc_id", "text_hash").agg(F.sum("size").alias("unit"), F.first("rest").alias("rest"), F.first("end.before").alias("before"))
    along = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "text_hash").rowsBetween(Window.unboundedPreceding, 0)  # one bucket of a source
    run = units.withColumn("upto", F.col("before") + F.sum("unit").over(along))
    fits = run.where(F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("unit")))
    order = F.struct("key", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text_hash")
    cuts = fits.groupBy(F.col("source").alias("cut_source")).agg(F.max(order).alias("cut"))
    edges = last.select(F.col("end_source").alias("goal_source"), F.col("end.bucket").alias("end_bucket")).join(cuts, F.col("goal_source").eqNullSafe(F.col("cut_source")), "left").select("goal_source", "end_bucket", "cut")
    decided = work.table(goals.join(edges, F.col("source").eqNullSafe(F.col("goal_source")), "left").drop("goal_source"), "decided").withColumnRenamed("source", "goal_source").drop("n")
    joined = rows.join(small(decided, n_sources), same).withColumn("bucket", bucket)
    chosen = (F.col("rest") > 0) & ((F.col("bucket") < F.col("end_bucket")) | ((F.col("bucket") == F.col("end_bucket")) & (order <= F.col("cut"))))
    copies = F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long")
    return joined.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.least(copies, F.lit(int(most))).cast("int").alias("copies"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. Rows meet their decisions by a shuffle on id, source and text at every size: decisions are as many as documents."""
    wanted = mixed.where("copies > 0").select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), "text_hash", "copies").distinct().hint("shuffle_hash")
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("row_id"), F.col("source").alias("row_source"), F.xxhash64("text").alias("row_hash"))
    on = F.col("row_id").eqNullSafe(F.col("mix_id")) & F.col("row_source").eqNullSafe(F.col("mix_source")) & (F.col("row_hash") == F.col("text_hash"))
    return rows.join(wanted, on).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), weights)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
weights AS (SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 2.0 ELSE 0.5 END::DOUBLE AS w FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sources AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS share
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
levels(step, level) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE / sum(share) FROM sources)
  UNION ALL
  SELECT step + 1, ((SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM sources) - (SELECT coalesce(sum(cap), 0) FROM sources WHERE share * level > cap)) / (SELECT sum(share) FROM sources WHERE NOT share * level > cap)
  FROM levels WHERE step < 40),
goals AS (SELECT source, source_size, least(share * (SELECT max(level) FROM levels), cap) AS target FROM sources),
keyed AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs,
    -ln((('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0::DOUBLE) / coalesce(w.w, 1.0::DOUBLE) AS key
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN weights w ON s.doc_id = w.doc_id),
runs AS (SELECT *, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, size, source_size, target,
  (size * least(2, epochs + CASE WHEN rest > 0 AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM runs
"""
