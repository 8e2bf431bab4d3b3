"""What is in nested records that nobody has described: paths, types, presence and vocabularies, by a walk over VARIANT values; and probing such records by rules in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.shared import shared_path

#: Levels that a walk goes down at most.
DEPTH = 32


def walk(spark: SparkSession, rows: DataFrame, key: str, text: str, depth: int = DEPTH) -> DataFrame:
    """key, path, type, value for every value inside the JSON texts: objects as `.name`, elements of any array as `[*]`, value only of scalars.

    No field is named beforehand; `key` may not be called pos, key, value, path, type or v. Each level is one generator over the values of the level above; levels go on until one has no objects and no arrays. A text that
    isn't JSON has the one row `$`, malformed; a null text has none. Of a level, scalars are written as their values, and only objects and arrays as VARIANT.
    """
    base = shared_path(spark, "walk")
    parsed = rows.where(F.col(text).isNotNull()).select(F.col(key), F.lit("$").alias("path"), F.try_parse_json(F.col(text)).alias("v"))
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    level, out = parsed.withColumn("type", F.when(F.col("v").isNull(), "malformed").otherwise(kind)), []
    for k in range(depth):
        nested = F.col("type").isin("OBJECT", "ARRAY")
        scalar = ~nested & (F.col("type") != "malformed")
        level = level.select(key, "path", "type", F.when(scalar, F.try_variant_get("v", "$", "string")).alias("value"), F.when(nested, F.col("v")).alias("outer_v"))
        level.write.parquet(f"{base}/{k}")
        level = spark.read.schema(level.schema).parquet(f"{base}/{k}")
        out.append(level.select(key, "path", "type", "value"))
        inner = level.where(nested).select(key, "path", "type", "outer_v")
        if inner.isEmpty():
            break
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("outer_v").outer()))
        step = F.when(F.col("type") == "ARRAY", "[*]").otherwise(F.concat(F.lit("."), F.col("key")))
        stepped = below.select(key, F.concat("path", step).alias("path"), F.col("value").alias("v"))
        level = stepped.withColumn("type", kind)
    whole = out[0]
    for o in out[1:]:
        whole = whole.union(o)
    return whole


def census(walked: DataFrame, key: str, vocabulary: int = 20) -> DataFrame:
    """path, type, records (that have it), n (values), distinct (values), words: all values in order where there are at most `vocabulary`, else null."""
    spark = walked.sparkSession
    grouped, at = walked.groupBy("path", "type", "value").agg(F.count("*").alias("n")), shared_path(spark, "census")
    grouped.write.parquet(at)  # it is read for the numbers and for the words
    counted = spark.read.schema(grouped.schema).parquet(at)
    values = counted.groupBy("path", "type").agg(F.sum("n").alias("n"), F.count("value").alias("distinct"))
    few = values.where(F.col("distinct") <= vocabulary).select("path", "type")
    words = counted.where("value IS NOT NULL").join(few, ["path", "type"], "left_semi").groupBy("path", "type").agg(F.array_sort(F.collect_list("value")).alias("words"))  # at most `vocabulary`
    records = walked.select("path", "type", key).distinct().groupBy("path", "type").agg(F.count("*").alias("records"))
    return records.join(values, ["path", "type"]).join(words, ["path", "type"], "left").select("path", "type", "records", "n", "distinct", "words")


def probed(record: Column, probes: Sequence[tuple[str, str, Sequence[tuple[str, str]]]]) -> Column:
    """struct(value, found, reasons): the value of the first probe that holds, its name, and why each earlier one doesn't, in order.

    A probe has a name, a path into the VARIANT `record`, and refusals (reason, pattern) of which none may match the value; an absent or blank value is refused as `absent`.
    """
    tried = F.array(*(F.struct(F.lit(name).alias("name"), F.trim(F.try_variant_get(record, path, "string")).alias("value")) for name, path, _ in probes))
    why = []
    for k, (name, _, refusals) in enumerate(probes):
        value = tried[k]["value"]
        chain = F.when(F.coalesce(value, F.lit("")) == "", f"{name}: absent")
        for reason, pattern in refusals:
            chain = chain.when(value.rlike(pattern), f"{name}: {reason}")
        why.append(chain)
    held = F.coalesce(*(F.when(w.isNull(), F.lit(k)) for k, w in enumerate(why)))
    reasons = F.slice(F.array(*why), 1, F.coalesce(held, F.lit(len(probes))))
    return F.struct(F.get(tried, held)["value"].alias("value"), F.get(tried, held)["name"].alias("found"), reasons.alias("reasons"))
