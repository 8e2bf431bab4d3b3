"""Which entity a text names: joins by containment and by spelling, and cascades of ever weaker evidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.folding import nearly_equal
from quern.sources.shared import shared_path

#: A key is specific enough to be looked for inside longer names if it has so many words or so many characters.
WORDS, CHARACTERS = 2, 7

#: Rows of a table of keys up to which it is sent to every executor.
FEW = 100_000


def few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def widened(keys: DataFrame, names: DataFrame) -> DataFrame:
    """key_id, name_id, how (exact or contains) for keys (key_id, key, needs) and names (name_id, name), both in lower-case words with single spaces.

    Every key equal to a name meets it. A specific key also meets the names that it stands in as whole words, found through the rarest of its words as an inverted
    index, so only names with that word are compared. A name that lacks a word group of `needs` (what the key is restricted to), or that says the opposite
    (free of, without, no, not), isn't met that way. Keys or names that are null or empty meet nothing.
    """
    keyed = keys.where(F.col("key") != "")
    named = names.where(F.col("name") != "")
    exact = keyed.join(named, F.col("key") == F.col("name")).select("key_id", "name_id", F.lit("exact").alias("how"))
    specific = keyed.where((F.size(F.split("key", " ")) >= WORDS) | (F.length("key") >= CHARACTERS))
    parts = specific.select("key_id", "key", "needs", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    n_parts = parts.count()
    wanted = few(parts.select("word").distinct(), n_parts)
    words = named.select("name_id", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    at = words.select("name_id", "word").join(wanted, "word", "left_semi")  # words that no key has aren't shuffled, names never
    spread = at.groupBy("word").agg(F.count("*").alias("spread"))
    rarest = parts.join(spread, "word").groupBy("key_id", "key").agg(F.min_by("word", F.struct("spread", "word")).alias("word"), F.any_value("needs").alias("needs"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    inside = pad(F.col("name")).contains(pad(F.col("key"))) & (F.col("name") != F.col("key"))
    if n_parts <= FEW:
        met = words.join(F.broadcast(rarest), "word").where(inside)
    else:
        met = rarest.join(at, "word").join(named, "name_id").where(inside)
    denies = [F.concat("key", F.lit(" free")), *(F.concat(F.lit(d + " "), "key") for d in ("free of", "free from", "no", "without", "not"))]
    denied = F.lit(False)
    for d in denies:
        denied = denied | pad(F.col("name")).contains(pad(d))
    met = met.where(~denied & F.forall(F.coalesce("needs", F.array().cast("array<string>")), lambda n: pad(F.col("name")).contains(pad(n))))
    return exact.union(met.select("key_id", "name_id", F.lit("contains")))


def _grams(names: DataFrame, name: str) -> DataFrame:
    """The bigrams of each distinct name, numbered where they repeat."""
    distinct = names.where(F.length(name) > 0).select(name).distinct()
    grams = distinct.select(name, F.posexplode(F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda k: F.substring(F.col(name), k, F.lit(2)))).alias("at", "two"))
    turn = F.row_number().over(Window.partitionBy(name, "two").orderBy("at"))
    return grams.select(name, F.concat("two", turn.cast("string")).alias("gram"))


def spellings(left: DataFrame, right: DataFrame, share: float = 0.34, least: int = 6) -> DataFrame:
    """a, b: every pair of a name of `left` (a) and one of `right` (b) that is nearly equal, for distinct names.

    Names of L letters within k edits share at least L - 1 - 2k bigrams, so the two must meet in the rarest bigrams of each: all but the last of the fewest that
    they have to share. Only pairs that do are compared, and only if their lengths allow it. Short names meet their equals.
    """
    a = left.select("a").distinct()
    b = right.select("b").distinct()
    equal = a.join(b, F.col("a") == F.col("b")).select("a", "b")
    both = a.where(F.length("a") >= least).select(F.col("a").alias("name")).union(b.where(F.length("b") >= least).select("b")).distinct()
    grams = _grams(both, "name")
    spread = grams.groupBy("gram").agg(F.count("*").alias("spread"))
    n = F.length("name")
    top = F.floor(n / (1 - share))
    # the fewest bigrams that a name has to share, over all lengths of the longer one of a pair
    fewest = F.aggregate(F.sequence(n, F.greatest(n, top)), F.lit(1 << 30), lambda acc, length: F.least(acc, length - 1 - 2 * F.floor(length * share)).cast("int"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("spread", "gram"))
    rare = grams.join(spread, "gram").withColumn("place", place).where(F.col("place") <= n - 1 - F.greatest(fewest, F.lit(1)) + 1).select("name", "gram")
    of = lambda side, c: rare.join(side.select(F.col(c).alias("name")), "name").select(F.col("name").alias(c), "gram")
    longer = F.greatest(F.length("a"), F.length("b"))
    met = of(a, "a").join(of(b, "b"), "gram").where((F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= F.floor(longer * share))).select("a", "b").distinct()
    return equal.union(met.where(nearly_equal(F.col("a"), F.col("b"), share, least)))


def cascade(spark: SparkSession, rows: DataFrame, key: str, rungs: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """key, rung, target, ambiguous for each row of `rows`: the first rung that finds anything for it.

    A rung is a name and a function from the rows that are still open to (key, target) pairs; rows that an earlier rung has settled never reach it. Where a rung finds
    several targets for a row, the row is settled as ambiguous, with no target and their number. What no rung finds has the rung `none`. What each rung finds, and
    what it leaves open, is written, so that later rungs don't compute the rows or the earlier rungs again.
    """
    out, path = None, shared_path(spark, "cascade")

    def written(df: DataFrame, at: str) -> DataFrame:
        df.write.parquet(f"{path}/{at}")
        return spark.read.schema(df.schema).parquet(f"{path}/{at}")

    open_rows = written(rows, "open")
    for k, (name, find) in enumerate(rungs):
        per_key = find(open_rows).select(key, "target").distinct().groupBy(key).agg(F.count("*").alias("n"), F.min("target").alias("target"))
        found = written(per_key, f"found_{k}")
        settled = found.select(key, F.lit(name).alias("rung"), F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n") > 1, F.col("n")).alias("ambiguous"))
        out = settled if out is None else out.union(settled)
        open_rows = open_rows.join(found.select(key), key, "left_anti")
        if k + 1 < len(rungs):
            open_rows = written(open_rows, f"open_{k}")
    rest = open_rows.select(key, F.lit("none").alias("rung"))
    return out.unionByName(rest, allowMissingColumns=True)


def rewritten(text: Column, rules: Sequence[tuple[str, str]], rounds: int = 8) -> Column:
    """struct(text, rounds, settled): `text` after all rules, in their order, round by round until nothing changes or `rounds` are over; a settled text isn't looked at again."""

    def once(state):
        new = state["text"]
        for pattern, replacement in rules:
            new = F.regexp_replace(new, pattern, replacement)
        changed = F.transform(F.array(new), lambda t: F.struct(t.alias("text"), (state["rounds"] + F.when(t == state["text"], 0).otherwise(1)).alias("rounds"), (t == state["text"]).alias("settled")))
        return F.when(state["settled"], state).otherwise(changed[0])

    start = F.struct(text.alias("text"), F.lit(0).alias("rounds"), F.lit(False).alias("settled"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds + 1)), start, lambda state, k: once(state))


def disagreements(rows: DataFrame, key: str, rule: Column, expression: str, n: int | None = None) -> DataFrame:
    """key, by_rule, by_sql where two versions of a rule, a Column and an SQL expression over the same columns, differ: on all rows, or on `n` of them in the order of a hash of the key. Nulls are values."""
    sample = rows if n is None else rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
    both = sample.select(key, rule.alias("by_rule"), F.expr(expression).alias("by_sql"))
    return both.where(~F.col("by_rule").eqNullSafe(F.col("by_sql")))
