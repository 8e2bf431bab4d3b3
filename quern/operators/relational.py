"""Reusable relational operators: each takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.dictionary import hits


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n).drop("_place")


def greatest_per_key(df: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """The row of each key with the largest `by`, by an aggregate with map-side combination."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(*keys, "_row.*")


def counts_onto(base: DataFrame, key: str, counted: dict[str, DataFrame]) -> DataFrame:
    """`base` with a count for each name of rows of that frame under the key; 0 where there are none."""
    for name, df in counted.items():
        base = base.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return base


def without_any(base: DataFrame, key: str, others: Sequence[DataFrame]) -> DataFrame:
    """Rows of `base` whose key is in none of `others`."""
    return reduce(lambda df, other: df.join(other.select(key).distinct(), key, "left_anti"), others, base)


def merge_rows(current: DataFrame, incoming: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """Keyed upsert with a rule for each column: min, max, or, and, first (the current value where there is one)."""
    both = current.withColumn("_rank", F.lit(0)).unionByName(incoming.withColumn("_rank", F.lit(1)))
    how = {
        "min": F.min,
        "max": F.max,
        "or": F.bool_or,
        "and": F.bool_and,
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))),
    }
    return both.groupBy(*keys).agg(*(how[rule](c).alias(c) for c, rule in rules.items()))


def changes(current: DataFrame, target: DataFrame, key: str, column: str) -> DataFrame:
    """What an update would do: key, old and new value where they differ, nulls compared as values."""
    new = target.select(key, F.col(column).alias("new_value"))
    joined = current.select(key, F.col(column).alias("old_value")).join(new, key)
    return joined.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def first_reason(rules: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """Name of the first rule that holds."""
    chain = reduce(lambda c, r: c.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    return chain if otherwise is None else chain.otherwise(otherwise)


def ancestors(tree: DataFrame, levels: int = 5) -> DataFrame:
    """node, ancestor, depth for up to `levels` steps up a tree (node, parent), itself at depth 0. The way up is carried along in an array, so each level is one join; a cycle is walked round until the levels are over."""
    step = tree.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    now = tree.select("node", F.array("node").alias("way"), F.col("parent").alias("up"))
    longer = F.when(F.col("up").isNotNull(), F.array_append("way", F.col("up"))).otherwise(F.col("way"))
    for _ in range(1, levels):
        now = now.select("node", longer.alias("way"), "up").join(step, F.col("up") == F.col("_n"), "left").select("node", "way", F.col("_p").alias("up"))
    return now.select("node", F.posexplode(longer).alias("depth", "ancestor")).select("node", "ancestor", "depth")


def descendants(tree: DataFrame, roots: DataFrame, levels: int = 4) -> DataFrame:
    """root, node, depth for up to `levels` steps down a tree (node, parent) from `roots` (root), each at depth 0. Only the last level found is joined again."""
    step = tree.where(F.col("parent").isNotNull()).select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    now = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    out = now
    for depth in range(1, levels + 1):
        now = now.join(step, F.col("node") == F.col("_p")).select("root", F.col("_n").alias("node"), F.lit(depth).alias("depth"))
        out = out.union(now)
    return out


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """`n` rows by the MD5 of the key: a sample that any engine reproduces."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


#: Elements up to which a set travels with each of its elements, so that pairs are compared where they meet. Pairs with a larger set fetch their sets by joins.
CARRIED = 64


def _by_element(bag: DataFrame, owner: str, element: str, seeds: int, carried: int) -> tuple[DataFrame, DataFrame]:
    """sets (o, es), and o, e, es (null if of more than `carried` elements), rare for each element of each set: `rare` are the `seeds` elements of a set that the fewest sets have."""
    known = bag.where(F.col(owner).isNotNull() & F.col(element).isNotNull()).groupBy(F.col(owner).alias("o"))
    pairs = known.agg(F.collect_set(element).alias("es")).select("o", F.explode("es").alias("e"))  # one owner's elements
    spread = pairs.groupBy("e").agg(F.count("*").alias("spread"))
    ordered = pairs.join(spread, "e").groupBy("o").agg(F.array_sort(F.collect_list(F.struct("spread", "e"))).alias("by_spread"))  # one owner's elements
    sets = ordered.select("o", F.transform("by_spread", lambda x: x["e"]).alias("es"))
    each = sets.select("o", F.when(F.size("es") <= carried, F.col("es")).alias("carried"), F.posexplode("es").alias("at", "e"))
    return sets, each.select("o", "e", F.col("carried").alias("es"), (F.col("at") < seeds).alias("rare"))


def _likeness(na: Column, nb: Column, shared: Column) -> Column:
    return shared / (na + nb - shared)


def _compared(met: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, shared, jaccard of pairs, by the intersection of their two sets."""
    side = lambda c: sets.select(F.col("o").alias(c), F.col("es").alias(f"{c}_es"))
    both = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("a_es").alias("na"), F.size("b_es").alias("nb"), F.size(F.array_intersect("a_es", "b_es")).cast("long").alias("shared"))
    return both.select("a", "b", "shared", _likeness(F.col("na"), F.col("nb"), F.col("shared")).alias("jaccard"))


def similar_sets(bag: DataFrame, owner: str, element: str, seeds: int = 3, least: float = 0.1, carried: int = CARRIED) -> DataFrame:
    """a, b (a < b), shared, jaccard of owners that share one of the `seeds` rarest elements of either.

    Owners meet by their rare elements only, and are compared where they meet, so only pairs that are alike are shuffled. A set of more than `carried` elements
    doesn't travel with each of them; its pairs are put together first and fetch their sets.
    """
    sets, each = _by_element(bag, owner, element, seeds, carried)
    side = lambda c: each.select(F.col("o").alias(c), "e", F.col("es").alias(f"{c}_es"), F.col("rare").alias(f"{c}_rare"))
    met = side("x").where("x_rare").join(side("y"), "e").where("x <> y AND (NOT y_rare OR x < y)")  # under an element that is rare for both, once
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    shared = F.size(F.array_intersect("x_es", "y_es")).cast("long")
    here = met.where("x_es IS NOT NULL AND y_es IS NOT NULL").select(*pair, F.size("x_es").alias("na"), F.size("y_es").alias("nb"), shared.alias("shared"))
    here = here.select("a", "b", "shared", _likeness(F.col("na"), F.col("nb"), F.col("shared")).alias("jaccard")).where(F.col("jaccard") >= least)
    if not _any_larger(bag, owner, carried):
        return here.distinct()
    apart = met.where("x_es IS NULL OR y_es IS NULL").select(*pair).distinct()
    return here.distinct().union(_compared(apart, sets).where(F.col("jaccard") >= least))


def _any_larger(bag: DataFrame, owner: str, n: int) -> bool:
    """Whether a set can have more than n elements, by the rows of its owner."""
    return not bag.groupBy(owner).count().where(F.col("count") > n).isEmpty()


def related_sets(bag: DataFrame, owner: str, element: str, seeds: int = 3, per_seed: int = 500, most: int = 12, carried: int = CARRIED) -> DataFrame:
    """a, b, shared, jaccard, place: for each owner a the `most` owners b most like it, of those that are among the first `per_seed` owners, by id, of one of its `seeds` rarest elements.

    The bound on owners of an element is part of what is asked for: a list of related things wants a few good ones, and an element that very many have says little.
    The owners of an element are listed together with their sets, so each a compares itself where it meets a list and leaves with the `most` best of it. Sets of more
    than `carried` elements are fetched by joins."""
    sets, each = _by_element(bag, owner, element, seeds, carried)
    listed = first_per_key(each.select("o", "e", "es"), ["e"], [F.col("o").asc()], per_seed)
    larger = _any_larger(bag, owner, carried)
    rare = each.where("rare").select(F.col("o").alias("a"), "e", F.col("es").alias("a_es"))
    lists = listed.groupBy("e").agg(F.collect_list(F.struct(F.col("o").alias("b"), F.col("es").alias("b_es"))).alias("others"))  # `per_seed` owners at most
    best = lambda found: F.slice(F.array_sort(found), 1, most)
    others = F.filter("others", lambda x: (x["b"] != F.col("a")) & x["b_es"].isNotNull())
    shared = lambda x: F.size(F.array_intersect(F.col("a_es"), x["b_es"])).cast("long")
    counted = F.transform(others, lambda x: F.struct(x["b"].alias("b"), F.size(x["b_es"]).alias("nb"), shared(x).alias("shared")))
    judged = F.transform(counted, lambda x: F.struct((-_likeness(F.size("a_es"), x["nb"], x["shared"])).alias("unlike"), (-x["shared"]).alias("unshared"), x["b"].alias("b")))
    meeting = rare.join(lists, "e")
    found = meeting.where("a_es IS NOT NULL").select("a", best(judged).alias("best"))
    top = found.groupBy("a").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, most).alias("best"))  # `seeds` short lists
    top = top.select("a", F.explode("best").alias("x")).select("a", "x.b", (-F.col("x.unshared")).alias("shared"), (-F.col("x.unlike")).alias("jaccard"))
    if larger:
        owners = meeting.select("a", F.col("a_es").isNull().alias("large"), F.explode("others").alias("x")).where("a <> x.b AND (large OR x.b_es IS NULL)")
        top = top.union(_compared(owners.select("a", "x.b").distinct(), sets))
    place = Window.partitionBy("a").orderBy(F.col("jaccard").desc(), F.col("shared").desc(), F.col("b"))
    return top.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)


def phrases_in_text(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, place, phrase: the longest phrase (words separated by spaces, upper case) at each place of `texts` (id, words). Only words that begin a phrase are looked at further; nothing compares every
    text to every phrase."""
    found = hits(texts, ["id"], phrases.select(F.col("phrase").alias("term")))
    return found.groupBy("id", "start").agg(F.max_by("term", F.col("stop")).alias("phrase")).select("id", (F.col("start") + 1).alias("place"), "phrase")
