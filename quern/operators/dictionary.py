"""Matching texts against dictionaries and rule tables of any size, by equality joins on runs of words.

A word of a text is joined to the first words of terms, only then runs of the lengths that such terms have are formed and joined to whole terms. Nothing compares every
text to every term, and no term list is compiled into a plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRONG, FLAVOUR, WEAK, NEUTRAL = range(4)
#: What divides a name into parts, and a part into what it is and what comes with it.
DIVIDERS = r"[,;:|()\[\]{}/+]|\s[-–—]|[-–—]\s"
LINKS = ["with", "in", "on", "for", "from"]
#: Rows of a dictionary up to which it is sent to every executor, so that words of texts needn't be shuffled.
FEW = 100_000
#: A term before one of these names a taste, not the thing.
TASTES = ["flavor", "flavored", "flavour", "flavoured", "inspired"]


def stem(word: Column) -> Column:
    """A singular that is the same for a word in a name and in a term; it needs not be right."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(n <= 3, word)
        .when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(oes|ches|shes|sses|xes)$"), cut(2))
        .when(word.rlike("(ss|us|is)$"), word)
        .when(word.endswith("s"), cut(1))
        .otherwise(word)
    )


def stems(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), stem)


def segments(names: DataFrame, key: str, text: str) -> DataFrame:
    """key, part, sub, words: the parts of each name, divided at linking words; `sub` numbers what comes behind those from 1. Null and empty names have none."""
    parts = names.select(key, F.posexplode(F.split(F.col(text), DIVIDERS)).alias("part", "said"))
    run = F.concat(F.lit(" "), F.array_join(stems(F.col("said")), "  "), F.lit(" "))  # two spaces, so that neighbours share none
    subs = parts.select(key, "part", F.posexplode(F.split(run, rf" (?:{'|'.join(LINKS)}) ")).alias("sub", "said"))
    return subs.select(key, "part", "sub", F.filter(F.split("said", " "), lambda w: w != "").alias("words")).where(F.size("words") > 0)


def few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def _runs(found: DataFrame, keys: Sequence[str], terms: DataFrame, outer: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The runs of words (keys, start, stop, term, after) that begin like a term and are as long as one that does; the distinct terms; and their number.

    If `outer`, a word at which no term begins has a row without a term, and the first row of all words of a segment (`_all`).
    """
    distinct = terms.select("term").distinct().withColumn("n", F.size(F.split("term", " ")))
    longest, n_terms = distinct.agg(F.max("n"), F.count("*")).first()
    firsts = distinct.groupBy(F.split("term", " ")[0].alias("first")).agg(F.collect_set("n").alias("lengths"))  # at most one of each length
    every = [F.when(F.col("start") == 0, F.col("words")).alias("_all")] if outer else []
    words = found.select(*keys, "words", F.posexplode("words").alias("start", "first")).select(*keys, "start", "first", F.slice("words", F.col("start") + 1, (longest or 1) + 1).alias("ahead"), *every)
    kept = [*keys, "start", "ahead", *(["_all"] if outer else [])]
    begun = words.join(few(firsts, n_terms), "first", "left" if outer else "inner").select(*kept, (F.explode_outer if outer else F.explode)("lengths").alias("n"))
    grams = begun if outer else begun.where(F.col("n") <= F.size("ahead"))
    term = F.when(F.col("n") <= F.size("ahead"), F.array_join(F.slice("ahead", 1, F.col("n")), " "))
    return grams.select(*keys, "start", (F.col("start") + F.col("n")).alias("stop"), term.alias("term"), F.get("ahead", F.col("n")).alias("after"), *(["_all"] if outer else [])), distinct, n_terms


def hits(found: DataFrame, keys: Sequence[str], terms: DataFrame) -> DataFrame:
    """keys, start, stop (behind the last word), term, after (the word behind it) for every occurrence of a term (`term`: words with single spaces) in `words`."""
    spelt, distinct, n_terms = _runs(found, keys, terms)
    return spelt.join(few(distinct.select("term"), n_terms), "term").select(*keys, "start", "stop", "term", "after")


def longest_only(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Occurrences that no longer one contains: leftmost first, and the longest of those that begin together."""
    before = Window.partitionBy(*keys).orderBy("start", F.col("stop").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_upto", F.max("stop").over(before)).where(F.coalesce(F.col("_upto") < F.col("stop"), F.lit(True))).drop("_upto")


def residual(found: DataFrame, keys: Sequence[str], matched: DataFrame) -> DataFrame:
    """`found` (keys, words) with `rest`: the words of each segment that no occurrence covers."""
    covered = matched.groupBy(*keys).agg(F.flatten(F.collect_set(F.sequence("start", F.col("stop") - 1))).alias("_at"))  # within one segment
    joined = found.join(covered, list(keys), "left")
    kept = F.filter(F.transform("words", lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: ~F.coalesce(F.array_contains("_at", x["k"]), F.lit(False)))
    return joined.withColumn("rest", F.transform(kept, lambda x: x["w"])).drop("_at")


def uncovered(found: DataFrame, keys: Sequence[str], terms: DataFrame) -> DataFrame:
    """`residual` of all occurrences of `terms`, in one pass: the words of a segment are looked up and put together again where they are. `keys` must tell segments apart."""
    spelt, distinct, n_terms = _runs(found, keys, terms, outer=True)
    known = spelt.join(few(distinct.select("term", F.lit(True).alias("_known")), n_terms), "term", "left")
    covers = F.when(F.col("_known"), F.sequence("start", F.col("stop") - 1))
    met = known.groupBy(*keys).agg(F.max("_all").alias("words"), F.flatten(F.collect_set(covers)).alias("_at"))  # within one segment
    kept = F.filter(F.transform("words", lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: ~F.array_contains("_at", x["k"]))
    rest = F.when(F.size("_at") == 0, F.col("words")).otherwise(F.transform(kept, lambda x: x["w"]))
    return met.select(*keys, "words", rest.alias("rest"))


@dataclass
class Override:
    """Changes one of `categories` to `to` (None: unsure) where the text has `pattern` and not `unless`."""

    categories: tuple[str, ...]
    pattern: str
    to: str | None
    unless: str | None = None


def categorise(names: DataFrame, key: str, text: str, terms: DataFrame, overrides: Sequence[Override] = ()) -> DataFrame:
    """key, category, term, tier for each name in which a term of `terms` (term, category, tier) says what it is.

    Strong terms beat flavours, those beat weak ones; within a tier the first part that has one decides, by its last term, the longest if several end there.
    What comes behind a linking word counts only if its part says nothing before it. Neutral terms, and terms that name a taste, only cover shorter ones. A term
    that is defined twice keeps its strongest definition.
    """
    known = terms.groupBy("term").agg(F.min_by(F.struct("category", "tier"), F.struct("tier", "category")).alias("t")).select("term", "t.*")
    keys = [key, "part", "sub"]
    found = longest_only(hits(segments(names, key, text), keys, known), keys).join(known, "term")
    tier = F.when(F.col("after").isin(TASTES) | F.col("category").isNull(), NEUTRAL).otherwise(F.col("tier"))
    judged = found.withColumn("tier", tier).where(F.col("tier") < NEUTRAL)
    heads = F.max(F.when(F.col("sub") == 0, 1).otherwise(0)).over(Window.partitionBy(key, "part"))
    eligible = judged.withColumn("_heads", heads).where((F.col("sub") == 0) | (F.col("_heads") == 0))
    best = F.struct("tier", "part", "sub", -F.col("stop"), F.col("start"))
    chosen = eligible.groupBy(key).agg(F.min_by(F.struct("category", "term", "tier"), best).alias("c")).select(key, "c.*")
    if not overrides:
        return chosen
    plain = F.array_join(stems(F.col(text)), " ")
    said = chosen.join(names.select(key, plain.alias("_plain")), key)
    category = F.col("category")
    for o in overrides:
        holds = category.isin(*o.categories) & F.col("_plain").rlike(o.pattern)
        if o.unless:
            holds &= ~F.col("_plain").rlike(o.unless)
        category = F.when(F.coalesce(holds, F.lit(False)), F.lit(o.to)).otherwise(category)
    return said.withColumn("category", category).drop("_plain").where("category IS NOT NULL")


def first_rules(found: DataFrame, keys: Sequence[str], rules: DataFrame) -> DataFrame:
    """keys, rule, result: the first rule (`rule` ascending) of `rules` (rule, term, excludes, result) whose term occurs in `words` and of whose excluded terms none does.

    A rule with a null result stops the search: the keys come out with it. An excluded term may be any run of words.
    """
    wanted = rules.select("term", "rule", F.struct("result").alias("_r"))
    barred = rules.select(F.explode("excludes").alias("term"), "rule", F.lit(None).cast(wanted.schema["_r"].dataType).alias("_r"))
    roles = wanted.union(barred)
    met = hits(found, keys, roles).select(*keys, "term").join(few(roles, roles.count()), "term")  # roles go to the words: the words of one key stay together
    each = met.groupBy(*keys, "rule").agg(F.max("_r").alias("_r"), F.bool_or(F.col("_r").isNull()).alias("_barred")).where(~F.col("_barred"))
    return each.groupBy(*keys).agg(F.min("rule").alias("rule"), F.min_by("_r", "rule").alias("r")).select(*keys, "rule", "r.result")


def classes(found: DataFrame, keys: Sequence[str], rules: DataFrame) -> DataFrame:
    """keys, classes (sorted): every class that `rules` (class, term, kind) find in `words`.

    A `word` rule says that the class is there, unless its occurrence lies within one of a `harmless` rule of that class; a `veto` anywhere in the words takes the class away.
    """
    roles = rules.select("class", "term", "kind").distinct()
    seen = hits(found, keys, rules).join(few(roles, roles.count()), "term")
    order = Window.partitionBy(*keys, "class").orderBy("start", F.col("stop").desc(), F.when(F.col("kind") == "harmless", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(F.col("kind") == "harmless", F.col("stop"))).over(order) >= F.col("stop"), F.lit(False))
    per_class = seen.withColumn("_real", (F.col("kind") == "word") & ~covered).groupBy(*keys, "class").agg(F.bool_or("_real").alias("real"), F.bool_or(F.col("kind") == "veto").alias("vetoed"))
    return per_class.where("real AND NOT vetoed").groupBy(*keys).agg(F.array_sort(F.collect_set("class")).alias("classes"))


def compounds(rows: DataFrame, key: str, name: str, known: DataFrame, heads: Sequence[str]) -> DataFrame:
    """key, part, item: the things that a name joined by and, or, and/or is said to be.

    Alternatives (or, and/or) always divide; both divide at `and` only if both halves, the first with the head word of the second if it lacks one, are `known` (name). An earlier half
    takes the last word of the last if that is one of `heads` and it has none itself. A name without such words is one thing; a null or empty one is none.
    """
    words = F.col(name)
    either = r"\s*,?\s+(?:and\s*/\s*or|or)\s+"
    divided = F.when(words.rlike(either), F.split(words, either)).otherwise(F.split(words, r"\s+(?:and|&)\s+"))
    last = lambda c: F.try_element_at(F.split(c, " "), F.lit(-1))
    tail = F.try_element_at(F.col("_each"), F.lit(-1))
    lends = (F.size(F.split(tail, " ")) > 1) & last(tail).isin(*heads)
    whole = lambda c, k: F.when((k < F.size("_each") - 1) & lends & ~last(c).isin(*heads), F.concat_ws(" ", c, last(tail))).otherwise(c)
    cut = rows.where(words != "").select(F.col(key), words.alias("_name"), words.rlike(either).alias("_either"), F.filter(divided, lambda p: F.trim(p) != "").alias("_each"))
    parts = cut.select(key, "_name", "_either", F.size("_each").alias("_n"), F.posexplode(F.transform("_each", whole)).alias("part", "item"))
    met = parts.join(known.select(F.col("name").alias("_known")).distinct(), F.col("item") == F.col("_known"), "left")
    judged = met.groupBy(key, "_name", "_either", "_n").agg(F.array_sort(F.collect_list(F.struct("part", "item"))).alias("_items"), F.count("_known").alias("_found"))
    kept = F.when(F.col("_either") | ((F.col("_n") == 2) & (F.col("_found") == 2)), F.col("_items")).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("_name").alias("item"))))
    return judged.select(key, F.explode(kept).alias("_i")).select(key, "_i.part", "_i.item")


def nouns(names: DataFrame, name: str, maker: str, makers: int = 50, plain_share: float = 0.7) -> DataFrame:
    """noun: the last words of names that at least `makers` makers use and that end, in at least `plain_share` of their uses, names without a comma."""
    ends = names.select(F.try_element_at(stems(F.col(name)), F.lit(-1)).alias("noun"), F.col(maker).alias("_maker"), (~F.col(name).contains(",")).cast("int").alias("_plain")).where("noun IS NOT NULL")
    return ends.groupBy("noun").agg(F.count_distinct("_maker").alias("_makers"), F.avg("_plain").alias("_share")).where((F.col("_makers") >= makers) & (F.col("_share") >= plain_share)).select("noun")


def oriented(names: DataFrame, key: str, name: str, lexicon: DataFrame) -> DataFrame:
    """key, title, secondary: names of two halves at a comma, the half that ends in a noun of `lexicon` first; as they stand if both or neither do. Other names have no secondary."""
    halves = F.filter(F.transform(F.split(F.col(name), ","), lambda p: F.trim(p)), lambda p: p != "")
    cut = names.select(key, F.trim(F.col(name)).alias("_name"), halves.alias("_h"))
    ends = cut.select(key, "_name", "_h", F.try_element_at(stems(F.get("_h", F.lit(0))), F.lit(-1)).alias("_a"), F.try_element_at(stems(F.get("_h", F.lit(1))), F.lit(-1)).alias("_b"))
    one, two = lexicon.select(F.col("noun").alias("_na")), lexicon.select(F.col("noun").alias("_nb"))
    met = ends.join(one, F.col("_a") == F.col("_na"), "left").join(two, F.col("_b") == F.col("_nb"), "left")
    pair, swap = F.size("_h") == 2, F.col("_nb").isNotNull() & F.col("_na").isNull()
    title = F.when(~pair, F.col("_name")).when(swap, F.get("_h", F.lit(1))).otherwise(F.get("_h", F.lit(0)))
    return met.select(key, title.alias("title"), F.when(pair, F.when(swap, F.get("_h", F.lit(0))).otherwise(F.get("_h", F.lit(1)))).alias("secondary"))


def families(rows: DataFrame, key: str, code: str, table: DataFrame) -> DataFrame:
    """key, names, unknown: for each key the distinct names that its codes have in `table` (code, name, place), in the order of `place`, and how many of its codes it doesn't have. A code that is listed twice keeps its first place."""
    first = table.groupBy(F.col("code").alias("_code")).agg(F.min(F.struct("place", "name")).alias("_f"))
    met = rows.join(first, F.col(code) == F.col("_code"), "left").groupBy(key)
    listed = F.array_sort(F.collect_set("_f"))  # as many as the table has names
    return met.agg(F.array_distinct(F.transform(listed, lambda f: f["name"])).alias("names"), F.count_if(F.col(code).isNotNull() & F.col("_code").isNull()).alias("unknown"))


def codes_of(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The codes of all rules (code, pattern) that a text of several labels meets, in the order of the rules, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(c)) for c, p in rules))))
