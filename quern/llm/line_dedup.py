"""Operator 4: line dedup by a segment-partition edit join, with DataFrame functions only.

Of equal lines the first stays. Among those left, a line that is within `THRESHOLD` edits of an earlier one goes too. Two lines
within t edits agree on one of t + 1 segments of the shorter one, at a place that the edits can have moved only a little; so
each line is entered under its segments and looked up under the few substrings of the right length at the right
places. A segment that very many lines share is refined by the letter counts of its lines, then by segments of what is left of them. Pairs that share a key and whose lengths and parities of
letters and of neighbouring letters allow it are verified by a banded bit-parallel edit distance: the band's vertical differences are bits of a number that is advanced one character at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.ngram_join import row_key
from quern.llm.storage import Workspace, small

THRESHOLD = 2
#: Shorter lines go only if equal: a few edits would make different lines of them.
LEAST_CHARS = 24
#: Entries up to which decisions on lines are sent to all executors rather than joined by a shuffle.
BROADCAST_LINES = 1_000_000
#: Pairs that may meet under one key for each line that it has; a key with more is divided, which makes about as many rows of each line. Lines up to which texts to verify are sent to all executors.
FEW_PAIRS, VERIFY_TEXTS = 20, 50_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bound(value: Column, fn) -> Column:
    """fn(value) with `value` computed once, where fn uses it inside other functions' lambdas."""
    return F.transform(F.array(value), fn)[0]


def parities(line: Column) -> Column:
    """Whether the characters of each class (code point modulo 32) are odd in number, as bits. An edit changes at most two bits."""
    one = F.lit(1).cast("long")  # 64 bits, so that no class is the sign
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", one, F.ascii(c).bitwiseAND(31))))


#: Classes of neighbouring characters, as bits of a number that has room for the last character above them.
PAIR_CLASSES = 56


def pair_parities(line: Column) -> Column:
    """Whether the neighbouring characters of each class are odd in number, as bits. An edit takes two pairs at most and brings two at most, so it changes four bits at most."""
    one, bits = F.lit(1).cast("long"), F.lit((1 << PAIR_CLASSES) - 1)

    def step(state, c):
        code = F.ascii(c).bitwiseAND(127).cast("long")
        which = ((F.call_function("shiftright", state, F.lit(PAIR_CLASSES)) * 31 + code) % PAIR_CLASSES).cast("int")
        return state.bitwiseAND(bits).bitwiseXOR(F.call_function("shiftleft", one, which)).bitwiseOR(F.call_function("shiftleft", code, F.lit(PAIR_CLASSES)))

    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), step).bitwiseAND(bits)


def may_be_near(a: str, b: str, t: int) -> Column:
    """Whether lengths and parities, the columns with the prefixes a and b, leave room for t edits or fewer. It never denies a pair that is so near."""
    differ = lambda c: F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}")))
    return (F.abs(F.col(f"{a}_size") - F.col(f"{b}_size")) <= t) & (differ("parity") <= 2 * t) & (differ("beside") <= 4 * t)


def agreeing(a: Column, b: Column, most: Column) -> Column:
    """Characters, `most` at most, that a and b have in common at their beginnings; by halving, so that texts are compared as wholes."""
    powers = F.transform(F.sequence(F.lit(20), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    powers = F.concat(F.array_repeat(F.lit(1 << 20), F.floor(most / (1 << 20)).cast("int")), powers)

    def longer(n, p):
        return F.when((n + p <= most) & (F.substring(a, n + 1, p) == F.substring(b, n + 1, p)), n + p).otherwise(n)

    return F.aggregate(powers, F.lit(0), longer)


def between(a: Column, b: Column, t: int) -> Column:
    """struct(a, b): what is left without the beginnings and ends that two texts have in common, t characters or more. It has the same edit distance."""

    def ends(v):
        rest = lambda c: F.substring(v[c], v["n"] + 1, F.length(v[c]))
        return F.struct(rest("a").alias("a"), rest("b").alias("b"))

    def begins(v):
        most = F.least(F.length(v["a"]), F.length(v["b"])) - t
        return F.struct(v["a"], v["b"], agreeing(v["a"], v["b"], most).alias("n"))

    def turned(v):
        return F.struct(F.reverse(v["a"]).alias("a"), F.reverse(v["b"]).alias("b"))

    found = bound(bound(F.struct(a.alias("a"), b.alias("b")), begins), ends)
    return bound(bound(bound(found, turned), begins), ends)


def edit_distance(a: Column, b: Column, t: int) -> Column:
    """Edit distance of two strings of at least t characters whose lengths differ by at most t; exact up to t, above t otherwise."""
    width = 2 * t + 1
    mask = (1 << width) - 1

    def distance(v):
        m = v["m"]

        def equal_bits(j):
            """Bit k: character j - t + k of a equals character j of b (from 1)."""
            bits = F.lit(0)
            for k in range(width):
                same = F.coalesce(F.get(v["a"], j - t + k - 1) == F.get(v["b"], j - 1), F.lit(False))
                bits = bits.bitwiseOR(F.when((j - t + k >= 1) & same, 1 << k).otherwise(0))
            return F.struct(j.alias("j"), bits.alias("x"))

        def step(state, column):
            vp, vn, d, j, x = state["vp"], state["vn"], state["d"], column["j"], column["x"]
            zero = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask)

            def advance(d0):
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(mask))
                hn = d0.bitwiseAND(vp)
                right = F.shiftright(d0, 1)
                last = F.greatest(m - j + t, F.lit(0))  # the bit of a's last character
                down = F.when(F.shiftright(d0, 2 * t).bitwiseAND(1) == 1, 0).otherwise(1)
                bit = lambda v: F.call_function("shiftright", v, last).bitwiseAND(1)
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(right.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                    right.bitwiseAND(hp).alias("vn"),
                    (d + F.when(j + t <= m, down).otherwise(bit(hp) - bit(hn))).alias("d"),
                )

            return bound(zero, advance)

        start = F.struct(F.lit(mask & ~((1 << t) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(t).alias("d"))
        return F.aggregate(F.transform(F.sequence(F.lit(1), v["n"]), equal_bits), start, step)["d"]

    return bound(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.length(a).alias("m"), F.length(b).alias("n")), distance)


def places(t: int) -> list[tuple[int, int, int]]:
    """(shorter, i, move): where segment i of a text of `shorter` fewer characters can stand, moved by up to what t edits allow."""
    return [(shorter, i, move) for shorter in range(t + 1) for i in range(t + 1) for move in range(max(-i, shorter - (t - i)), min(i, shorter + (t - i)) + 1)]


def under_keys(rows: DataFrame, t: int, keep: list[str]) -> DataFrame:
    """The columns `keep` of `rows` once for each key of a row, with key, role, m and the cut (start, size) that the key's segment makes.

    `rows` has path (what is known to agree so far), role, m and rest. A row of role 0 is entered under the segments of its rest, of m characters; it
    also looks for moved segments, in role 1, as rows do that have t or fewer characters more than m. Without m, a text is taken
    in both roles and for all lengths. `earlier` has the keys of a row that come before this one, in role 1 that of the beginning.
    """
    tried = F.array(*(F.struct(F.lit(a).alias("shorter"), F.lit(b).alias("i"), F.lit(c).alias("move")) for a, b, c in places(t)))
    put = rows.withColumn("n", F.length("rest"))
    if "m" in rows.columns:
        tried = F.filter(tried, lambda p: p["shorter"] == F.col("n") - F.col("m"))
    put = put.withColumn("place", F.explode(tried))
    m, i, move = F.col("n") - F.col("place.shorter"), F.col("place.i"), F.col("place.move")
    begin, end = F.floor(m * i / (t + 1)).cast("int"), F.floor(m * (i + 1) / (t + 1)).cast("int")
    put = put.select(*keep, "path", "rest", "n", F.when((F.col("role") == 0) & (F.col("place.shorter") == 0) & (move == 0), 0).otherwise(1).alias("role"), m.alias("whole"), i.alias("i"), (begin + move).alias("start"), (end - begin).alias("size"))
    put = put.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    key = F.xxhash64("path", "whole", "i", F.substring("rest", F.col("start") + 1, F.col("size")))
    bounds = [F.floor(F.col("whole") * k / (t + 1)).cast("int") for k in range(t + 1)]
    before = F.array(*(F.xxhash64("path", "whole", F.lit(k), F.substring("rest", bounds[k] + 1, bounds[k + 1] - bounds[k])) for k in range(t)))
    earlier = F.slice(before, F.lit(1), F.when(F.col("role") == 0, F.col("i")).otherwise(F.least("i", F.lit(1))))  # a common beginning can always be taken out
    return put.select(*keep, "rest", "role", (F.col("whole") - F.col("size")).alias("m"), "start", "size", key.alias("key"), earlier.alias("earlier"))


def segment_keys(line: Column, t: int) -> Column:
    """The keys that `under_keys` gives a whole text, as an array in the order of `places`; null where a segment would stand outside."""

    def key(shorter, i, move):
        whole = F.length(line) - F.lit(shorter)
        begin, end = F.floor(whole * i / (t + 1)).cast("int"), F.floor(whole * (i + 1) / (t + 1)).cast("int")
        inside = (begin + move >= 0) & (end + move <= F.length(line))
        return F.when(inside, F.xxhash64(F.lit(0).cast("long"), whole, F.lit(i), F.substring(line, begin + move + 1, end - begin)))

    return F.array(*(key(*place) for place in places(t)))


def without_cut() -> Column:
    """The rest of a text without the segment that its key names."""
    return F.concat(F.substring("rest", F.lit(1), F.col("start")), F.substring("rest", F.col("start") + F.col("size") + 1, F.length("rest")))


def letter_groups(line: Column, n: int) -> Column:
    """A number for each of n groups of characters (by code point modulo n): how often each character of the group occurs. An edit changes at most two of them."""

    def group(chars, g):
        return F.xxhash64(F.array_join(F.array_sort(F.filter(chars, lambda c: F.ascii(c) % n == g)), ""))

    return bound(F.split(line, ""), lambda chars: F.array(*(group(chars, g) for g in range(n))))


def under_counts(rows: DataFrame, groups: DataFrame, n_texts: int, t: int) -> DataFrame:
    """`rows` (key, id, met, ...), once for each of 2t + 1 groups of characters; t edits leave the counts of one of them as they are.

    The new key is the old one with those counts; `met` is extended by the keys of the groups before, so a pair meets under the first that agrees.
    """
    here = rows.join(small(groups, n_texts), F.col("id") == F.col("group_id")).drop("group_id")
    each = F.transform("counts", lambda c, g: F.xxhash64("key", g, c))
    others = [c for c in rows.columns if c not in ("key", "met")]
    split = here.select(*others, "met", each.alias("keys")).select(*others, "met", "keys", F.posexplode("keys").alias("g", "key"))
    return split.select(*others, "key", F.concat("met", F.slice("keys", F.lit(1), F.col("g"))).alias("met"))


def live_keys(keys: DataFrame) -> DataFrame:
    """Keys under which pairs can meet, with the number of those pairs for each line of the key."""
    counted = keys.groupBy("key").agg(F.sum(F.when(F.col("role") == 0, F.lit(1 << 32)).otherwise(F.lit(1).cast("long"))).alias("both"))
    e, found = F.shiftright("both", 32), F.col("both").bitwiseAND((1 << 32) - 1)
    return counted.where((e >= 2) | ((e >= 1) & (found >= 1))).select(F.col("key").alias("live"), ((e * (e - 1) / 2 + e * found) / (e + found)).alias("pairs"))


SIGNS = ["size", "parity", "beside"]


def pairs_under(members: DataFrame, texts: DataFrame, n_texts: int, t: int) -> DataFrame:
    """a < b: texts that meet under one of the keys of `members`, of which each has few, and under none before that, and whose lengths and parities are near enough."""
    signs = small(texts.select(F.col("id").alias("sign_id"), *(F.col(c).alias(f"x_{c}") for c in SIGNS)), n_texts)
    known = members.select("key", "role", "id", "met").join(signs, F.col("id") == F.col("sign_id"))
    entered = known.where("role = 0").select("key", F.col("id").alias("x"), F.col("met").alias("x_met"), *(f"x_{c}" for c in SIGNS))
    others = known.select(F.col("key").alias("other_key"), F.col("role").alias("other_role"), F.col("id").alias("y"), F.col("met").alias("y_met"), *(F.col(f"x_{c}").alias(f"y_{c}") for c in SIGNS))
    new = ~F.arrays_overlap("x_met", "y_met")
    met = entered.join(others, (F.col("key") == F.col("other_key")) & (F.col("x") != F.col("y")) & ((F.col("other_role") == 1) | (F.col("x") < F.col("y"))) & may_be_near("x", "y", t) & new)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def within(pairs: DataFrame, texts: DataFrame, n_pairs: int, n_texts: int, t: int) -> DataFrame:
    """at, id: the later text of each pair of at most t edits."""
    side = lambda c: small(texts.select(F.col("id").alias(f"{c}_id"), F.col("at").alias(f"{c}_at"), F.col("line").alias(f"{c}_line"), *(F.col(s).alias(f"{c}_{s}") for s in SIGNS)), n_texts, VERIFY_TEXTS)
    dealt = pairs.repartition(max(1, min(20_000, n_pairs // 100)))  # few pairs, long work; behind the joins it would come too late, as conditions are moved into them
    both = dealt.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    both = both.where(may_be_near("a", "b", t))
    apart = bound(between(F.col("a_line"), F.col("b_line"), t), lambda v: edit_distance(v["a"], v["b"], t))
    close = both.where(apart <= t)
    first = F.col("a_at") < F.col("b_at")
    return close.select(F.when(first, F.col("b_at")).otherwise(F.col("a_at")).alias("at"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("id")).distinct()


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def known_lines(work: Workspace, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`members` (id, rest, at, ...) with ids that tell all lines apart, and the lines by id with their earliest place, their length and their parities.

    An id is a hash of 64 bits. A second hash shows where different lines have the same one; among very many lines a few do, and get new ids out of both.
    """
    texts = members.groupBy("id").agg(F.min("at").alias("at"), F.any_value("rest").alias("line"), (F.min(F.hash("rest")) != F.max(F.hash("rest"))).alias("mixed"))
    texts = work.table(texts.withColumns({"size": F.length("line"), "parity": parities(F.col("line")), "beside": pair_parities(F.col("line"))}), "texts")
    mixed = texts.where("mixed").select(F.col("id").alias("mixed_id"))
    n_mixed = mixed.count()
    if not n_mixed:
        return members, texts
    told = members.join(small(mixed, n_mixed), F.col("id") == F.col("mixed_id"), "left")
    told = told.withColumn("id", F.when(F.col("mixed_id").isNotNull(), F.xxhash64("id", F.hash("rest"), F.reverse("rest"))).otherwise(F.col("id"))).drop("mixed_id")
    return known_lines(work, work.table(told, "members"))


def lines_under_live_keys(work: Workspace, lines: DataFrame, gone: DataFrame, t: int) -> tuple[DataFrame, DataFrame, int]:
    """The `lines` (at, line), but for those at a gone_at of `gone`, that can meet others, with id, and the live keys with their number.

    Rows of every line are many and its texts long, so until it is known which lines can meet any, only ids and hashes of segments are shuffled.
    """
    told = lines.withColumn("id", line_hash(F.col("line")))
    hashed = work.table(told.select("at", "id", segment_keys(F.col("line"), t).alias("keys")).join(gone, F.col("at") == F.col("gone_at"), "left_anti").select("id", "keys"), "hashed")
    entered = [k for k, (shorter, _, move) in enumerate(places(t)) if not shorter and not move]
    entries = hashed.select("id", F.posexplode("keys").alias("place", "key")).where(F.col("key").isNotNull())
    live = work.table(live_keys(entries.select("key", F.when(F.col("place").isin(entered), 0).otherwise(1).alias("role"))), "live")
    n_live = live.count()
    ids = work.table(entries.select("id", "key").join(small(live, n_live, BROADCAST_LINES), F.col("key") == F.col("live"), "left_semi").select(F.col("id").alias("live_id")).distinct(), "ids")
    work.drop(hashed)
    meeting = told.join(small(ids, ids.count(), BROADCAST_LINES), F.col("id") == F.col("live_id"), "left_semi")
    return meeting.join(gone, F.col("at") == F.col("gone_at"), "left_anti"), live, n_live


def near_lines(work: Workspace, lines: DataFrame, gone: DataFrame, t: int) -> DataFrame:
    """at, id of the `lines` (at, line; all different but for those at a gone_at of `gone`, which don't count) within t edits of an earlier one.

    Lines meet under the keys of their segments. A key that many share is divided, first by how often letters occur in its lines, of which t edits leave some groups alone. If many still
    share a key, what agrees is taken out, the t edits lie in the rest, and the rest is cut into segments again, and so on until few lines share a key. Before that, each line of such a key is compared with the earliest one; keys whose lines have all found an earlier partner are done.
    """
    lines, live, n_live = lines_under_live_keys(work, lines, gone, t)
    whole = lines.select("at", "id", F.col("line").alias("rest"), F.lit(0).cast("long").alias("path"), F.lit(0).alias("role"))
    found = under_keys(whole, t, ["at", "id"]).join(small(live, n_live, BROADCAST_LINES), F.col("key") == F.col("live"))
    members = work.table(found.select("at", "id", "key", "role", "m", "pairs", "rest", "start", "size", _met(None, t).alias("met")), "members")
    members, texts = known_lines(work, members)
    n_texts = texts.count()
    pairs, gone, counted = [pairs_under(members.where(F.col("pairs") <= FEW_PAIRS), texts, n_texts, t)], [], False
    while n_hot := (hot := members.where(F.col("pairs") > FEW_PAIRS)).count():
        hot = hot.select("key", "role", "m", "at", "id", "met", without_cut().alias("rest"))
        me = F.struct("at", "id")
        firsts = hot.groupBy(F.col("key").alias("first_key")).agg(F.min(me).alias("any"), F.min(F.when(F.col("role") == 0, me)).alias("entered"))
        led = hot.join(small(firsts, n_hot), F.col("key") == F.col("first_key"))
        led = led.select("key", "id", F.col("any.id").alias("lead"), F.when(F.col("role") == 0, F.col("any.id")).otherwise(F.col("entered.id")).alias("first")).where("id <> lead")
        star = led.where("id <> first").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()
        gone.append(work.table(within(star, texts, n_hot, n_texts, t), "gone"))
        settled = small(reduce(DataFrame.union, gone).select(F.col("id").alias("settled")).distinct(), n_texts)
        unsettled = work.table(led.join(settled, F.col("id") == F.col("settled"), "left_anti").select(F.col("key").alias("open_key")).distinct(), "open")
        left = hot.join(small(unsettled, n_hot), F.col("key") == F.col("open_key")).drop("open_key")
        if not counted:
            ids = left.select(F.col("id").alias("hot_id")).distinct()
            groups = texts.join(ids, F.col("id") == F.col("hot_id")).select(F.col("id").alias("group_id"), letter_groups(F.col("line"), 2 * t + 1).alias("counts"))
            finer = work.table(under_counts(left, work.table(groups, "groups"), n_texts, t), "counted")
            live = work.table(live_keys(finer), "live")
            members = work.table(finer.join(small(live, (2 * t + 1) * n_hot), F.col("key") == F.col("live")).drop("live").withColumn("start", F.lit(0)).withColumn("size", F.lit(0)), "members")
            pairs.append(pairs_under(members.where(F.col("pairs") <= FEW_PAIRS), texts, n_texts, t))
            counted = True
            continue
        pairs.append(pairs_under(left.where(F.col("m") <= t), texts, n_texts, t))  # nothing is left to cut
        once = under_keys(left.where(F.col("m") > t).withColumnRenamed("key", "path"), t, ["at", "id", "met"])
        once = once.select("at", "id", F.col("key").alias("path"), "role", "m", without_cut().alias("rest"), _met("met", t).alias("met"))
        twice = under_keys(once, t, ["at", "id", "met"])  # two cuts before keys are counted again
        live = work.table(live_keys(twice), "live")
        found = twice.join(small(live, 9 * n_hot), F.col("key") == F.col("live"))
        members = work.table(found.select("at", "id", "key", "role", "m", "pairs", "rest", "start", "size", _met("met", t).alias("met")), "members")
        pairs.append(pairs_under(members.where(F.col("pairs") <= FEW_PAIRS), texts, n_texts, t))
    every = work.table(reduce(DataFrame.union, pairs).distinct(), "pairs")
    return reduce(DataFrame.union, [*gone, within(every, texts, every.count(), n_texts, t)])


def _met(before: str | None, t: int) -> Column:
    """Keys before this one under which two rows would have met already. For more than three edits, equal segments at
    equal places needn't be parts of a best alignment, so there pairs may be met more than once."""
    none = F.array().cast("array<bigint>")
    now = F.coalesce("earlier", none) if t <= 3 else none
    return F.concat(before, now) if before else now


def _removal(lines: DataFrame, name: str) -> DataFrame:
    return lines.groupBy("doc_key").agg(F.array_sort(F.collect_set("pos")).alias(name))  # lines of one document


def _runs(n: Column, gone: Column) -> Column:
    """The runs of places 0 to n - 1 between those of `gone`, which is sorted, as (from, size)."""
    return F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(n)), lambda low, high: F.struct((low + 1).alias("from"), (high - low - 1).alias("size")))


def kept_lines(text: Column, gone: Column) -> Column:
    """Lines of a text but for those at the places `gone`; in time that grows with the text."""
    return bound(lines_of(text), lambda v: F.flatten(F.transform(_runs(F.size(v), gone), lambda r: F.slice(v, r["from"] + 1, r["size"]))))


def dedup_lines(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) in a column `row`, with cleaned (the text without removed lines), n_lines, n_exact and n_near (lines removed as copies, and as near copies).

    The order of lines is that of doc_id, then of place in the text; rows without a doc_id come last. Lines are what line feeds separate. Blank lines stay. A null text stays
    null and has no lines; an empty text has one, blank. Rows equal in id and text are one document and are cleaned alike. Rows that repeat an id with another
    text are told apart by their text. Lines of fewer than `least_chars` characters go only if equal to an earlier one. Very long texts, and texts of very many
    lines, take time in proportion. Other columns stay in `row` under any name. An empty table gives none.
    """
    work = Workspace(spark, "lines")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.struct(row_key(F.col("doc_id"), F.col("text")).alias("id"), F.xxhash64("text").alias("th")).alias("doc_key"))
    text = F.col("row.text")
    told = keyed.select("doc_key", F.posexplode(lines_of(text)).alias("pos", "line")).where(F.trim("line") != "")
    hashes = told.select("doc_key", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))
    occurrences = work.table(hashes, "occurrences")
    place = F.struct("doc_key", "pos")
    repeated = occurrences.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    copies = occurrences.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).where(place != F.col("first")).select("doc_key", "pos")
    copies = work.table(copies.distinct(), "copies")
    n_exact = copies.count()
    work.drop(occurrences)
    gone = small(copies.select(place.alias("gone_at")), n_exact, BROADCAST_LINES)
    lines = told.where(F.length("line") >= max(least_chars, threshold + 1)).select(place.alias("at"), "line")
    near = near_lines(work, lines, gone, threshold).select("at.doc_key", "at.pos")
    near = work.table(near, "near")
    side = lambda lines, n, name: small(_removal(lines, name).withColumnRenamed("doc_key", f"{name}_key"), n, BROADCAST_LINES)
    out = keyed.join(side(copies, n_exact, "exact"), F.col("doc_key") == F.col("exact_key"), "left").join(side(near, near.count(), "near"), F.col("doc_key") == F.col("near_key"), "left")
    none = F.array().cast("array<int>")
    gone = F.array_sort(F.concat(F.coalesce("exact", none), F.coalesce("near", none)))
    cleaned = F.when(F.col("exact").isNotNull() | F.col("near").isNotNull(), F.array_join(kept_lines(text, gone), "\n")).otherwise(text)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return out.select("row", cleaned.alias("cleaned"), F.coalesce(_line_count(text), F.lit(0)).alias("n_lines"), size("exact").alias("n_exact"), size("near").alias("n_near"))


def _line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def apply_line_dedup(docs: DataFrame, deduped: DataFrame) -> DataFrame:
    """The columns of `docs` with cleaned text; documents of which nothing but blank lines is left go, unless there was nothing else before."""
    left = (F.col("n_exact") + F.col("n_near") == 0) | (F.trim(F.replace("cleaned", F.lit("\n"), F.lit(""))) != "")
    columns = [(F.col("cleaned") if c == "text" else F.length("cleaned").cast("long") if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns]
    return deduped.where(F.coalesce(left, F.lit(True))).select(*columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = dedup_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return deduped.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_exact", "n_near", F.md5("cleaned").alias("cleaned_md5"))


OP4_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM l WHERE trim(line, ' ') <> ''),
f AS (SELECT doc_id, pos, line, length(line) AS n FROM o WHERE k = 1 AND length(line) >= 24),
near AS (
  SELECT DISTINCT b.doc_id, b.pos FROM f a JOIN f b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
  WHERE (substr(a.line, 1, a.n // 3) = substr(b.line, 1, a.n // 3) OR substr(a.line, a.n - a.n // 3 + 1) = substr(b.line, b.n - a.n // 3 + 1)
    OR contains(b.line, substr(a.line, a.n // 3 + 1, a.n - 2 * (a.n // 3) - 2))) AND levenshtein(a.line, b.line) <= 2),
gone AS (SELECT doc_id, pos, 1 AS e, 0 AS r FROM o WHERE k > 1 UNION ALL SELECT doc_id, pos, 0, 1 FROM near),
left_over AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS cleaned FROM l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.pos = l.pos) GROUP BY l.doc_id),
n AS (SELECT doc_id, sum(e)::INT AS e, sum(r)::INT AS r FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::INT AS n_lines, coalesce(n.e, 0) AS n_exact, coalesce(n.r, 0) AS n_near, md5(CASE WHEN text IS NULL THEN NULL ELSE coalesce(cleaned, '') END) AS cleaned_md5
FROM d LEFT JOIN left_over USING (doc_id) LEFT JOIN n USING (doc_id)
"""
