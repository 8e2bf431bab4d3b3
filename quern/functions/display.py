"""Names as readers see them: cleaned, in title case, shortened, divided; and small texts beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.folding import once
from quern.functions.rules import INVISIBLE
from quern.functions.text import decode_entities

#: Words that stay small inside a title, and the lengths at which names are shortened.
SMALL_WORDS = ["a", "an", "the", "and", "as", "but", "for", "if", "nor", "or", "so", "yet", "at", "by", "in", "of", "off", "on", "per", "to", "up", "via", "vs"]
LONG, LONGEST, EARLIEST, LEAST_REST = 44, 56, 12, 10
#: Claims that a name may begin with; a hyphen may stand for a blank.
CLAIMS = ["grass fed", "pasture raised", "free range", "cage free", "regenerative", "certified", "usda", "organic", "non gmo", "gluten free", "dairy free", "sugar free", "all natural", "natural", "raw", "keto", "paleo", "vegan", "kosher", "halal", "premium", "artisan", "artisanal", "small batch", "cold pressed", "unsweetened", "no sugar added", "fair trade", "heritage", "ultra filtered", "grade a"]
CLAIM = rf"(?i)^(?:[0-9]+(?:\.[0-9]+)?\s*%|{'|'.join(c.replace(' ', '[ -]?') for c in sorted(CLAIMS, key=len, reverse=True))})(?:[\s,/&-]+|$)"
EDGE = r"[\s,;:.\-–—&/]+"
LIST_BEGINS = r"^(.*?)(?:[,;(–—]|\s-\s)"


def display_name(raw: Column) -> Column:
    """Entities decoded, invisible signs and signs at the edges gone, single spaces; the name as it was if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(decode_entities(raw), INVISIBLE, ""), r"^[\s,;:.\-–—&/]+|[\s,;:\-–—&/]+$", "")
    clean = F.trim(F.regexp_replace(clean, r"\s+", " "))
    return F.when(clean != "", clean).otherwise(F.trim(raw))


def title_case(name: Column) -> Column:
    """Words of one case get a capital; small words don't, unless first or last; capitals of up to three letters stay in a name that isn't all capitals; words with other signs than letters stay."""
    shouting = ~name.rlike("[a-z]")
    words = F.split(name, " ")

    def cased(w, forced):
        low, high = F.lower(w), F.upper(w)
        keep = ((w != low) & (w != high)) | ((w == high) & (w != low) & (F.length(w) <= 3) & ~shouting)
        return F.when(keep, w).when(~forced & low.isin(SMALL_WORDS), low).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(low, F.lit(2), F.length(w))))

    def one(token, k):
        core, tail = F.regexp_extract(token, r"^(.*?)([,.;:]*)$", 1), F.regexp_extract(token, r"^(.*?)([,.;:]*)$", 2)
        forced = (k == 0) | (k == F.size(words) - 1)
        parts = F.transform(F.split(core, "-"), lambda p, j: cased(p, forced & (j == 0)))
        return F.when(core.rlike("^[A-Za-z]+(-[A-Za-z]+)*$"), F.concat(F.array_join(parts, "-"), tail)).otherwise(token)

    return F.array_join(F.transform(words, one), " ")


def without_claims(name: Column) -> Column:
    """The name behind the claims it begins with, as long as enough of it is left; eight claims at most."""

    def step(text, _):
        rest = F.trim(F.regexp_replace(text, CLAIM, ""))
        return F.when(text.rlike(CLAIM) & (F.length(rest) >= LEAST_REST) & rest.rlike("[A-Za-z]"), rest).otherwise(text)

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), name, step)


def short_name(name: Column) -> Column:
    """A name that fits: as it is if short, else without claims, else up to where a list of details begins, else up to a space before the ceiling. Never cut early."""

    def fitted(text):
        clip = F.substring(text, 1, LONGEST)
        at = F.regexp_extract(clip, "^(.*) ", 1)
        head = F.regexp_replace(F.when(F.length(at) > EARLIEST, at).otherwise(clip), EDGE + "$", "")
        return F.when((F.length(text) <= LONGEST) | (F.length(head) < EARLIEST), text).otherwise(head)

    raw = F.trim(name)
    full = without_claims(raw)
    head = F.trim(F.regexp_replace(F.regexp_extract(full, LIST_BEGINS, 1), EDGE + "$", ""))
    listed = full.rlike(LIST_BEGINS) & (F.length(F.regexp_extract(full, LIST_BEGINS, 1)) >= EARLIEST) & (F.length(head) >= EARLIEST)
    return F.when(F.length(raw) <= LONG, raw).when(F.length(full) <= LONG, full).when(listed, fitted(head)).otherwise(fitted(full))


def title_parts(name: Column) -> Column:
    """struct(title, secondary, branch): a name with one comma divides there, unless what is before it is one word of a list or either side says nothing; a name with several commas doesn't divide."""
    parts = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: p != "")
    head, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    letters = lambda c: F.length(F.regexp_replace(c, "(?i)[^a-z0-9]", ""))
    said = lambda title, second, branch: F.struct(title.alias("title"), second.cast("string").alias("secondary"), F.lit(branch).alias("branch"))
    none, whole = F.lit(None), F.trim(name)
    return (
        F.when(F.size(parts) < 2, said(whole, none, "no_comma"))
        .when(F.size(parts) > 2, said(whole, none, "several"))
        .when(~head.contains(" ") & tail.rlike(r"(?i)\s(?:&|and)\s"), said(whole, none, "list"))
        .when(letters(head) < 3, said(whole, none, "no_comma"))
        .when(letters(tail) < 3, said(head, none, "no_comma"))
        .otherwise(said(head, tail, "split"))
    )


def lead_key(name: Column, generic: list[str]) -> Column:
    """What a name leads with, written together: its first word of more than two letters and the short ones before it, up to a generic word; null if that is under three letters."""
    words = F.filter(F.transform(F.split(F.lower(name), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")

    def step(acc, w):
        over = acc["done"] | w.isin(generic) | ((acc["key"] != "") & (F.length(w) > 2))
        return F.struct(F.when(over, acc["key"]).otherwise(F.concat(acc["key"], w)).alias("key"), (over | (F.length(w) > 2)).alias("done"))

    key = F.aggregate(words, F.struct(F.lit("").alias("key"), F.lit(False).alias("done")), step)["key"]
    return F.when(F.length(key) >= 3, key)


def notice_names(name: Column, notice: Column, generic: list[str]) -> Column:
    """Whether a notice's text has what a name leads with: null if the name leads with nothing, true if the notice says nothing."""
    key = lead_key(name, generic)
    return F.when(key.isNull(), F.lit(None).cast("boolean")).when(F.coalesce(notice, F.lit("")) == "", True).otherwise(F.regexp_replace(F.lower(notice), "[^a-z0-9]", "").contains(key))


def tidy_serving(label: Column) -> Column:
    """A serving's label with the first number of six or more decimals rounded to one, half up."""
    number = F.regexp_extract(label, r"[0-9]+\.[0-9]{6,}", 0)
    tenths = F.floor(number.try_cast("double") * 10 + 0.5).cast("long")
    plain = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""))
    return F.when(number == "", label).otherwise(F.replace(label, number, plain))


def serving_grams(label: Column) -> Column:
    """The grams or millilitres that a label states; null for none."""
    grams = F.regexp_extract(label, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:g|ml)\b", 1).try_cast("double")
    return F.when(grams > 0, grams)


def storable(text: Column) -> Column:
    """Without the sign that databases refuse; other control signs stay."""
    return F.replace(text, F.lit("\x00"), F.lit(""))


def lacks_latin(name: Column) -> Column:
    return ~name.rlike("[a-zA-Z]")


#: Phrases of packages, and words that stand alone where a list was torn.
PACKAGE = ["calorie diet", "daily value", "percent daily", "best by", "lot code", "date code", "proof of purchase", "stamped date", "see side panel", "distributed by", "manufactured for", "questions or comments", "www.", "http"]
TORN = ["and", "or", "and/or", "contains", "may contain", "ingredients", "other", "etc", "less than", "none", "unknown", "each", "serving", "the", "to", "of", "with", "for", "from", "in", "on", "by", "at", "is", "are", "not", "made", "added"]
QUANTITY = r"(?i)^(?:(?:less than|no more than|under)\s+[0-9./]+\s*(?:%|percent)\s*(?:of\s+)?|[0-9./]+\s*(?:%|percent)\s+or\s+less\s*(?:of\s+)?)"
JUNK = r"^[\s+/\\|*~_,.;:&-]+|[\s+/\\|*~_,.;:&-]+$"


def cleaned_item(raw: Column) -> Column:
    """struct(action, name, why): whether an item of a list is kept, renamed or dropped, and why."""
    said = lambda action, to, why: F.struct(F.lit(action).alias("action"), to.alias("name"), F.lit(why).cast("string").alias("why"))
    none = F.lit(None).cast("string")

    def forms(name):
        bare = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), JUNK, "")
        return F.struct(name.alias("name"), F.lower(name).alias("low"), bare.alias("bare"))

    def shortened(v):
        """Without a quantity before it; only a share can be one."""
        less = F.regexp_replace(F.regexp_replace(v["bare"], QUANTITY, ""), JUNK, "")
        some = F.when(v["low"].contains("%") | v["low"].contains("percent"), less).otherwise(v["bare"])
        return F.struct(v["name"].alias("name"), v["low"].alias("low"), v["bare"].alias("bare"), some.alias("less"))

    def spelt(v):
        shorter = (v["less"] != v["bare"]) & v["less"].rlike("[a-zA-Z]{3}")
        out = F.trim(F.regexp_replace(F.when(shorter, v["less"]).otherwise(v["bare"]), r"\s{2,}", " "))
        return F.struct(v["name"].alias("name"), v["low"].alias("low"), shorter.alias("shorter"), out.alias("out"))

    def judged(v):
        name, low, out = v["name"], v["low"], v["out"]
        return (
            F.when(low.isin(TORN), said("drop", none, "a torn piece of a list"))
            .when(reduce(Column.__or__, (low.contains(p) for p in PACKAGE)), said("drop", none, "words of a package"))
            .when(name.rlike(r"^[0-9][0-9\s./%-]*$"), said("drop", none, "digits"))
            .when(out == name, said("keep", name, None))
            .when((F.length(out) < 2) | ~out.rlike("[a-zA-Z]"), said("drop", none, "nothing left"))
            .when(name.contains("_"), said("rename", out, "marked up"))
            .when(v["shorter"], said("rename", out, "a quantity before it"))
            .otherwise(said("rename", out, "signs around it"))
        )

    return once(once(once(once(F.trim(raw), forms), shortened), spelt), judged)


#: How a notice came to be shown beside a product, in words; {} takes the firm that issued it.
NOTES = {
    "barcode": "The notice of {} has this product's own barcode.",
    "owner_brand": "{}, which owns the brand, issued the notice.",
    "named_brand": "{} issued the notice and doesn't own the brand.",
    "other": "{} issued the notice.",
}
ROLES = {"supply_chain": " {} works for other firms.", "retailer": " {} sells at retail."}


def evidence_note(method: Column, role: Column, issuer: Column, matched: Column) -> Column:
    """What a notice beside a product proves, by how the two were matched and what the issuer is; null without a match. Matched text that is more than digits is quoted."""
    fill = lambda template: F.concat(*(x for k, part in enumerate(template.split("{}")) for x in ([issuer] if k else []) + [F.lit(part)]))
    base = F.when(method.isNull(), F.lit(None).cast("string"))
    for name in ("barcode", "owner_brand", "named_brand"):
        base = base.when(method == name, fill(NOTES[name]))
    middle = F.when(method.isin("barcode", "named_brand") & (role == "supply_chain"), fill(ROLES["supply_chain"])).when(method.isin("barcode", "named_brand") & (role == "retailer"), fill(ROLES["retailer"])).otherwise("")
    quoted = F.when((method != "barcode") & matched.rlike("[A-Za-z]{2}"), F.concat(F.lit(" It says: "), F.trim(matched), F.lit("."))).otherwise("")
    return F.concat(base.otherwise(fill(NOTES["other"])), middle, quoted)
