"""Small rules about notices, ingredients and texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import decode_entities, word_form

#: Grains with gluten, and sources of malt without it.
GLUTEN_GRAINS = ["wheat", "barley", "rye", "spelt", "farro", "kamut", "khorasan", "einkorn", "emmer", "triticale", "durum", "semolina", "bulgur", "couscous", "freekeh", "seitan", "graham", "farina", "matzo", "matzah", "atta", "maida"]
OTHER_MALT = ["rice", "corn", "maize", "tapioca", "sorghum", "millet", "buckwheat"]
#: Words after which a name is the maker's or the seller's, not the brand.
AFTER_MAKER = ["BY", "FOR", "FROM", "AT"]
#: Lengths at which a source cuts texts off.
CUT_LENGTHS = [254, 255]
#: Agencies and reference prefixes of food notices.
FOOD_AGENCY, MIXED_AGENCY, FOOD_PREFIXES = "FSIS", "FDA", ["F-", "H-"]


def one_of(words: list[str]) -> str:
    return rf"\b({'|'.join(words)})\b"


def names_gluten_grain(name: Column) -> Column:
    """Whether a lower-case name is of a grain with gluten, or of malt that no other grain is named for."""
    return name.rlike(one_of(GLUTEN_GRAINS)) | (name.rlike(r"\bmalt(ed)?\b") & ~name.rlike(one_of(OTHER_MALT)))


def is_food_notice(agency: Column, reference: Column) -> Column:
    mixed = F.upper(F.coalesce(reference, F.lit(""))).rlike(f"^({'|'.join(FOOD_PREFIXES)})")
    return F.coalesce((agency == FOOD_AGENCY) | ((agency == MIXED_AGENCY) & mixed), F.lit(False))


def mentions_brand(text: Column, phrase: Column) -> Column:
    """Whether the phrase occurs as whole words at a place where the word before doesn't make it the maker or the seller."""
    before = "".join(f"(?<! {w})" for w in AFTER_MAKER)
    padded = F.concat(F.lit(" "), word_form(text), F.lit(" "))
    return F.regexp_like(padded, F.concat(F.lit(before + " "), word_form(phrase), F.lit(" ")))


def may_assert_absence(status: Column) -> Column:
    """Only of a list that is known to be whole; an unknown status says nothing."""
    return F.coalesce(status == "disclosed", F.lit(False))


def has_any_list(status: Column) -> Column:
    return F.coalesce(status.isin("disclosed", "partial"), F.lit(False))


def looks_cut(text: Column) -> Column:
    return F.coalesce(F.length(text).isin(CUT_LENGTHS), F.lit(False))


def ends_in_a_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("[A-Za-z]$"), F.lit(False))


def english_text(english: Column, main: Column, lang: Column) -> Column:
    """struct(kind, text, lang): the English list, the main one if that is English, or only its language."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit("")))
    said = F.lower(F.coalesce(lang, F.lit("")))
    in_english = (filled(main) != "") & (said == "en")
    kind = F.when((filled(english) != "") | in_english, "english").when(filled(main) != "", "not_english").otherwise("none")
    return F.struct(
        kind.alias("kind"),
        F.when(filled(english) != "", filled(english)).when(in_english, filled(main)).alias("text"),
        F.when(kind == "not_english", F.when(said != "", said).otherwise("unknown")).alias("lang"),
    )


def named_parts(json: Column) -> Column:
    """array of (name, percent) out of JSON text; elements without a name, or of another kind, are dropped."""
    each = F.transform(F.from_json(json, "array<string>"), lambda e: F.from_json(e, "name string, percent double"))
    named = F.filter(each, lambda e: F.trim(F.coalesce(e["name"], F.lit(""))) != "")
    return F.coalesce(named, F.array().cast("array<struct<name:string,percent:double>>"))


def any_missing(*columns: str) -> Column:
    """Whether one of a group of columns has no value; the group is chosen at run time."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return missing


def without(stored: Column, removed: Column) -> Column:
    """The elements of `stored` but for `removed`, or all of them if none would be left."""
    left = F.filter(stored, lambda x: ~F.array_contains(removed, x))
    return F.when(F.size(left) > 0, left).otherwise(stored)


#: Signs of tags that no reader sees, and the forms of tags.
INVISIBLE = r"[\u00AD\u200B-\u200F\u202A-\u202E\u2060\uFEFF]"
REPEATED_PREFIX = r"^([a-z]{2}:)(?:\1)+"
WELL_FORMED_TAG = r"^[a-z]{2}:[\p{L}\p{M}0-9-]+$"
ADDITIVE_TAG = r"^[a-z]{2}:(e\d{3,4}[a-z]{0,4})$"


def canonical_tag(tag: Column) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(tag, INVISIBLE, "")))
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", "-"), REPEATED_PREFIX, "$1")


def tags_of(raw: Column) -> Column:
    """The well-formed tags in a text: several if language prefixes divide it into well-formed ones, else the text itself if it is one."""
    parts = F.transform(F.split(F.regexp_replace(F.lower(raw), REPEATED_PREFIX, "$1"), r"[\s,;-]+(?=[a-z]{2}:)"), canonical_tag)
    divided = F.forall(parts, lambda t: t.rlike(WELL_FORMED_TAG))
    return F.array_distinct(F.filter(F.when(divided, parts).otherwise(F.array(canonical_tag(raw))), lambda t: t.rlike(WELL_FORMED_TAG)))


def additive_numbers(tags: Column) -> Column:
    return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, ADDITIVE_TAG, 1)), lambda n: n != "")


def letters_of(text: Column) -> Column:
    """Letters and digits of any script in lower case, after entities are decoded; an empty text for null."""
    return F.lower(F.regexp_replace(decode_entities(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", ""))


def split_fault(pieces: Column, name: Column, title: Column, maker: Column, sure: Column) -> Column:
    """Why a proposal to divide `name` into `pieces` is refused, or null. All pieces together must have the letters of the name, none lost and none added;
    the title among them must have letters, and others than the maker's; a single piece divides nothing; and the proposer must be sure."""
    given = F.filter(pieces, lambda p: p.isNotNull())
    seen = F.struct(letters_of(F.array_join(given, "")).alias("together"), letters_of(name).alias("whole"), letters_of(title).alias("title"), letters_of(maker).alias("maker"), F.size(given).alias("n"))

    def judge(x):
        bad = {"unsure": ~sure, "untitled": F.trim(F.coalesce(title, F.lit(""))) == "", "differs": x["together"] != x["whole"], "says_maker": x["title"] == x["maker"], "wordless": x["title"] == "", "undivided": x["n"] < 2}
        return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in bad.items())))

    return F.get(F.transform(F.array(seen), judge)[0], F.lit(0))
