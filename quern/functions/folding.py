"""Letters without their marks: what is left of a text's letters in several normal forms, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks of letters with marks of their own: Latin, Greek, Cyrillic and their extensions, and Latin and Greek with several marks.
BLOCKS = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0xFF00, 0xFF60))


@cache
def _letters() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters and what compatibility decomposition leaves of them without marks: those that stay one character, and those that become several."""
    single, several = {}, []
    for low, high in (*BLOCKS, (0xFB00, 0xFB07), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2474)):
        for c in map(chr, range(low, high)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if plain and plain != c:
                if len(plain) == 1:
                    single[c] = plain
                else:
                    several.append((c, plain))
    return "".join(single), "".join(single.values()), tuple(several)


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with `value` computed once, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def unmarked(text: Column) -> Column:
    """`text` after compatibility decomposition, without combining marks. Letters that do not decompose (ø, ß, æ) stay. A null stays null. A text of ASCII only is its own result."""
    source, target, several = _letters()
    rare = "[" + "".join(c for c, _ in several) + "]"
    spelt = lambda plain: reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), several, plain)
    without = lambda plain: F.regexp_replace(F.when(plain.rlike(rare), spelt(plain)).otherwise(plain), r"\p{M}", "")
    return once(text, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(once(F.translate(t, source, target), without)))


def equal_letters(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for case and accents, by collation."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def word_form(text: Column) -> Column:
    """Upper case without marks; everything but A to Z and digits as single spaces."""
    return F.trim(F.regexp_replace(F.upper(unmarked(text)), "[^A-Z0-9]+", " "))


#: What firms of several sources end in; each source drops a list of its own.
ENDINGS = {
    "exchange": ["INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LLC", "LP", "PLC", "HOLDINGS", "GROUP"],
    "trade": ["CO", "LTD", "INC", "LLC", "CORP", "LIMITED", "COMPANY"],
    "letters": ["LLC", "INC", "CORP", "CO", "LTD", "DBA"],
    "register": ["LLC", "INC", "INCORPORATED", "CO", "CORP", "LTD", "FOODS"],
}


def _without_endings(text: Column, endings: list[str], again: bool) -> Column:
    once = rf"(?:\s+(?:{'|'.join(endings)}))"
    return F.regexp_replace(text, once + ("+$" if again else "$"), "")


def firm_forms(name: Column) -> Column:
    """struct of the six normal forms that sources compare firms by; they are kept apart, as what one drops another needs.

    exchange: word form without any endings; trade: the same without one ending; letters: without spaces, keeping accents; register: before the first comma, without
    endings; plain: lower case, ampersands spelt out; tight: lower-case letters and digits only.
    """
    form = word_form(name)
    kept = F.trim(F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]+", " "))
    return F.struct(
        _without_endings(form, ENDINGS["exchange"], True).alias("exchange"),
        _without_endings(form, ENDINGS["trade"], False).alias("trade"),
        F.replace(_without_endings(kept, ENDINGS["letters"], True), F.lit(" "), F.lit("")).alias("letters"),
        _without_endings(word_form(F.split(name, ",")[0]), ENDINGS["register"], True).alias("register"),
        F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit("&"), F.lit(" and "))), r"\s+", " ")).alias("plain"),
        F.lower(F.replace(form, F.lit(" "), F.lit(""))).alias("tight"),
    )


def brand_phrases(name: Column, generic: list[str], least: int = 4) -> Column:
    """The phrases by which a text may name a brand: its word form without THE and without endings, in both lengths; no phrase that is a single generic word or shorter than `least`."""
    bare = F.regexp_replace(word_form(name), "^THE ", "")
    phrases = F.array_distinct(F.array(bare, _without_endings(bare, ENDINGS["exchange"], True)))
    return F.filter(phrases, lambda p: (F.length(p) >= least) & ~p.isin(generic))


def _padded(words: Column) -> Column:
    return F.concat(F.lit(" "), words, F.lit(" "))


def contains_words(text: Column, phrase: Column) -> Column:
    """Whether the phrase occurs as whole words, letters compared without case and marks; an empty phrase occurs nowhere."""
    return contains_any(text, F.array(phrase))


def contains_any(text: Column, phrases: Column) -> Column:
    """Whether one of the phrases occurs as whole words; the text is brought into its form once, and not at all where there is no phrase."""
    forms = F.filter(F.transform(phrases, word_form), lambda p: p != "")
    inside = lambda words, ps: F.exists(ps, lambda p: words.contains(_padded(p)))
    return F.coalesce(once(forms, lambda ps: F.when(F.size(ps) > 0, once(_padded(word_form(text)), lambda words: inside(words, ps)))), F.lit(False))


def tight(name: Column) -> Column:
    """Lower-case ASCII letters and digits only, marks dropped."""
    return F.regexp_replace(F.lower(unmarked(name)), "[^a-z0-9]+", "")


def nearly_equal(a: Column, b: Column, share: float = 0.34, least: int = 6) -> Column:
    """Equal, or both of `least` letters or more and not more than `share` of the longer one to be edited."""
    edits = F.floor(F.greatest(F.length(a), F.length(b)) * share)
    close = (F.least(F.length(a), F.length(b)) >= least) & (F.abs(F.length(a) - F.length(b)) <= edits)
    return (a == b) | (close & (F.levenshtein(a, b) <= edits))


def significant_words(name: Column, dull: list[str]) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(dull)))


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(unmarked(name)), "[^a-z0-9]+"), lambda w: w != "")


def _beginnings(words: Column) -> Column:
    return F.transform(words, lambda w, k: F.array_join(F.slice(words, 1, k + 1), ""))


def prefixes(name: Column) -> Column:
    """The first one, two, three words of a name and so on, written together."""
    return once(_words(name), _beginnings)


def spells_legal_name(candidate: Column, legal: Column, dull: list[str]) -> Column:
    """Whether a name is a spelling of a firm's legal name, of its telling words, or of the beginning of either."""
    filled = lambda array: F.filter(array, lambda x: x != "")
    forms = F.struct(
        filled(F.array_append(prefixes(candidate), tight(candidate))).alias("names"),
        filled(F.array(tight(legal), F.array_join(significant_words(legal, dull), ""))).alias("whole"),
        filled(prefixes(legal)).alias("starts"),
        tight(candidate).alias("full"),
    )

    def spelt(v):
        named = F.exists(v["names"], lambda n: F.exists(v["whole"], lambda r: nearly_equal(n, r)))
        return (v["full"] != "") & named | F.exists(v["starts"], lambda r: nearly_equal(v["full"], r))

    return F.coalesce(once(forms, spelt), F.lit(False))


def names_agree(ours: Column, theirs: Column, generic: list[str]) -> Column:
    """Whether two records name the same maker: equal forms, one written together beginning the other (5 letters), one's words beginning the other's (3 letters) or standing in it (4 letters); a single generic word proves nothing."""
    form = lambda c: once(F.filter(F.split(word_form(c), " "), lambda w: w != ""), lambda w: F.struct(w.alias("words"), F.array_join(w, "").alias("run"), _padded(F.array_join(w, " ")).alias("pad")))
    telling = lambda x, least: (F.length(x["run"]) >= least) & ~((F.size(x["words"]) == 1) & F.get(x["words"], F.lit(0)).isin(generic))

    def agree(v):
        a, b = v["a"], v["b"]
        same = (
            (a["run"] == b["run"])
            | (telling(a, 5) & telling(b, 5) & (a["run"].startswith(b["run"]) | b["run"].startswith(a["run"])))
            | (telling(a, 3) & b["pad"].startswith(a["pad"]))
            | (telling(b, 3) & a["pad"].startswith(b["pad"]))
            | (telling(a, 4) & b["pad"].contains(a["pad"]))
            | (telling(b, 4) & a["pad"].contains(b["pad"]))
        )
        return (F.size(a["words"]) > 0) & (F.size(b["words"]) > 0) & same

    return F.coalesce(once(F.struct(form(ours).alias("a"), form(theirs).alias("b")), agree), F.lit(False))
