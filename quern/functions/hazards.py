"""What a notice says was wrong: hazards by class, and the plain sentence for each, as tables that expressions are made from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.folding import once

#: Terms of hazards that lie in how a food was made or handled. A term with a leading or trailing blank ends where words do; another may stand inside a word.
PROCESS = {
    "bacteria": ["listeria", "salmonella", "e coli", "ecoli", "o157", "stec", "clostridium", "botulinum", "botulism", "cronobacter", "staphylococc", "bacillus", "pathogen", "microbial"],
    "virus or parasite": ["norovirus", "hepatitis", "cyclospora"],
    "spoilage": ["mold", "yeast"],
    "dirt": ["contaminat", "insanitary", "unsanitary", "sanitation", "rodent", "insect", "pest", "filth"],
    "bad practice": [" gmp ", " cgmp ", "good manufacturing", "under process", "underprocess", "processing deviation", "temperature abuse", "not properly cooked", "not properly pasteurized", "pasteuri"],
    "no inspection": ["without benefit of inspection", "without benefit of federal inspection", "without the benefit of inspection", "without the benefit of federal inspection"],
    "foreign body": ["foreign material", "foreign matter", "foreign object", " metal ", " glass ", "hard plastic", "pieces of plastic", " rubber "],
}
#: Hazards of the label or of the goods themselves.
OTHER = {
    "allergen": ["undeclared", "undisclosed", "not declared", "allergen", "does not declare", "fails to declare"],
    "heavy metal": [" lead ", "cadmium", "arsenic", "mercury", "heavy metal"],
    "cold chain": ["temperature", "not kept cold", "not held cold", "refrigerat", "cold chain", "thaw"],
}
#: Sentences for readers, the first class that applies; {} takes the first of the words that the notice names.
SENTENCES = [
    ("bacteria", "May carry germs that make people ill.", ["listeria", "salmonella", "botulism"], "May carry germs that make people ill: {}."),
    ("virus or parasite", "May carry a virus or a parasite.", ["norovirus", "hepatitis", "cyclospora"], "May carry a virus or a parasite: {}."),
    ("allergen", "Holds something that people may be allergic to, and the label is silent about it.", ["milk", "egg", "peanut", "almond", "soy", "wheat", "fish", "sesame"], "The label is silent about {}, to which people may be allergic."),
    ("foreign body", "There may be hard pieces in it.", ["metal", "glass", "plastic", "rubber"], "There may be pieces of {} in it."),
    ("heavy metal", "Holds too much of a harmful metal.", ["lead", "cadmium", "arsenic", "mercury"], "Holds too much {}."),
    ("cold chain", "Was not kept cold.", [], ""),
    ("spoilage", "May be spoilt.", ["mold", "yeast"], "May be spoilt by {}."),
    ("dirt", "Was made where it was not clean.", [], ""),
    ("bad practice", "Was not made as the rules ask.", [], ""),
    ("no inspection", "Was sold without being inspected.", [], ""),
]


def said(reason: Column) -> Column:
    """Lower-case words of a reason with a blank before, between and behind them."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(reason, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))


def _names(words: Column, terms: list[str]) -> Column:
    plain = [t for t in terms if t.strip() == t]
    whole = [t.strip() for t in terms if t.strip() != t]
    held = [words.contains(t) for t in (*plain, *(f" {t} " for t in whole))]
    return reduce(lambda a, b: a | b, held)


def hazard_classes(reason: Column) -> Column:
    """The classes of hazards that a reason names, in the order of the tables; none for a null."""
    return once(said(reason), _classes)


def _classes(words: Column) -> Column:
    return F.array_compact(F.array(*(F.when(_names(words, terms), F.lit(name)) for name, terms in (PROCESS | OTHER).items())))


def is_process_fault(reason: Column) -> Column:
    """Whether the way of making was at fault: a hazard of that kind is named."""
    return F.arrays_overlap(hazard_classes(reason), F.array(*map(F.lit, PROCESS)))


def plain_reason(reason: Column) -> Column:
    """struct(kind, sentence): the first class of SENTENCES that the reason falls in, in words for readers; null if it falls in none."""
    none = F.lit(None).cast("struct<kind:string,sentence:string>")

    def judge(x):
        out = none
        for kind, plain, named, filled in reversed(SENTENCES):
            sentence = F.lit(plain)
            if named:
                word = F.regexp_extract(x["words"], rf" ({'|'.join(named)})(?:e?s)? ", 1)
                sentence = F.when(word == "", F.lit(plain)).otherwise(F.concat(F.lit(filled.split("{}")[0]), word, F.lit(filled.split("{}")[-1])))
            out = F.when(F.array_contains(x["classes"], kind), F.struct(F.lit(kind).alias("kind"), sentence.alias("sentence"))).otherwise(out)
        return out

    return once(once(said(reason), lambda words: F.struct(words.alias("words"), _classes(words).alias("classes"))), judge)
