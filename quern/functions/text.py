"""Text normalisers as Column expressions. Letters are ASCII unless a function says otherwise."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms and country tags that owners add to a firm's name.
LEGAL_FORMS = ["LLC", "LLP", "LP", "INC", "INCORPORATED", "CO", "CORP", "CORPORATION", "LTD", "LIMITED", "COMPANY", "PBC", "PLC", "GMBH", "AG", "SA", "SAS", "SPA", "SRL", "BV", "NV", "USA", "US"]
#: Words that say nothing in a search.
NOISE = ["and", "the", "of", "with", "for", "de", "la", "oz"]


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_form(text: Column) -> Column:
    """Upper case, everything but letters and digits as single spaces."""
    return F.upper(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def brand_key(name: Column) -> Column:
    """A key under which spellings of a firm's name meet: no notes in parentheses, leading THE, legal forms after the first word, or anything but letters and
    digits of any script. A key of at most three characters keeps signs such as the ampersand, which initials need."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(name), r"\([^)]*\)", " "), "[.,'\u2019\u2018`\u00b4]", "")
    bare = F.regexp_replace(bare, r"^\s*THE\s+", "")
    bare = F.regexp_replace(bare, rf"(?<=\S)\s+({'|'.join(LEGAL_FORMS)})\b", "")
    key = F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")
    return F.when(F.length(key) <= 3, F.regexp_replace(F.upper(name), r"[\s.\-/\\'`\u2011\u2022\u2019\u2018\u00b4\u2122\u00ae\u00a9]", "")).otherwise(key)


def tokens(query: Column, least: int = 2, most: int = 6, noise: list[str] | None = None) -> Column:
    """Distinct lower-case words of a query, of letters and digits of any script, in order and without short ones, at most `most`. Noise goes unless all is noise."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))
    said = F.filter(words, lambda w: ~w.isin(*(noise or NOISE)))
    return F.slice(F.when(F.size(said) > 0, said).otherwise(words), 1, most)


#: States, districts and territories, by their postal codes.
STATES = (
    "AL Alabama,AK Alaska,AZ Arizona,AR Arkansas,CA California,CO Colorado,CT Connecticut,DE Delaware,DC District of Columbia,FL Florida,GA Georgia,HI Hawaii,ID Idaho,IL Illinois,IN Indiana,IA Iowa,KS Kansas,KY Kentucky,"
    "LA Louisiana,ME Maine,MD Maryland,MA Massachusetts,MI Michigan,MN Minnesota,MS Mississippi,MO Missouri,MT Montana,NE Nebraska,NV Nevada,NH New Hampshire,NJ New Jersey,NM New Mexico,NY New York,NC North Carolina,"
    "ND North Dakota,OH Ohio,OK Oklahoma,OR Oregon,PA Pennsylvania,PR Puerto Rico,RI Rhode Island,SC South Carolina,SD South Dakota,TN Tennessee,TX Texas,UT Utah,VT Vermont,VA Virginia,WA Washington,WV West Virginia,WI Wisconsin,WY Wyoming"
).split(",")
#: Short forms of states that are not their codes.
SHORT_STATES = ["Calif", "Mass", "Penn", "Penna", "Tex", "Fla", "Ill", "Wash", "Minn", "Mich", "Wis", "Ariz", "Colo", "Conn", "Okla", "Tenn", "N.Y", "N.J"]


def strip_location(firm: Column) -> Column:
    """A firm's name without `of City, State`, the state by its code, its name or a short form; what is no state stays."""
    states = [s.split(" ", 1)[0] for s in STATES] + [s.split(" ", 1)[1].replace(" ", r"\s+") for s in STATES] + [s.replace(".", r"\.\s?") for s in SHORT_STATES]
    return F.regexp_replace(firm, rf"(?i),?\s+of\s+[^,]+,\s*(?:{'|'.join(sorted(states, key=len, reverse=True))})\.?\s*$", "")


def firm_keys(firm: Column) -> Column:
    """Keys of the names in a firm's text: on either side of d/b/a, a/k/a or t/a, with and without the place."""
    parts = F.split(firm, r"(?i)\s+(?:d/?b/?a|a/?k/?a|t/?a)\.?\s+")
    keys = F.flatten(F.transform(parts, lambda p: F.array(brand_key(F.trim(p)), brand_key(F.trim(strip_location(p))))))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 2))


def singular(word: Column) -> Column:
    return (
        F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def decode_entities(text: Column) -> Column:
    """`text` with its character references decoded, decimal, hexadecimal and named (all of HTML's), once. Unknown names, control characters and what is no character stay as they are."""
    names = F.from_json(F.lit(json.dumps({name[:-1]: sign for name, sign in html5.items() if name.endswith(";")})), "map<string,string>")  # one literal
    number = lambda c: F.when(F.lower(F.substring(c, 2, 1)) == "x", F.conv(F.substring(c, 3, 10), 16, 10)).otherwise(F.conv(F.substring(c, 2, 10), 10, 10)).cast("int")
    shown = lambda n: n.isin(9, 10) | ((n >= 32) & ~n.between(127, 159) & ~n.between(0xD800, 0xDFFF) & (n <= 0x10FFFF))
    sign = lambda c: F.when(~c.startswith("#"), F.try_element_at(names, c)).when(shown(number(c)), F.decode(F.unhex(F.lpad(F.hex(number(c)), 8, "0")), "UTF-32"))
    codes = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))
    decoded = F.zip_with(F.split(text, ENTITY), F.transform(codes, lambda c: F.coalesce(sign(c), F.concat(F.lit("&"), c, F.lit(";")))), lambda plain, s: F.concat(F.coalesce(plain, F.lit("")), F.coalesce(s, F.lit(""))))
    return F.when(text.rlike(ENTITY), F.array_join(decoded, "")).otherwise(text)


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, tags become spaces, entities are decoded, a no-break space is a space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    bare = F.replace(decode_entities(bare), F.lit("\u00a0"), F.lit(" "))
    return F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole words only."""
    return F.concat(F.lit(" "), word_form(text), F.lit(" ")).contains(F.concat(F.lit(" "), word_form(phrase), F.lit(" ")))


def title_parts(title: Column) -> Column:
    """title: what stands before the first comma; secondary: the rest, if any."""
    at = F.locate(",", title)
    return F.struct(
        F.trim(F.when(at > 0, F.substring(title, F.lit(1), at - 1)).otherwise(title)).alias("title"),
        F.when(at > 0, F.trim(F.substring(title, at + 1, F.length(title)))).alias("secondary"),
    )


def round_half_up(value: Column, places: int = 2) -> Column:
    scale = 10**places
    return F.floor(value * scale + 0.5) / scale
