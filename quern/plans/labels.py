"""Queries over label texts: nested lists, statements beside them, names in them. The texts are made from `documents` by turning some of their signs into brackets and
some of their words into the phrases of labels, so that brackets nest and many stay unbalanced."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import nested
from quern.plans.catalogue import load, query

#: What turns a document into a label: pattern, replacement.
REWRITES = [
    (r"([aeiou]), ", r"\1 ("),
    (r"([n-z])\. ", r"\1), "),
    (r" by ", " contains 2% or less of: "),
    (r" de ", " (trace of "),
    (r"\n", ". Contains: milk, "),
    (r" von ", "* and "),
    (r" que ", ") and "),
]


def labels(spark, sf_dir):
    text = F.col("text")
    for pattern, replacement in REWRITES:
        plain = pattern.replace("\\n", "\n")
        fixed = not set(plain) & set(r"\.[](){}|*+?^$")
        text = F.replace(text, F.lit(plain), F.lit(replacement)) if fixed else F.regexp_replace(text, pattern, replacement.replace("\\1", "$1"))
    return load(spark, sf_dir, "documents").select("doc_id", text.alias("label"))


def _sql_text(expression: str, rules) -> str:
    for pattern, replacement in rules:
        expression = f"regexp_replace({expression}, '{pattern}', '{replacement}', 'g')"
    return expression


LABEL_SQL = _sql_text("text", [(p.replace("\\n", "\n"), r) for p, r in REWRITES])


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def in_words(phrases: list[str]) -> str:
    return "|".join(p.replace(" ", r"\s+") for p in phrases)


PREPARED_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(label, '‘’ʼ“”–—™®©', '''''''\"\"--'), '\\s+-\\s+', ', ', 'g'), "
    + quoted(rf"(?i)^\s*(?:{in_words(['ingredient list', *nested.INTRODUCTIONS[:4]])})\b\s*:?\s*")
    + r", ''), '(?i)(\*\s*organic)(contains)', '\1. \2', 'g'), '(?i)\*\s*organic\b\s*\.?', ' ', 'g'))"
)

_ALLERGEN = rf"(?:{'|'.join(nested.ALLERGENS)})e?s?\b"
_LEAD = r"(?i)^\(?(?:\s*allerg(?:en|y)\s+(?:information|advice|statement|warning)\s*:?\s*|this\s+(?:product|item)\s+(?:is|was|may\s+be)\s+|product\s+(?:is|was)\s+)?"
_FIRST = rf"\s*:?\s*(?:(?:traces?(?:\s+amounts?)?\s+of|one\s+or\s+more\s+of\s+the\s+following|any\s+of\s+the\s+following|the\s+following|also)\s*:?\s*)*[^,;:.]{{0,30}}?\b{_ALLERGEN}"


@query(f"""
WITH l AS (SELECT doc_id, {PREPARED_SQL} AS p FROM (SELECT doc_id, coalesce({LABEL_SQL}, '') AS label FROM documents)),
s AS (SELECT doc_id, p, list_filter(list_transform(string_split(regexp_replace(p, '\\.\\s+', '.' || chr(2), 'g'), chr(2)), lambda x: trim(x)), lambda x: x <> '') AS s FROM l),
k AS (SELECT doc_id, p, s, list_transform(s, lambda x: CASE WHEN regexp_matches(x, {quoted(_LEAD + r"(?:produced|manufactured|made|packaged|packed|processed|prepared|bottled)\s+(?:on|in|using|with)\s[^.]{0,40}?(?:equipment|machinery|facilit(?:y|ies)|premises)\b")})
  OR regexp_matches(x, {quoted(_LEAD + r"may\s+(?:also\s+)?contain" + _FIRST)}) THEN 2 WHEN regexp_matches(x, {quoted(_LEAD + "contains" + _FIRST)}) AND NOT regexp_matches(x, {quoted(nested.SECTION)})
  THEN CASE WHEN regexp_matches(x, '(?i)(?:one\\s+or\\s+more|any)\\s+of\\s+the\\s+following') THEN 2 ELSE 1 END ELSE 0 END) AS k FROM s),
j AS (SELECT doc_id, p, array_to_string(list_filter(s, lambda x, i: k[i] = 0), ' ') AS d, array_to_string(list_filter(s, lambda x, i: k[i] = 1), ' ') AS c, array_to_string(list_filter(s, lambda x, i: k[i] = 2), ' ') AS x FROM k)
SELECT doc_id, CASE WHEN d = '' THEN p ELSE d END AS declaration, CASE WHEN d <> '' THEN nullif(c, '') END AS "contains", CASE WHEN d <> '' THEN nullif(x, '') END AS cross_contact FROM j""")
def q_label_statements(spark, sf_dir):
    """statements about allergens apart from the list, over all documents."""
    return labels(spark, sf_dir).select("doc_id", nested.statements(F.col("label")).alias("s")).select("doc_id", "s.*")


SCAN_SQL = rf"""
cut AS (SELECT key, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT key, regexp_extract_all(label, {quoted(nested.TOKEN)}) AS t FROM lists)),
kinds AS (SELECT key, pos, token, CASE WHEN substr(token, 1, 1) IN ('(', '[', '{{') THEN 'open' WHEN substr(token, 1, 1) IN (')', ']', '}}') THEN 'close' WHEN token IN (',', ';') THEN 'mark' ELSE 'text' END AS kind FROM cut WHERE trim(token) <> ''),
flags AS (SELECT *, kind = 'text' AND regexp_extract(token, {quoted(nested.OWN_LIMIT)}, 2) <> '' AND lower(regexp_extract(token, {quoted(nested.OWN_LIMIT)}, 2)) <> 'of' AS own FROM kinds),
opened AS (SELECT *, kind = 'text' AND NOT own AND regexp_matches(token, {quoted(nested.SECTION)}) AS opens, regexp_extract(token, {quoted(nested.AMOUNT)}, 1) AS amount FROM flags),
bare AS (
  SELECT key, pos, kind, own, opens, CASE WHEN own THEN regexp_replace(token, {quoted(rf"(?i)^\s*(?:less|not\s+more|no\s+more)\s+than\s+{nested.AMOUNT}\s+")}, '', 'g') WHEN opens THEN regexp_replace(token, {quoted(nested.SECTION)}, chr(2), 'g') ELSE token END AS token,
    CASE WHEN own OR opens THEN CASE WHEN amount = '' THEN 'trace' WHEN regexp_matches(token, {quoted("(?i)" + nested.OR_LESS)}) THEN amount || '% or less' ELSE 'less than ' || amount || '%' END END AS note,
    kind = 'text' AND regexp_matches(lower(trim(token)), '^({"|".join(nested.REMARKS)})') AS remark FROM opened),
summed AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos) AS s, lag(kind) OVER (PARTITION BY key ORDER BY pos) AS before FROM bare),
lows AS (SELECT *, least(coalesce(min(s) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS low FROM summed),
strays AS (SELECT *, kind = 'close' AND s < low AS stray FROM lows),
levels AS (SELECT *, (s - least(s, low) + CASE WHEN kind = 'close' AND NOT stray THEN 1 ELSE 0 END)::INTEGER AS level FROM strays),
grouped AS (SELECT *, coalesce(max(CASE WHEN kind = 'open' THEN pos END) OVER (PARTITION BY key, level ORDER BY pos), -1) AS grp, kind = 'text' AND before = 'close' AND regexp_matches(token, {quoted(nested.CONJUNCTION)}) AS joined FROM levels),
held AS (
  SELECT *, CASE WHEN kind = 'text' THEN string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN joined THEN regexp_replace(token, {quoted(nested.CONJUNCTION)}, '', 'g') ELSE token END,
    {quoted(rf"(?i)\b({'|'.join(nested.SHORTENED)}|[a-z])\.\s+")}, '\1' || chr(1), 'g'), {quoted(r"(?i)^\s*(?:may\s+(?:also\s+)?(?:not\s+)?contain|contains?|allerg\w*)\b[^:]*:.*$")}, '', 'g'),
    {quoted(rf"(?i)^\s*(?:{in_words(nested.INTRODUCTIONS)})\b[^:]*:\s*")}, '', 'g'), {quoted(nested.HEADER)}, '\1' || chr(2), 'g'), '\.\s+([A-Za-z])', chr(2) || '\1', 'g'), chr(2)) ELSE [''] END AS each FROM grouped),
subs AS (SELECT * EXCLUDE (each), unnest(each) AS raw_words, generate_subscripts(each, 1) - 1 AS sub FROM held),
placed AS (SELECT *, trim(regexp_replace(replace(raw_words, chr(1), '. '), '\s+', ' ', 'g')) AS words, pos::BIGINT * 16777216 + sub AS place FROM subs),
scanned AS (SELECT *, sum(CASE WHEN kind = 'mark' OR stray OR (sub = 0 AND joined) OR sub > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key, level, grp ORDER BY place) AS item FROM placed)"""

ITEMS_SQL = rf"""
stats AS (
  SELECT key AS k, level AS lv, grp AS g, count(DISTINCT CASE WHEN words <> '' THEN item END) > 1 AS several, bool_or(kind = 'close' AND NOT stray) AS closed, bool_or(remark OR opens) AS remarks,
    coalesce(bool_or(kind = 'open' AND before = 'text'), false) AS headed FROM scanned GROUP BY ALL),
judged AS (SELECT s.* EXCLUDE (remark), remarks AND NOT several AND grp >= 0 AS remark, closed AND headed AND NOT several AND grp >= 0 AS synonym FROM scanned s JOIN stats ON k = key AND lv = level AND g = grp),
marked AS (
  SELECT *, sum(CASE WHEN synonym AND NOT remark THEN CASE WHEN kind = 'open' THEN 1 WHEN kind = 'close' AND NOT stray THEN -1 ELSE 0 END ELSE 0 END) OVER (PARTITION BY key ORDER BY place) AS gone,
    last_value(CASE WHEN opens AND sub > 0 AND NOT remark THEN note END IGNORE NULLS) OVER (PARTITION BY key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM judged),
kept AS (SELECT *, CASE WHEN own OR (opens AND remark) THEN note END AS mine FROM marked WHERE kind = 'text' AND gone = 0 AND words <> '' AND NOT (remark AND note IS NULL)),
whole AS (SELECT key, level, grp, item, min(place) AS place, array_to_string(list(words ORDER BY place), ' ') AS raw, max(mine) AS mine, arg_min_null(section, place) AS section FROM kept GROUP BY ALL),
named AS (
  SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\*+|\*+$', '', 'g'), '^\d+(\.\d+)?%\s*', '', 'g'), '(?i)\b(contains|phenylketonurics?|may contain)\b.*$', '', 'g'), '^[.\s]+|[.\s]+$', '', 'g'), '\s+', ' ', 'g'))) AS name0 FROM whole),
flagged AS (SELECT *, regexp_matches(raw, '^\s*\*|\*\s*$') OR starts_with(name0, 'organic ') AS organic, regexp_replace(name0, '^(organic )+', '') AS name FROM named),
fit AS (SELECT *, coalesce(mine, section) AS note FROM flagged WHERE length(name) BETWEEN 2 AND {nested.LONGEST_ITEM} AND name NOT IN ({", ".join(quoted(n) for n in nested.NO_ITEMS)}) AND regexp_matches(name, '[\p{{L}}\p{{N}}]')),
ordered AS (SELECT *, row_number() OVER (PARTITION BY key, name ORDER BY organic DESC, place) AS r, min(place) OVER (PARTITION BY key, name) AS first_place, bool_or(organic) OVER (PARTITION BY key, name) AS any_organic FROM fit)"""


@query(f"""
WITH lists AS (SELECT doc_id AS key, {LABEL_SQL} AS label FROM documents), {SCAN_SQL}
SELECT key AS doc_id, level, count(*) AS tokens, count(DISTINCT grp) AS brackets, count(DISTINCT grp::VARCHAR || '/' || item::VARCHAR) FILTER (kind = 'text') AS items, count(*) FILTER (stray) AS strays FROM scanned WHERE sub = 0 GROUP BY ALL""")
def q_bracket_levels(spark, sf_dir):
    """levels, brackets and items of every document's label, by one scan of its tokens."""
    seen = nested.scan(labels(spark, sf_dir), "doc_id", "label").where("sub = 0").groupBy("doc_id", "level")
    item = F.when(F.col("kind") == "text", F.concat_ws("/", "grp", "item"))
    return seen.agg(F.count("*").alias("tokens"), F.count_distinct("grp").alias("brackets"), F.count_distinct(item).alias("items"), F.count_if("stray").alias("strays"))


@query(f"""
WITH lists AS (SELECT doc_id AS key, {LABEL_SQL} AS label FROM documents), {SCAN_SQL}, {ITEMS_SQL}
SELECT key AS doc_id, name, level AS depth, row_number() OVER (PARTITION BY key ORDER BY first_place)::INTEGER AS position, any_organic AS organic, note IS NOT NULL AS trace, note FROM ordered WHERE r = 1""")
def q_label_items(spark, sf_dir):
    """the distinct items of every document's nested list, in order, with depth, trace sections and organic marks."""
    return nested.items(labels(spark, sf_dir), "doc_id", "label")
