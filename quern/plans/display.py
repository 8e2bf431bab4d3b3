"""Queries over names as readers see them. Names are the first lines of documents, some in capitals, some behind claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import display
from quern.plans.catalogue import load, query

GENERIC = ["the", "la", "el", "die", "der", "le", "milk"]

NAMES_SQL = """
n AS (
  SELECT doc_id, ['', 'organic ', '100% Gluten-Free vegan, ', '  usda ORGANIC - '][doc_id % 4 + 1] || CASE WHEN doc_id % 3 = 0 THEN upper(replace(left(l, 20 + doc_id % 60), 'ß', 'ss')) ELSE left(l, 20 + doc_id % 60) END AS raw
  FROM (SELECT doc_id, split_part(regexp_replace(coalesce(text, ''), '[|!$%*&#]', '', 'g'), chr(10), 1) AS l FROM documents)),
d AS (SELECT doc_id, CASE WHEN c <> '' THEN c ELSE trim(raw) END AS shown FROM (SELECT doc_id, raw, trim(regexp_replace(regexp_replace(raw, '^[\\s,;:.\\-–—&/]+|[\\s,;:\\-–—&/]+$', '', 'g'), '\\s+', ' ', 'g')) AS c FROM n))"""


def names(spark, sf_dir):
    line = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[|!$%*&#]", ""), "\n")[0]
    cut = F.substring(line, F.lit(1), (20 + F.col("doc_id") % 60).cast("int"))
    lead = F.element_at(F.array(*map(F.lit, ("", "organic ", "100% Gluten-Free vegan, ", "  usda ORGANIC - "))), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = F.concat(lead, F.when(F.col("doc_id") % 3 == 0, F.upper(F.replace(cut, F.lit("ß"), F.lit("ss")))).otherwise(cut))
    return load(spark, sf_dir, "documents").select("doc_id", display.display_name(raw).alias("shown"))


_WORD = "CASE WHEN (x <> lower(x) AND x <> upper(x)) OR (x = upper(x) AND x <> lower(x) AND length(x) <= 3 AND NOT shout) THEN x WHEN NOT ({forced}) AND lower(x) IN (" + ", ".join(f"'{w}'" for w in display.SMALL_WORDS) + ") THEN lower(x) ELSE upper(x[1]) || lower(x)[2:] END"
_CASED = "array_to_string(list_transform(string_split(regexp_extract(w, '^(.*?)([,.;:]*)$', 1), '-'), lambda x, j: " + _WORD.format(forced="(i = 1 OR i = len(ws)) AND j = 1") + "), '-') || regexp_extract(w, '^(.*?)([,.;:]*)$', 2)"
_FIT = "CASE WHEN length({t}) <= 56 OR length({h}) < 12 THEN {t} ELSE {h} END"


def _head(t: str) -> str:
    return f"regexp_replace(CASE WHEN length(regexp_extract(left({t}, 56), '^(.*) ', 1)) > 12 THEN regexp_extract(left({t}, 56), '^(.*) ', 1) ELSE left({t}, 56) END, '[\\s,;:.\\-–—&/]+$', '')"


@query(f"""
WITH {NAMES_SQL},
t AS (SELECT doc_id, shown, NOT regexp_matches(shown, '[a-z]') AS shout, string_split(shown, ' ') AS ws FROM d),
c AS (SELECT doc_id, shown, array_to_string(list_transform(ws, lambda w, i: CASE WHEN regexp_matches(regexp_extract(w, '^(.*?)([,.;:]*)$', 1), '^[A-Za-z]+(-[A-Za-z]+)*$') THEN {_CASED} ELSE w END), ' ') AS titled,
  list_reduce(list_prepend(trim(shown), ['', '', '', '', '', '', '', '']), lambda a, x: CASE WHEN regexp_matches(a, '{display.CLAIM}') AND length(trim(regexp_replace(a, '{display.CLAIM}', ''))) >= 10 AND regexp_matches(trim(regexp_replace(a, '{display.CLAIM}', '')), '[A-Za-z]')
    THEN trim(regexp_replace(a, '{display.CLAIM}', '')) ELSE a END) AS bare FROM t),
h AS (SELECT *, regexp_extract(bare, '{display.LIST_BEGINS}', 1) AS lead, trim(regexp_replace(regexp_extract(bare, '{display.LIST_BEGINS}', 1), '[\\s,;:.\\-–—&/]+$', '')) AS head FROM c),
p AS (SELECT doc_id, list_filter(list_transform(string_split(shown, ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM d)
SELECT h.doc_id, shown, titled, CASE WHEN length(trim(shown)) <= 44 THEN trim(shown) WHEN length(bare) <= 44 THEN bare WHEN regexp_matches(bare, '{display.LIST_BEGINS}') AND length(lead) >= 12 AND length(head) >= 12 THEN {_FIT.format(t="head", h=_head("head"))} ELSE {_FIT.format(t="bare", h=_head("bare"))} END AS short,
  CASE WHEN len(ps) = 2 AND NOT (NOT contains(ps[1], ' ') AND regexp_matches(ps[2], '(?i)\\s(?:&|and)\\s')) AND length(regexp_replace(ps[1], '(?i)[^a-z0-9]', '', 'g')) >= 3 THEN ps[1] ELSE trim(shown) END AS title,
  CASE WHEN len(ps) = 2 AND NOT (NOT contains(ps[1], ' ') AND regexp_matches(ps[2], '(?i)\\s(?:&|and)\\s')) AND length(regexp_replace(ps[1], '(?i)[^a-z0-9]', '', 'g')) >= 3 AND length(regexp_replace(ps[2], '(?i)[^a-z0-9]', '', 'g')) >= 3 THEN ps[2] END AS secondary,
  CASE WHEN len(ps) < 2 THEN 'no_comma' WHEN len(ps) > 2 THEN 'several' WHEN NOT contains(ps[1], ' ') AND regexp_matches(ps[2], '(?i)\\s(?:&|and)\\s') THEN 'list' WHEN length(regexp_replace(ps[1], '(?i)[^a-z0-9]', '', 'g')) < 3 OR length(regexp_replace(ps[2], '(?i)[^a-z0-9]', '', 'g')) < 3 THEN 'no_comma' ELSE 'split' END AS branch
FROM h JOIN p ON h.doc_id = p.doc_id""")
def q_display_names(spark, sf_dir):
    """names cleaned, in title case, shortened, and divided at their comma."""
    shown = F.col("shown")
    found = names(spark, sf_dir).select("doc_id", "shown", display.title_case(shown).alias("titled"), display.short_name(shown).alias("short"), display.title_parts(shown).alias("p"))
    return found.select("doc_id", "shown", "titled", "short", "p.title", "p.secondary", "p.branch")


@query(f"""
WITH {NAMES_SQL}, w AS (SELECT doc_id, shown, list_filter(list_transform(string_split_regex(lower(shown), '\\s+'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS ws FROM d),
b AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: ws[i] IN ({", ".join(f"'{g}'" for g in GENERIC)})) AS gs, list_filter(range(1, len(ws) + 1), lambda i: length(ws[i]) > 2) AS ls FROM w),
k AS (SELECT doc_id, array_to_string(ws[1:least(coalesce(gs[1] - 1, len(ws)), CASE WHEN ls[1] = 1 THEN 1 ELSE coalesce(ls[1] - 1, len(ws)) END)], '') AS key FROM b)
SELECT d.doc_id, CASE WHEN length(key) >= 3 THEN key END AS key, CASE WHEN length(key) < 3 THEN NULL WHEN coalesce(text, '') = '' THEN true ELSE contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), key) END AS named
FROM documents d JOIN k ON d.doc_id = k.doc_id""")
def q_lead_keys(spark, sf_dir):
    """what a name leads with, and whether a text names it: yes, no or unknown."""
    joined = names(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", display.lead_key(F.col("shown"), GENERIC).alias("key"), display.notice_names(F.col("shown"), F.col("text"), GENERIC).alias("named"))


ITEM_RULES = [(" the ", " _the_ "), (" of ", ", 2% or less of "), (" la ", ", and, "), (" der ", ", 100 % , "), (" que ", ", www.que "), (" et ", ", --* ")]


def _items_sql(c: str) -> str:
    for a, b in ITEM_RULES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"""
WITH i AS (SELECT doc_id, unnest(xs) AS raw, generate_subscripts(xs, 1)::INTEGER AS n FROM (SELECT doc_id, string_split({_items_sql("text")}, ',') AS xs FROM documents)),
a AS (SELECT doc_id, n, trim(raw, ' ') AS name, lower(trim(raw, ' ')) AS low, regexp_replace(replace(trim(raw, ' '), '_', ' '), '{display.JUNK}', '', 'g') AS bare FROM i),
b AS (SELECT *, regexp_replace(regexp_replace(bare, '{display.QUANTITY}', ''), '{display.JUNK}', '', 'g') AS less FROM a),
c AS (SELECT *, less <> bare AND regexp_matches(less, '[a-zA-Z]{{3}}') AS shorter FROM b),
e AS (SELECT *, trim(regexp_replace(CASE WHEN shorter THEN less ELSE bare END, '\\s{{2,}}', ' ', 'g'), ' ') AS out FROM c),
v AS (SELECT *, CASE WHEN low IN ({", ".join(f"'{t}'" for t in display.TORN)}) THEN 'a torn piece of a list' WHEN {" OR ".join(f"contains(low, '{p}')" for p in display.PACKAGE)} THEN 'words of a package' WHEN regexp_matches(name, '^[0-9][0-9\\s./%-]*$') THEN 'digits' WHEN out = name THEN NULL
  WHEN length(out) < 2 OR NOT regexp_matches(out, '[a-zA-Z]') THEN 'nothing left' WHEN contains(name, '_') THEN 'marked up' WHEN shorter THEN 'a quantity before it' ELSE 'signs around it' END AS why FROM e)
SELECT doc_id, n, CASE WHEN why IS NULL THEN 'keep' WHEN why IN ('marked up', 'a quantity before it', 'signs around it') THEN 'rename' ELSE 'drop' END AS action,
  CASE WHEN why IS NULL OR why IN ('marked up', 'a quantity before it', 'signs around it') THEN out END AS name, why, NOT regexp_matches(name, '[a-zA-Z]') AS no_latin FROM v""")
def q_cleaned_items(spark, sf_dir):
    """items of lists kept, renamed or dropped, each with its reason."""
    text = F.col("text")
    for a, b in ITEM_RULES:
        text = F.replace(text, F.lit(a), F.lit(b))
    items = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text, ",")).alias("n", "raw"))
    found = items.select("doc_id", (F.col("n") + 1).alias("n"), display.cleaned_item(F.col("raw")).alias("c"), display.lacks_latin(F.trim("raw")).alias("no_latin"))
    return found.select("doc_id", "n", "c.action", "c.name", "c.why", "no_latin")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_linenumber % 4 WHEN 0 THEN (l_quantity::INT - 1) || '.99999999999' WHEN 1 THEN l_quantity::INT || '.0499999999' ELSE (l_quantity::INT)::VARCHAR END AS x, [' g', 'ml)', ' tbsp', ' Gram'][l_suppkey % 4 + 1] AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '1 serving (' || CASE l_linenumber % 4 WHEN 0 THEN l_quantity::INT::VARCHAR WHEN 1 THEN l_quantity::INT::VARCHAR ELSE x END || u AS label,
  CASE WHEN l_suppkey % 4 < 2 AND l_quantity >= 1 THEN CASE l_linenumber % 4 WHEN 0 THEN l_quantity::INT::DOUBLE WHEN 1 THEN l_quantity::INT::DOUBLE ELSE x::DOUBLE END END AS grams FROM s""")
def q_serving_labels(spark, sf_dir):
    """F8: labels of servings without noise in their numbers, and the grams that they state."""
    q, kind = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 4
    number = F.when(kind == 0, F.concat((q - 1).cast("string"), F.lit(".99999999999"))).when(kind == 1, F.concat(q.cast("string"), F.lit(".0499999999"))).otherwise(q.cast("string"))
    unit = F.element_at(F.array(*map(F.lit, (" g", "ml)", " tbsp", " Gram"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    labelled = load(spark, sf_dir, "lineitem").withColumn("label", display.tidy_serving(F.concat(F.lit("1 serving ("), number, unit)))
    return labelled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label", display.serving_grams(F.col("label")).alias("grams"))


@query("""
WITH m AS (SELECT o_orderkey, [NULL, 'barcode', 'owner_brand', 'named_brand', 'firm'][o_orderkey % 5 + 1] AS method, CASE o_orderstatus WHEN 'F' THEN 'supply_chain' WHEN 'O' THEN 'retailer' END AS role, c_name AS issuer, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderkey::VARCHAR END AS matched
  FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, CASE method WHEN 'barcode' THEN 'The notice of ' || issuer || ' has this product''s own barcode.' WHEN 'owner_brand' THEN issuer || ', which owns the brand, issued the notice.' WHEN 'named_brand' THEN issuer || ' issued the notice and doesn''t own the brand.' WHEN 'firm' THEN issuer || ' issued the notice.' END
  || CASE WHEN method IN ('barcode', 'named_brand') AND role = 'supply_chain' THEN ' ' || issuer || ' works for other firms.' WHEN method IN ('barcode', 'named_brand') AND role = 'retailer' THEN ' ' || issuer || ' sells at retail.' ELSE '' END
  || CASE WHEN method <> 'barcode' AND regexp_matches(matched, '[A-Za-z]{2}') THEN ' It says: ' || trim(matched) || '.' ELSE '' END AS note FROM m""")
def q_evidence_notes(spark, sf_dir):
    """what each notice proves, by how it was matched and who issued it."""
    orders, customer = load(spark, sf_dir, "orders", "customer")
    k = F.col("o_orderkey")
    method = F.element_at(F.array(*map(F.lit, (None, "barcode", "owner_brand", "named_brand", "firm"))), (k % 5 + 1).cast("int"))
    role = F.when(F.col("o_orderstatus") == "F", "supply_chain").when(F.col("o_orderstatus") == "O", "retailer")
    matched = F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(k.cast("string"))
    return orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(k, display.evidence_note(method, role, F.col("c_name"), matched).alias("note"))
