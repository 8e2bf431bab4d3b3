"""Queries over compounds, nouns, code tables and singulars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import display, folding
from quern.operators import dictionary
from quern.plans.catalogue import load, query
from quern.plans.names import ORDER_NAMES_SQL, STEM_SQL, STEMS_SQL, order_names

HEADS = ["bolt", "gear", "ring", "rod"]
COMPOUND_SQL = """
c AS (SELECT p_partkey, split_part(p_name, ' ', 1) || [' and ', ' or ', ', and/or ', ' & ', ' '][p_partkey % 5 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ['red', 'odd', 'cold'][p_size % 3 + 1] || ' ' END || split_part(p_name, ' ', 2) AS name FROM part)"""


@query(f"""
WITH {COMPOUND_SQL}, known AS (SELECT DISTINCT p_name FROM part),
d AS (SELECT p_partkey, name, regexp_matches(name, '\\s*,?\\s+(?:and\\s*/\\s*or|or)\\s+') AS e, CASE WHEN regexp_matches(name, '\\s*,?\\s+(?:and\\s*/\\s*or|or)\\s+') THEN string_split_regex(name, '\\s*,?\\s+(?:and\\s*/\\s*or|or)\\s+') ELSE string_split_regex(name, '\\s+(?:and|&)\\s+') END AS ps FROM c),
f AS (SELECT *, string_split(ps[-1], ' ')[-1] AS head, len(string_split(ps[-1], ' ')) > 1 AND string_split(ps[-1], ' ')[-1] IN ('bolt', 'gear', 'ring', 'rod') AS lends FROM d),
g AS (SELECT p_partkey, name, e, list_transform(ps, lambda x, i: CASE WHEN i < len(ps) AND lends AND string_split(x, ' ')[-1] NOT IN ('bolt', 'gear', 'ring', 'rod') THEN x || ' ' || head ELSE x END) AS items FROM f),
h AS (SELECT *, CASE WHEN e OR (len(items) = 2 AND items[1] IN (SELECT p_name FROM known) AND items[2] IN (SELECT p_name FROM known)) THEN items ELSE [name] END AS kept FROM g)
SELECT p_partkey, (generate_subscripts(kept, 1) - 1)::INTEGER AS part, unnest(kept) AS item FROM h""")
def q_compounds(spark, sf_dir):
    """names joined by and, or, and/or taken apart, with the head word they share, if what comes out is known."""
    part = load(spark, sf_dir, "part")
    k, first, second = F.col("p_partkey"), F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    joint = F.element_at(F.array(*map(F.lit, (" and ", " or ", ", and/or ", " & ", " "))), (k % 5 + 1).cast("int"))
    other = F.when(k % 3 == 0, "").otherwise(F.concat(F.element_at(F.array(*map(F.lit, ("red", "odd", "cold"))), F.col("p_size") % 3 + 1), F.lit(" ")))
    return dictionary.compounds(part.select(k, F.concat(first, joint, other, second).alias("name")), "p_partkey", "name", part.select(F.col("p_name").alias("name")), HEADS)


@query(f"""
WITH {ORDER_NAMES_SQL}, t AS (SELECT l_orderkey, regexp_replace(name, '[, ]+$', '') AS name, l_orderkey % 97 AS maker FROM names),
s AS (SELECT l_orderkey, name, maker, {STEMS_SQL} AS ws FROM (SELECT *, name AS said FROM t)),
nouns AS (SELECT ws[-1] AS noun FROM s WHERE len(ws) > 0 GROUP BY 1 HAVING count(DISTINCT maker) >= 5 AND avg(CASE WHEN contains(name, ',') THEN 0 ELSE 1 END) >= 0.25),
h AS (SELECT l_orderkey, trim(name) AS name, list_filter(list_transform(string_split(name, ','), lambda x: trim(x)), lambda x: x <> '') AS h FROM t),
a AS (SELECT *, (SELECT {STEMS_SQL}[-1] FROM (SELECT h[1] AS said)) AS x, (SELECT {STEMS_SQL}[-1] FROM (SELECT h[2] AS said)) AS y FROM h),
b AS (SELECT *, len(h) = 2 AS pair, y IN (SELECT noun FROM nouns) AND NOT coalesce(x IN (SELECT noun FROM nouns), false) AS swap FROM a)
SELECT l_orderkey, CASE WHEN NOT pair THEN name WHEN swap THEN h[2] ELSE h[1] END AS title, CASE WHEN pair THEN CASE WHEN swap THEN h[1] ELSE h[2] END END AS secondary FROM b""")
def q_oriented_titles(spark, sf_dir):
    """a lexicon of nouns out of all names, and names of two halves turned so that the one with the noun leads."""
    named = order_names(spark, sf_dir).select("l_orderkey", F.regexp_replace("name", "[, ]+$", "").alias("name"), (F.col("l_orderkey") % 97).alias("maker"))
    return dictionary.oriented(named, "l_orderkey", "name", dictionary.nouns(named, "name", "maker", makers=5, plain_share=0.25))


@query("""
WITH codes AS (SELECT 'e' || (100 + p_size) AS code, min(p_partkey) AS place, arg_min(p_type, p_partkey) AS name FROM part WHERE p_size % 4 > 0 GROUP BY 1),
used AS (SELECT l_orderkey, 'e' || (100 + l_quantity::INT) AS code FROM lineitem),
f AS (SELECT l_orderkey, name, min(place) AS place FROM used JOIN codes USING (code) GROUP BY ALL), n AS (SELECT l_orderkey, string_agg(name, '|' ORDER BY place) AS names FROM f GROUP BY l_orderkey),
u AS (SELECT l_orderkey, count(*) FILTER (codes.code IS NULL) AS unknown FROM used LEFT JOIN codes USING (code) GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(names, '') AS names, unknown, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'Other' END AS status,
  array_to_string(list_filter([CASE WHEN regexp_matches(o_orderpriority, '(?i)urgent|high') THEN 'fast' END, CASE WHEN regexp_matches(o_orderpriority, '(?i)^[1-3]') THEN 'upper' END, CASE WHEN regexp_matches(o_orderpriority, '(?i)not') THEN 'unsaid' END], lambda x: x IS NOT NULL), '|') AS kinds
FROM orders JOIN u ON u.l_orderkey = o_orderkey LEFT JOIN n ON n.l_orderkey = o_orderkey""")
def q_code_tables(spark, sf_dir):
    """Codes looked up in a table of any size: families in their order, codes without an entry, labels with a default, several labels in one text."""
    part, lineitem, orders = load(spark, sf_dir, "part", "lineitem", "orders")
    table = part.where("p_size % 4 > 0").select(F.concat(F.lit("e"), F.col("p_size") + 100).alias("code"), F.col("p_type").alias("name"), F.col("p_partkey").alias("place"))
    used = lineitem.select("l_orderkey", F.concat(F.lit("e"), F.col("l_quantity").cast("int") + 100).alias("code"))
    found = dictionary.families(used, "l_orderkey", "code", table)
    status = F.when(F.col("o_orderstatus") == "F", "Filled").when(F.col("o_orderstatus") == "O", "Open").otherwise("Other")
    kinds = dictionary.codes_of(F.col("o_orderpriority"), [("fast", "urgent|high"), ("upper", "^[1-3]"), ("unsaid", "not")])
    return orders.join(found, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.array_join("names", "|").alias("names"), "unknown", status.alias("status"), F.array_join(kinds, "|").alias("kinds"))


@query(f"""
WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z]+')) AS w FROM documents) WHERE w <> '')
SELECT w AS word, {STEM_SQL} AS singular FROM w""")
def q_singulars(spark, sf_dir):
    """Every word of all texts without accents, in a singular that is the same wherever the word stands."""
    text = F.replace(F.lower(folding.unmarked(display.storable(F.col("text")))), F.lit("ß"), F.lit("ss"))
    words = load(spark, sf_dir, "documents").select(F.explode(F.split(text, "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", dictionary.stem(F.col("word")).alias("singular"))
