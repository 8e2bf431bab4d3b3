"""Queries that tell from the words of a name what the thing is. Names are the parts of every order, joined by the signs and words that names of products have;
dictionaries and rules are made from `part`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import dictionary
from quern.plans.catalogue import load, query

JOINTS = [", ", " with ", " flavored, ", " "]

ORDER_NAMES_SQL = """
names AS (
  SELECT l_orderkey, string_agg(p_name || CASE WHEN l_quantity > 25 THEN 's' ELSE '' END || [', ', ' with ', ' flavored, ', ' '][l_linenumber % 4 + 1], '' ORDER BY l_linenumber, p_name, l_quantity > 25) AS name
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)"""
STEM_SQL = "CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN regexp_matches(w, '(oes|ches|shes|sses|xes)$') THEN w[:-3] WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN w LIKE '%s' THEN w[:-2] ELSE w END"
STEMS_SQL = f"list_transform(list_filter(string_split_regex(lower(said), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {STEM_SQL})"
SEGMENTS_SQL = f"""
parts AS (SELECT l_orderkey, unnest(p) AS said, generate_subscripts(p, 1) - 1 AS part FROM (SELECT l_orderkey, string_split_regex(name, '[,;:|()\\[\\]{{}}/+]|\\s[-–—]|[-–—]\\s') AS p FROM names)),
subs AS (SELECT l_orderkey, part, unnest(s) AS said, generate_subscripts(s, 1) - 1 AS sub FROM (SELECT l_orderkey, part, string_split_regex(' ' || array_to_string({STEMS_SQL}, '  ') || ' ', ' (?:with|in|on|for|from) ') AS s FROM parts)),
segs AS (SELECT l_orderkey, part, sub, list_filter(string_split(said, ' '), lambda w: w <> '') AS words FROM subs)"""
#: Every occurrence of a term, by comparing every run of words to every term.
HITS_SQL = """
runs AS (SELECT l_orderkey, part, sub, words, unnest(range(len(words))) AS start FROM segs WHERE len(words) > 0),
grams AS (SELECT l_orderkey, part, sub, words, start, unnest(range(start + 1, len(words) + 1)) AS stop FROM runs),
hits AS (SELECT l_orderkey, part, sub, start, stop, g.term, words[stop + 1] AS after FROM (SELECT *, array_to_string(words[start + 1:stop], ' ') AS term FROM grams) g JOIN (SELECT DISTINCT term FROM terms) t ON g.term = t.term)"""


def order_names(spark, sf_dir):
    part, lineitem = load(spark, sf_dir, "part", "lineitem")
    joint = F.element_at(F.array(*map(F.lit, JOINTS)), F.col("l_linenumber") % len(JOINTS) + 1)
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_quantity") > 25).alias("many"), joint.alias("joint")).join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name", "many", "joint")))  # the lines of one order
    said = F.transform(listed, lambda r: F.concat(r["p_name"], F.when(r["many"], "s").otherwise(""), r["joint"]))
    return lines.groupBy("l_orderkey").agg(F.array_join(said, "").alias("name"))


TERMS_SQL = """
terms AS (
  SELECT DISTINCT p_name AS term, CASE WHEN split_part(p_name, ' ', 1) <> 'new' THEN upper(split_part(p_name, ' ', 2)) || ' ' || (CASE WHEN split_part(p_name, ' ', 1) IN ('hot', 'cold') THEN 'T' ELSE 'S' END) END AS category,
    CASE WHEN split_part(p_name, ' ', 1) = 'new' THEN 3 ELSE 0 END AS tier FROM part WHERE split_part(p_name, ' ', 1) IN ('hot', 'cold', 'red', 'new')
  UNION SELECT DISTINCT split_part(p_name, ' ', 2), upper(split_part(p_name, ' ', 2)), 1 FROM part WHERE split_part(p_name, ' ', 2) NOT IN ('ring', 'rod')
  UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'KIND OF ' || split_part(p_name, ' ', 1), 2 FROM part
  UNION SELECT 'bolt', 'never: defined again', 2)"""


def name_terms(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    adjective, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    tail = F.when(adjective.isin("hot", "cold"), "T").otherwise("S")
    strong = part.where(adjective.isin("hot", "cold", "red", "new")).select(F.col("p_name").alias("term"), F.when(adjective != "new", F.concat_ws(" ", F.upper(noun), tail)).alias("category"), F.when(adjective == "new", 3).otherwise(0).alias("tier"))
    flavours = part.where(~noun.isin("ring", "rod")).select(noun, F.upper(noun), F.lit(1))
    weak = part.select(adjective, F.concat(F.lit("KIND OF "), adjective), F.lit(2))
    twice = spark.range(1).select(F.lit("bolt"), F.lit("never: defined again"), F.lit(2))
    return strong.distinct().union(flavours.distinct()).union(weak.distinct()).union(twice)


OVERRIDES = [
    dictionary.Override(("GEAR", "GEAR S", "GEAR T"), r"\bplate\b", "GEARED PLATE", unless=r"\banvil\b"),
    dictionary.Override(("GIZMO",), r"\bold\b", None),
    dictionary.Override(("GEARED PLATE", "BOLT"), r"\bcold\b", "COLD STORE"),
]


@query(f"""
WITH {ORDER_NAMES_SQL}, {SEGMENTS_SQL}, {TERMS_SQL}, {HITS_SQL},
known AS (SELECT term, arg_min_null(category, tier) AS category, min(tier) AS tier FROM terms GROUP BY term),
long AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.l_orderkey = h.l_orderkey AND o.part = h.part AND o.sub = h.sub AND o.start <= h.start AND o.stop >= h.stop AND o.stop - o.start > h.stop - h.start)),
judged AS (SELECT l.*, category, CASE WHEN after IN ('flavor', 'flavored', 'flavour', 'flavoured', 'inspired') OR category IS NULL THEN 3 ELSE tier END AS tier FROM long l JOIN known USING (term)),
fit AS (SELECT * FROM judged j WHERE tier < 3 AND (sub = 0 OR NOT EXISTS (SELECT 1 FROM judged o WHERE o.l_orderkey = j.l_orderkey AND o.part = j.part AND o.sub = 0 AND o.tier < 3))),
best AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, part, sub, stop DESC, start) AS r FROM fit),
plain AS (SELECT l_orderkey, array_to_string({STEMS_SQL}, ' ') AS p FROM (SELECT l_orderkey, name AS said FROM names)),
one AS (SELECT l_orderkey, p, term, tier, CASE WHEN category IN ('GEAR', 'GEAR S', 'GEAR T') AND regexp_matches(p, '\\bplate\\b') AND NOT regexp_matches(p, '\\banvil\\b') THEN 'GEARED PLATE' ELSE category END AS c1 FROM best JOIN plain USING (l_orderkey) WHERE r = 1),
two AS (SELECT *, CASE WHEN c1 = 'GIZMO' AND regexp_matches(p, '\\bold\\b') THEN NULL ELSE c1 END AS c2 FROM one),
three AS (SELECT l_orderkey, term, tier, CASE WHEN c2 IN ('GEARED PLATE', 'BOLT') AND regexp_matches(p, '\\bcold\\b') THEN 'COLD STORE' ELSE c2 END AS category FROM two)
SELECT l_orderkey, category, term, tier FROM three WHERE category IS NOT NULL""")
def q_name_categories(spark, sf_dir):
    """Category of every order's name by the longest terms of a dictionary, strong before flavour before weak, with overrides in their order."""
    return dictionary.categorise(order_names(spark, sf_dir), "l_orderkey", "name", name_terms(spark, sf_dir), OVERRIDES)


@query(f"""
WITH {ORDER_NAMES_SQL}, {SEGMENTS_SQL}, {TERMS_SQL}, {HITS_SQL},
covered AS (SELECT DISTINCT l_orderkey, part, sub, unnest(range(start, stop)) AS k FROM hits),
words AS (SELECT l_orderkey, part, sub, unnest(words) AS w, unnest(range(len(words))) AS k FROM segs WHERE len(words) > 0)
SELECT w.l_orderkey, w.part::INTEGER AS part, w.sub::INTEGER AS sub, count(*) AS n_words, coalesce(string_agg(CASE WHEN c.k IS NULL THEN w END, ' ' ORDER BY w.k), '') AS rest
FROM words w LEFT JOIN covered c ON w.l_orderkey = c.l_orderkey AND w.part = c.part AND w.sub = c.sub AND w.k = c.k GROUP BY ALL""")
def q_name_residuals(spark, sf_dir):
    """the words of each part of a name that no term covers."""
    found = dictionary.segments(order_names(spark, sf_dir), "l_orderkey", "name")
    keys = ["l_orderkey", "part", "sub"]
    return dictionary.uncovered(found, keys, name_terms(spark, sf_dir)).select(*keys, F.size("words").cast("long").alias("n_words"), F.array_join("rest", " ").alias("rest"))


RULES_SQL = """
rules AS (SELECT row_number() OVER (ORDER BY p_name) AS rule, p_name AS term, [split_part(p_name, ' ', 1) || ' ring', 'old ' || split_part(p_name, ' ', 2)] AS excludes,
    CASE WHEN split_part(p_name, ' ', 2) <> 'rod' THEN upper(p_name) END AS result FROM (SELECT DISTINCT p_name FROM part WHERE split_part(p_name, ' ', 1) IN ('large', 'small', 'hot', 'blue'))),
terms AS (SELECT term FROM rules UNION SELECT unnest(excludes) FROM rules)"""


@query(f"""
WITH {ORDER_NAMES_SQL}, {SEGMENTS_SQL}, {RULES_SQL}, {HITS_SQL},
seen AS (SELECT DISTINCT l_orderkey, part, sub, term FROM hits),
allowed AS (SELECT l_orderkey, part, sub, rule, result FROM seen s JOIN rules USING (term) WHERE NOT EXISTS (SELECT 1 FROM seen o WHERE o.l_orderkey = s.l_orderkey AND o.part = s.part AND o.sub = s.sub AND list_contains(excludes, o.term)))
SELECT l_orderkey, part::INTEGER AS part, sub::INTEGER AS sub, min(rule) AS rule, arg_min_null(result, rule) AS result FROM allowed GROUP BY ALL""")
def q_ordered_rules(spark, sf_dir):
    """the first of a table of ordered rules that a part of a name meets, with exclusions; a rule without a result stops the search."""
    part = load(spark, sf_dir, "part")
    adjective, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    distinct = part.where(adjective.isin("large", "small", "hot", "blue")).select("p_name").distinct()
    number = F.row_number().over(Window.orderBy("p_name"))  # a table of rules
    rules = distinct.select(number.cast("long").alias("rule"), F.col("p_name").alias("term"), F.array(F.concat(adjective, F.lit(" ring")), F.concat(F.lit("old "), noun)).alias("excludes"), F.when(noun != "rod", F.upper("p_name")).alias("result"))
    return dictionary.first_rules(dictionary.segments(order_names(spark, sf_dir), "l_orderkey", "name"), ["l_orderkey", "part", "sub"], rules)


CLASS_RULES_SQL = """
rules AS (
  SELECT DISTINCT split_part(p_name, ' ', 2) AS class, split_part(p_name, ' ', 2) AS term, 'word' AS kind FROM part
  UNION SELECT DISTINCT split_part(p_name, ' ', 2), p_name, 'harmless' FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'blue')
  UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'new ' || split_part(p_name, ' ', 2), 'veto' FROM part
  UNION SELECT DISTINCT 'metal', split_part(p_name, ' ', 2), 'word' FROM part WHERE split_part(p_name, ' ', 2) IN ('bolt', 'anvil', 'gear')),
terms AS (SELECT DISTINCT term FROM rules)"""


@query(f"""
WITH {ORDER_NAMES_SQL}, {SEGMENTS_SQL}, {CLASS_RULES_SQL}, {HITS_SQL},
held AS (
  SELECT DISTINCT h.l_orderkey, h.part, h.sub, class FROM hits h JOIN rules r ON h.term = r.term AND kind = 'word'
  WHERE NOT EXISTS (SELECT 1 FROM hits o JOIN rules q ON o.term = q.term AND q.kind = 'harmless' AND q.class = r.class WHERE o.l_orderkey = h.l_orderkey AND o.part = h.part AND o.sub = h.sub AND o.start <= h.start AND o.stop >= h.stop)
    AND NOT EXISTS (SELECT 1 FROM hits o JOIN rules q ON o.term = q.term AND q.kind = 'veto' AND q.class = r.class WHERE o.l_orderkey = h.l_orderkey AND o.part = h.part AND o.sub = h.sub))
SELECT l_orderkey, part::INTEGER AS part, sub::INTEGER AS sub, string_agg(class, '|' ORDER BY class) AS classes FROM held GROUP BY ALL""")
def q_word_classes(spark, sf_dir):
    """every class that the words of a name fall in, but for harmless uses of a word and for vetoes."""
    part = load(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("n"), "p_name")
    rule = lambda rows, cls, term, kind: rows.select(cls.alias("class"), term.alias("term"), F.lit(kind).alias("kind"))
    noun = F.col("n")
    rules = (
        rule(part, noun, noun, "word")
        .union(rule(part.where(F.col("a").isin("red", "blue")), noun, F.col("p_name"), "harmless"))
        .union(rule(part, noun, F.concat(F.lit("new "), noun), "veto"))
        .union(rule(part.where(noun.isin("bolt", "anvil", "gear")), F.lit("metal"), noun, "word"))
        .distinct()
    )
    keys = ["l_orderkey", "part", "sub"]
    return dictionary.classes(dictionary.segments(order_names(spark, sf_dir), "l_orderkey", "name"), keys, rules).withColumn("classes", F.array_join("classes", "|"))
