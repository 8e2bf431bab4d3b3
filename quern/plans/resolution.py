"""Queries that resolve names to entities: folding, spellings, containment, cascades, rewriting; and two versions of a rule held against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import folding
from quern.operators import dictionary, resolve
from quern.plans.catalogue import load, query
from quern.plans.names import ORDER_NAMES_SQL, STEM_SQL, order_names

DULL = ["inc", "llc", "co", "corp", "the", "and"]
GENERIC = ["RED", "BLUE", "RING", "BOLT"]


def folded_sql(c: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents(replace({c}, 'ß', 'ss'))), '[^A-Z0-9]+', ' ', 'g'))"


def endings_sql(c: str, which: str, again: bool) -> str:
    return f"regexp_replace({c}, '(?:\\s+(?:{'|'.join(folding.ENDINGS[which])})){'+' if again else ''}$', '')"


FIRMS_SQL = "firms AS (SELECT doc_id, array_to_string(string_split(coalesce(text, ''), ' ')[1:4], ' ') || ['', ' & Co.', ', Foods Inc.', ' COMPANY LLC', ' Group'][doc_id % 5 + 1] AS name FROM documents)"


def firms(spark, sf_dir):
    tails = F.array(*map(F.lit, ("", " & Co.", ", Foods Inc.", " COMPANY LLC", " Group")))
    name = F.concat(F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 4), " "), F.element_at(tails, (F.col("doc_id") % 5 + 1).cast("int")))
    return load(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


@query(f"""
WITH {FIRMS_SQL}, w AS (SELECT doc_id, name, {folded_sql("name")} AS form, trim(regexp_replace(upper(replace(name, 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS kept, {folded_sql("split_part(name, ',', 1)")} AS head FROM firms)
SELECT doc_id, {endings_sql("form", "exchange", True)} AS exchange, {endings_sql("form", "trade", False)} AS trade, replace({endings_sql("kept", "letters", True)}, ' ', '') AS letters, {endings_sql("head", "register", True)} AS register,
  trim(regexp_replace(lower(replace(name, '&', ' and ')), '\\s+', ' ', 'g')) AS plain, lower(replace(form, ' ', '')) AS tight FROM w""")
def q_firm_forms(spark, sf_dir):
    """six normal forms of the names that documents begin with, accents folded."""
    return firms(spark, sf_dir).select("doc_id", folding.firm_forms(F.col("name")).alias("f")).select("doc_id", "f.*")


@query(f"""
WITH {FIRMS_SQL}, w AS (SELECT doc_id, regexp_replace({folded_sql("name")}, '^THE ', '') AS bare FROM firms), p AS (SELECT doc_id, bare, {endings_sql("bare", "exchange", True)} AS short FROM w),
e AS (SELECT doc_id, list_filter(CASE WHEN bare = short THEN [bare] ELSE [bare, short] END, lambda x: length(x) >= 4 AND x NOT IN ('RED', 'BLUE', 'RING', 'BOLT')) AS phrases FROM p)
SELECT doc_id, array_to_string(phrases, '|') AS phrases, len(list_filter(phrases, lambda x: contains(' ' || {folded_sql("coalesce(text, '')")} || ' ', ' ' || x || ' '))) > 0 AS named FROM e JOIN documents USING (doc_id)""")
def q_brand_phrases(spark, sf_dir):
    """the phrases by which a text may name a brand, and whether it does, by whole words without accents."""
    phrased = firms(spark, sf_dir).select("doc_id", folding.brand_phrases(F.col("name"), GENERIC).alias("phrases"))
    joined = phrased.join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    named = folding.contains_any(F.coalesce("text", F.lit("")), F.col("phrases"))
    return joined.select("doc_id", F.array_join("phrases", "|").alias("phrases"), named.alias("named"))


LEGAL_SQL = """
legal AS (SELECT p_partkey, p_name || ' ' || p_type AS name, [p_name || ' ' || p_type || ' LLC', substr(p_name, 1, 3) || substr(p_name, 5) || ' Inc', split_part(p_name, ' ', 1), p_type || ' works', replace(p_name, 'o', 'ó') || ' ' || p_type,
  split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)][p_partkey % 6 + 1] AS other FROM part)"""


def legal_names(spark, sf_dir):
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    others = [F.concat_ws(" ", "p_name", "p_type", F.lit("LLC")), F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 100), F.lit(" Inc")), first, F.concat("p_type", F.lit(" works")), F.concat_ws(" ", F.replace("p_name", F.lit("o"), F.lit("ó")), "p_type"), F.concat_ws(" ", second, first)]
    return load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"), F.element_at(F.array(*others), (F.col("p_partkey") % 6 + 1).cast("int")).alias("other"))


def near_sql(a: str, b: str) -> str:
    return f"({a} = {b} OR (least(length({a}), length({b})) >= 6 AND levenshtein({a}, {b}) <= floor(greatest(length({a}), length({b})) * 0.34)))"


@query(f"""
WITH {LEGAL_SQL},
f AS (SELECT *, regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '', 'g') AS nt, regexp_replace(lower(strip_accents(other)), '[^a-z0-9]+', '', 'g') AS t, list_filter(string_split_regex(lower(strip_accents(name)), '[^a-z0-9]+'), lambda w: w <> '') AS nw,
  list_filter(string_split_regex(lower(strip_accents(other)), '[^a-z0-9]+'), lambda w: w <> '') AS tw FROM legal),
p AS (SELECT *, list_append(list_transform(range(1, len(nw) + 1), lambda k: array_to_string(nw[1:k], '')), nt) AS names, list_transform(range(1, len(tw) + 1), lambda k: array_to_string(tw[1:k], '')) AS starts,
  [t, array_to_string(list_distinct(list_filter(string_split_regex(lower(other), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ('inc', 'llc', 'co', 'corp', 'the', 'and'))), '')] AS whole FROM f),
u AS (SELECT p_partkey, name, other, nt, {folded_sql("name")} AS a, {folded_sql("other")} AS b, names, starts, [t, array_to_string(list_filter(tw, lambda w: length(w) >= 2 AND w NOT IN ('inc', 'llc', 'co', 'corp', 'the', 'and')), '')] AS whole FROM p),
x AS (SELECT p_partkey, bool_or({near_sql("n", "w")}) AS spelt FROM (SELECT p_partkey, unnest(names) AS n, whole FROM u), unnest(whole) AS v(w) WHERE n <> '' AND w <> '' GROUP BY p_partkey),
y AS (SELECT p_partkey, bool_or({near_sql("nt", "s")}) AS started FROM (SELECT p_partkey, nt, unnest(starts) AS s FROM u) WHERE s <> '' GROUP BY p_partkey),
z AS (SELECT p_partkey, replace(a, ' ', '') AS ra, replace(b, ' ', '') AS rb, a, b, length(replace(a, ' ', '')) AS la, length(replace(b, ' ', '')) AS lb, a IN ('RED', 'BLUE', 'RING', 'BOLT') AS ga, b IN ('RED', 'BLUE', 'RING', 'BOLT') AS gb FROM u)
SELECT p_partkey, coalesce(spelt, false) OR coalesce(started, false) AS spelling,
  ra = rb OR (la >= 5 AND lb >= 5 AND NOT ga AND NOT gb AND (starts_with(ra, rb) OR starts_with(rb, ra))) OR (la >= 3 AND NOT ga AND starts_with(b || ' ', a || ' ')) OR (lb >= 3 AND NOT gb AND starts_with(a || ' ', b || ' '))
  OR (la >= 4 AND NOT ga AND contains(' ' || b || ' ', ' ' || a || ' ')) OR (lb >= 4 AND NOT gb AND contains(' ' || a || ' ', ' ' || b || ' ')) AS agree
FROM z LEFT JOIN x USING (p_partkey) LEFT JOIN y USING (p_partkey)""")
def q_legal_names(spark, sf_dir):
    """Whether a name is a spelling of a legal name, and whether two records agree on the maker."""
    named = legal_names(spark, sf_dir)
    return named.select("p_partkey", folding.spells_legal_name(F.col("name"), F.col("other"), DULL).alias("spelling"), folding.names_agree(F.col("name"), F.col("other"), GENERIC).alias("agree"))


@query(f"""
WITH a AS (SELECT DISTINCT unnest(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+')) AS a FROM benchmark), b AS (SELECT DISTINCT unnest(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+')) AS b FROM conversations WHERE turn = 0)
SELECT a, count(*) AS n, min(levenshtein(a, b)) AS nearest, max(b) AS last FROM a JOIN b ON {near_sql("a", "b")} WHERE a <> '' AND b <> '' GROUP BY a""")
def q_spellings(spark, sf_dir):
    """for each word of the benchmark, its spellings among the words of all first turns, by an exact join on rare bigrams."""
    words = lambda df, c: df.select(F.explode(F.split(F.lower(folding.unmarked(F.col("text"))), "[^a-z0-9]+")).alias(c)).where(F.col(c) != "").distinct()
    benchmark, conversations = load(spark, sf_dir, "benchmark", "conversations")
    found = resolve.spellings(words(benchmark, "a"), words(conversations.where("turn = 0"), "b"))
    return found.groupBy("a").agg(F.count("*").alias("n"), F.min(F.levenshtein("a", "b")).cast("long").alias("nearest"), F.max("b").alias("last"))


PLAIN_SQL = "trim(regexp_replace(lower(regexp_replace(regexp_replace({}, '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
WITH k AS (SELECT item_id AS key_id, array_to_string(string_split({PLAIN_SQL.format("text")}, ' ')[2:3 + item_id % 2], ' ') AS key, CASE WHEN item_id % 3 = 0 THEN [string_split({PLAIN_SQL.format("text")}, ' ')[5]] ELSE [] END AS needs FROM benchmark),
n AS (SELECT doc_id, {PLAIN_SQL.format("s")} AS name, s FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\.\\s+')) AS s FROM documents)),
e AS (SELECT key_id, doc_id, 'exact' AS how FROM k JOIN n ON key = name WHERE key <> ''
  UNION ALL SELECT key_id, doc_id, 'contains' FROM k JOIN n ON contains(' ' || name || ' ', ' ' || key || ' ') AND key <> name WHERE key <> '' AND (contains(key, ' ') OR length(key) >= 7)
    AND len(list_filter(needs, lambda x: NOT contains(' ' || name || ' ', ' ' || x || ' '))) = 0 AND NOT contains(' ' || name || ' ', ' ' || key || ' free ')
    AND NOT regexp_matches(name, '(^| )(free of|free from|no|without|not) ' || key || '( |$)'))
SELECT key_id, how, count(*) AS n, count(DISTINCT doc_id) AS docs FROM e GROUP BY ALL""")
def q_widened(spark, sf_dir):
    """Beginnings of benchmark passages in the sentences of all documents, through the rarest word of each, with what they need and what denies them."""

    def plain(c):
        bare = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
        return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))

    benchmark, documents = load(spark, sf_dir, "benchmark", "documents")
    words = F.split(plain(F.col("text")), " ")
    keys = benchmark.select(F.col("item_id").alias("key_id"), F.array_join(F.slice(words, F.lit(2), (F.lit(2) + F.col("item_id") % 2).cast("int")), " ").alias("key"), F.when(F.col("item_id") % 3 == 0, F.array(F.get(words, F.lit(4)))).otherwise(F.array().cast("array<string>")).alias("needs"))
    sentences = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\.\s+")).alias("at", "s"))
    found = resolve.widened(keys, sentences.select(F.struct("doc_id", "at").alias("name_id"), plain(F.col("s")).alias("name")))
    return found.groupBy("key_id", "how").agg(F.count("*").alias("n"), F.count_distinct("name_id.doc_id").alias("docs"))


REWRITE_RULES = [(r"^(new|old|hot|cold|large|small) +", ""), (r"[, ]+(with|flavored)?$", ""), (r" +flavored,", ","), (r"^([a-z]+), with ", "$1 with "), (r"s( |,|$)", "$1")]


def rewrites_sql(c: str) -> str:
    for pattern, replacement in REWRITE_RULES:
        c = f"regexp_replace({c}, '{pattern}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    return c


@query(f"""
WITH RECURSIVE {ORDER_NAMES_SQL}, steps AS (SELECT l_orderkey, name AS text, 0 AS rounds, false AS settled FROM names
  UNION ALL SELECT l_orderkey, t, CASE WHEN t = text THEN rounds ELSE rounds + 1 END, t = text FROM (SELECT *, {rewrites_sql("text")} AS t FROM steps WHERE NOT settled AND rounds < 9))
SELECT l_orderkey, arg_max(text, rounds) AS text, max(rounds)::INTEGER AS rounds, bool_or(settled) AS settled FROM steps GROUP BY l_orderkey""")
def q_rewritten_names(spark, sf_dir):
    """names rewritten by a table of rules until nothing changes, at most eight rounds and one that shows it."""
    return order_names(spark, sf_dir).select("l_orderkey", resolve.rewritten(F.col("name"), REWRITE_RULES).alias("r")).select("l_orderkey", "r.*")


@query(f"""
WITH {ORDER_NAMES_SQL}, firms AS (SELECT p_name, min(p_partkey) AS target, count(*) AS parts FROM part GROUP BY p_name),
s AS (SELECT l_orderkey, name, trim(regexp_replace(name, '[, ]+$', '')) AS bare, array_to_string(list_transform(list_filter(string_split_regex(split_part(name, ',', 1), '[^a-z]+'), lambda w: w <> ''), lambda w: {STEM_SQL}), ' ') AS head FROM names),
one AS (SELECT l_orderkey, target FROM s JOIN firms ON bare = p_name),
two AS (SELECT l_orderkey, target FROM s JOIN firms ON head = p_name WHERE l_orderkey NOT IN (SELECT l_orderkey FROM one)),
three AS (SELECT DISTINCT l_orderkey, target FROM s JOIN firms ON contains(' ' || head || ' ', ' ' || p_name || ' ') WHERE l_orderkey NOT IN (SELECT l_orderkey FROM one UNION SELECT l_orderkey FROM two)),
four AS (SELECT DISTINCT l_orderkey, target FROM s JOIN firms ON split_part(p_name, ' ', 2) = split_part(head, ' ', -1) AND parts > 40 WHERE l_orderkey NOT IN (SELECT l_orderkey FROM one UNION SELECT l_orderkey FROM two UNION SELECT l_orderkey FROM three)),
every AS (SELECT *, 'exact' AS rung FROM one UNION ALL SELECT *, 'head' FROM two UNION ALL SELECT *, 'contained' FROM three UNION ALL SELECT *, 'kind' FROM four)
SELECT l_orderkey, coalesce(rung, 'none') AS rung, CASE WHEN count(target) = 1 THEN min(target) END AS target, CASE WHEN count(target) > 1 THEN count(target) END AS ambiguous FROM s LEFT JOIN every USING (l_orderkey) GROUP BY l_orderkey, rung""")
def q_name_cascade(spark, sf_dir):
    """Every order's name resolved by the first of four rungs that finds a part, or ambiguous at it, or by none."""
    part = load(spark, sf_dir, "part")
    known = part.groupBy("p_name").agg(F.min("p_partkey").alias("target"), F.count("*").alias("parts"))
    known = resolve.few(known, known.count())
    head = F.array_join(dictionary.stems(F.split("name", ",")[0]), " ")
    rows = order_names(spark, sf_dir).select("l_orderkey", F.trim(F.regexp_replace("name", "[, ]+$", "")).alias("bare"), head.alias("head"))

    def contained(left):
        found = left.select("l_orderkey", F.split("head", " ").alias("words"))
        return dictionary.hits(found, ["l_orderkey"], known.select(F.col("p_name").alias("term"))).join(known, F.col("term") == F.col("p_name"))

    rungs = [
        ("exact", lambda left: left.join(known, F.col("bare") == F.col("p_name"))),
        ("head", lambda left: left.join(known, F.col("head") == F.col("p_name"))),
        ("contained", contained),
        ("kind", lambda left: left.join(known.where("parts > 40").select(F.split("p_name", " ")[1].alias("noun"), "target"), F.substring_index("head", " ", -1) == F.col("noun"))),
    ]
    return resolve.cascade(spark, rows, "l_orderkey", rungs)
