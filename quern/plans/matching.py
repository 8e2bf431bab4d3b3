"""More catalogue queries: entity matching, search dispatch, shelves, sections, nutrition, censuses and changes of tables. Docstrings name the operators that a query stands for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import barcodes, text
from quern.plans.catalogue import KEY_SQL, load, query


def check_sql(body: str) -> str:
    return f"((10 - (list_sum(list_transform(range(length({body})), lambda i: substr({body}, (length({body}) - i)::INT, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10)) % 10)"


def valid_sql(code: str) -> str:
    return f"(length({code}) >= 8 AND {check_sql(f'substr({code}, 1, length({code}) - 1)')} = right({code}, 1)::INT)"


def wide_sql(c: str) -> str:
    d = lambda a, n: f"substr({c}, {a}, {n})"
    return f"""(CASE WHEN regexp_full_match({c}, '[01][0-9]{{7}}') THEN {d(1, 1)} || CASE WHEN {d(7, 1)} IN ('0', '1', '2') THEN {d(2, 2)} || {d(7, 1)} || '0000' || {d(4, 3)} WHEN {d(7, 1)} = '3' THEN {d(2, 3)} || '00000' || {d(5, 2)}
      WHEN {d(7, 1)} = '4' THEN {d(2, 4)} || '00000' || {d(6, 1)} ELSE {d(2, 5)} || '0000' || {d(7, 1)} END || {d(8, 1)} END)"""


RAW_SQL = f"""
k AS (SELECT p_partkey, p_partkey % 7 AS kind, lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') AS six, lpad((p_partkey * 1234567 % 10000000000)::VARCHAR, 10, '0') AS ten, lpad((p_partkey * 99991 % 1000000000000)::VARCHAR, 12, '0') AS twelve FROM part),
r AS (SELECT p_partkey, CASE kind WHEN 0 THEN '0' || six || {check_sql("substr(" + wide_sql("('0' || six || '0')") + ", 1, 11)")}::VARCHAR WHEN 1 THEN '9' || substr(ten, 1, 7) WHEN 2 THEN ten WHEN 3 THEN ten || {check_sql("ten")}::VARCHAR
  WHEN 4 THEN '0' || twelve || {check_sql("twelve")}::VARCHAR WHEN 5 THEN 'none' ELSE substr(twelve, 1, 6) || '-' || substr(twelve, 7) END AS raw FROM k)"""


def raw_codes(part):
    k = F.col("p_partkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    six, ten, twelve = pad(k * 7919 % 1_000_000, 6), pad(k * 1_234_567 % 10_000_000_000, 10), pad(k * 99_991 % 1_000_000_000_000, 12)
    short = F.concat(F.lit("0"), six)
    body = F.substring(barcodes.expand_upc_e(F.concat(short, F.lit("0"))), 1, 11)
    digit = lambda c: barcodes.check_digit_of(c).cast("string")
    kinds = [F.concat(short, digit(body)), F.concat(F.lit("9"), F.substring(ten, 1, 7)), ten, F.concat(ten, digit(ten)), F.concat(F.lit("0"), twelve, digit(twelve)), F.lit("none")]
    raw = F.concat(F.substring(twelve, 1, 6), F.lit("-"), F.substring(twelve, 7, 6))
    return part.select("p_partkey", F.coalesce(*(F.when(k % 7 == n, c) for n, c in enumerate(kinds)), raw).alias("raw"))


JUDGED_SQL = f"""
b AS (SELECT *, CASE WHEN length(digits) = 14 AND digits[1] = '0' THEN substr(digits, 2) ELSE digits END AS bare FROM (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM r)), w AS (SELECT *, {wide_sql("bare")} AS wide, lpad(bare, 13, '0') AS padded FROM b),
c AS (SELECT *, CASE WHEN length(bare) = 8 AND wide IS NOT NULL AND {valid_sql("wide")} THEN '0' || wide WHEN length(bare) BETWEEN 9 AND 11 AND {valid_sql("padded")} THEN padded WHEN length(bare) = 12 THEN '0' || bare ELSE bare END AS code FROM w),
j AS (SELECT *, CASE WHEN code = '' THEN 'empty' WHEN length(code) NOT IN (8, 13) THEN 'bad_length' WHEN NOT {valid_sql("code")} THEN 'bad_check_digit' WHEN length(code) = 13 AND (code LIKE '02%' OR code LIKE '04%' OR code LIKE '2%') THEN 'restricted' END AS reason FROM c)"""

COUNTRY_SQL = "CASE " + " ".join(f"WHEN substr(code, 1, 3)::INT BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in barcodes.PREFIX_COUNTRIES) + " END"


@query(f"WITH {RAW_SQL}, {JUDGED_SQL} SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN code END AS barcode, CASE WHEN reason IS NULL AND length(code) = 13 THEN {COUNTRY_SQL} END AS country FROM j")
def q_barcode_forms(spark, sf_dir):
    """zero-suppressed codes, 8 to 14 digits, none at all; country of the prefix."""
    found = raw_codes(load(spark, sf_dir, "part")).select("p_partkey", barcodes.normalize_barcode(F.col("raw")).alias("b"))
    return found.select("p_partkey", "b.reason", F.col("b.code").alias("barcode"), F.when(F.length("b.code") == 13, barcodes.country_of(F.col("b.code"))).alias("country"))


@query(f"""
WITH {RAW_SQL}, {JUDGED_SQL}, known AS (SELECT p_partkey, code FROM j WHERE reason IS NULL AND length(code) = 13),
n AS (SELECT s_suppkey, 'Lot 12, UPC: ' || code || ' and 123456789012, call 5551234' AS notice FROM supplier JOIN known ON p_partkey = s_suppkey * 7),
x AS (SELECT s_suppkey, unnest(list_filter(regexp_extract_all(notice, '[0-9]+'), lambda d: length(d) IN (12, 13))) AS d FROM n)
SELECT DISTINCT s_suppkey, known.p_partkey FROM x JOIN known ON lpad(d, 13, '0') = code""")
def q_barcodes_in_text(spark, sf_dir):
    """Codes in running text, put into their one form, joined by equality."""
    part, supplier = load(spark, sf_dir, "part", "supplier")
    known = raw_codes(part).select("p_partkey", barcodes.normalize_barcode(F.col("raw"))["code"].alias("code")).where(F.length("code") == 13)
    named = supplier.join(known, F.col("s_suppkey") * 7 == F.col("p_partkey"))
    notices = named.select("s_suppkey", F.concat(F.lit("Lot 12, UPC: "), "code", F.lit(" and 123456789012, call 5551234")).alias("notice"))
    runs = notices.select("s_suppkey", F.explode(F.regexp_extract_all("notice", F.lit(r"(?<!\d)(\d{12,13})(?!\d)"), 1)).alias("run"))
    read = runs.select("s_suppkey", barcodes.normalize_barcode(F.col("run"))["code"].alias("read"))
    return read.join(known, F.col("read") == F.col("code")).select("s_suppkey", "p_partkey").distinct()


QUERIES_SQL = "VALUES (1, 'red bolt'), (2, 'Brand#12 gear'), (3, 'the large anvil brand'), (4, 'and the')"


@query(f"""
WITH q AS (SELECT col0 AS query_id, list_filter(string_split_regex(lower(col1), '[^a-z0-9]+'), lambda w: length(w) >= 2) AS ws FROM ({QUERIES_SQL})),
t AS (SELECT query_id, CASE WHEN len(list_filter(ws, lambda w: w NOT IN ('and', 'the'))) > 0 THEN list_filter(ws, lambda w: w NOT IN ('and', 'the')) ELSE ws END AS tokens FROM q),
m AS (SELECT query_id, p_brand, tokens, list_filter(tokens, lambda w: contains(lower(p_brand), w)) AS matched FROM t, (SELECT DISTINCT p_brand FROM part)),
best AS (SELECT *, max(len(matched)) OVER (PARTITION BY query_id) AS best FROM m), win AS (SELECT * FROM best WHERE best > 0 AND len(matched) = best),
a AS (SELECT query_id, list(w) AS accounted FROM (SELECT query_id, w, count(*) AS c FROM (SELECT query_id, unnest(matched) AS w FROM win) GROUP BY ALL) y WHERE c = (SELECT count(*) FROM win x WHERE x.query_id = y.query_id) GROUP BY query_id)
SELECT DISTINCT t.query_id, p_partkey FROM t LEFT JOIN a USING (query_id), part WHERE len(list_filter(tokens, lambda w: NOT contains(lower(p_name), w))) = 0
  OR EXISTS (SELECT 1 FROM win WHERE win.query_id = t.query_id AND win.p_brand = part.p_brand) AND len(list_filter(tokens, lambda w: NOT contains(lower(p_name), w) AND NOT list_contains(a.accounted, w))) = 0""")
def q_brand_search(spark, sf_dir):
    """For a stated set of queries, the brands that most tokens name; products of these that hold the other tokens, and products that hold all."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), "p_brand")
    asked = spark.createDataFrame([(1, "red bolt"), (2, "Brand#12 gear"), (3, "the large anvil brand"), (4, "and the")], "query_id int, q string").select("query_id", text.tokens(F.col("q")).alias("tokens"))
    brands = part.select("p_brand").distinct()
    scored = brands.join(F.broadcast(asked)).select("query_id", "p_brand", F.filter("tokens", lambda w: F.lower("p_brand").contains(w)).alias("matched"))  # four queries
    best = scored.groupBy(F.col("query_id").alias("q")).agg(F.max(F.size("matched")).alias("best")).where("best > 0")
    winners = scored.join(best, (F.col("query_id") == F.col("q")) & (F.size("matched") == F.col("best"))).select("query_id", "p_brand", "matched")
    folded = winners.groupBy("query_id").agg(F.collect_list("matched").alias("all"), F.collect_set("p_brand").alias("brands"))
    folded = folded.select("query_id", "brands", F.aggregate(F.slice("all", 2, 1 << 20), F.col("all")[0], lambda a, b: F.array_intersect(a, b)).alias("accounted"))
    plan = asked.join(folded, "query_id", "left")
    misses = lambda words: F.size(F.filter(words, lambda w: ~F.col("name").contains(w))) == 0
    by_brand = F.coalesce(F.array_contains("brands", F.col("p_brand")), F.lit(False)) & misses(F.array_except("tokens", F.coalesce("accounted", F.array().cast("array<string>"))))
    return part.join(F.broadcast(plan), misses(F.col("tokens")) | by_brand).select("query_id", "p_partkey").distinct()


@query(f"""
WITH c AS (SELECT s_suppkey AS company, (s_suppkey - 1) // 3 AS parent, {KEY_SQL.format(x="s_name")} AS key FROM supplier),
n AS (SELECT c_custkey AS notice, c_custkey % 150 AS a, c_custkey * 7 % 150 AS b FROM customer), k AS (SELECT notice, a AS s FROM n UNION SELECT notice, b FROM n WHERE notice % 3 = 0),
f AS (SELECT notice, list_sort(list(DISTINCT company)) AS found FROM k JOIN c ON company = s GROUP BY notice)
SELECT n.notice, CASE WHEN found IS NULL THEN 'unknown' WHEN len(found) = 1 THEN 'unique' WHEN (SELECT parent FROM c WHERE company = found[2]) = found[1] AND found[2] > 0 THEN 'ancestor' ELSE 'ambiguous' END AS outcome,
  CASE WHEN len(found) = 1 OR (SELECT parent FROM c WHERE company = found[2]) = found[1] AND found[2] > 0 THEN found[1] END AS company FROM n LEFT JOIN f USING (notice)""")
def q_firms(spark, sf_dir):
    """Firms in notices, under several names and with places, resolved to one company, to the parent of two, or not."""
    customer, supplier = load(spark, sf_dir, "customer", "supplier")
    named = lambda n: F.concat(F.lit("Supplier#"), F.lpad(n.cast("string"), 9, "0"))
    k = F.col("c_custkey")
    firm = F.concat(named(k % 150), F.lit(", Inc. of Austin, TX"), F.when(k % 3 == 0, F.concat(F.lit(" d/b/a "), named(k * 7 % 150), F.lit(" LLC"))).otherwise(F.lit("")))
    companies = supplier.select(F.col("s_suppkey").alias("company"), F.when(F.col("s_suppkey") > 0, F.floor((F.col("s_suppkey") - 1) / 3)).alias("parent"), text.brand_key(F.col("s_name")).alias("key"))
    keys = customer.select(k.alias("notice"), F.explode(text.firm_keys(firm)).alias("key"))
    met = keys.join(companies, "key").groupBy("notice").agg(F.array_sort(F.collect_set(F.struct("company", "parent"))).alias("found"))
    rows = customer.select(k.alias("notice")).join(met, "notice", "left")
    one, child = F.size("found") == 1, F.get("found", F.lit(1))["parent"] == F.col("found")[0]["company"]
    outcome = F.when(F.col("found").isNull(), "unknown").when(one, "unique").when(F.coalesce(child, F.lit(False)), "ancestor").otherwise("ambiguous")
    return rows.select("notice", outcome.alias("outcome"), F.when(outcome.isin("unique", "ancestor"), F.col("found")[0]["company"]).alias("company"))


@query("""
WITH c AS (SELECT c_custkey, unnest([c_custkey * 2, c_custkey * 3, c_custkey % 70]) AS candidate, unnest([0, 1, 2]) AS place FROM customer)
SELECT c_custkey, arg_min(s_suppkey, place) AS s_suppkey, min(place)::INT AS place FROM c JOIN supplier ON candidate = s_suppkey GROUP BY c_custkey""")
def q_first_candidate(spark, sf_dir):
    """Of several candidates in order, the first that exists."""
    customer, supplier = load(spark, sf_dir, "customer", "supplier")
    k = F.col("c_custkey")
    tried = customer.select("c_custkey", F.posexplode(F.array(k * 2, k * 3, k % 70)).alias("place", "s_suppkey"))
    return tried.join(supplier.select("s_suppkey"), "s_suppkey").groupBy("c_custkey").agg(F.min_by("s_suppkey", "place").alias("s_suppkey"), F.min("place").alias("place"))


@query("""
WITH o AS (SELECT DISTINCT c_nationkey AS owner, unnest(string_split(p_name, ' ')) AS token FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49)
SELECT p_partkey, nation AS n_nationkey, CASE WHEN p_brand = 'Brand#' || nation THEN 'exact' WHEN n = 2 THEN 'owner_lists' WHEN n = 1 THEN 'shared_token' ELSE 'none' END AS evidence
FROM (SELECT p_partkey, p_brand, (p_partkey % 25)::INT AS nation, count(o.token) AS n FROM part LEFT JOIN o ON o.owner = p_partkey % 25 AND list_contains(string_split(p_name, ' '), o.token) GROUP BY ALL)""")
def q_owner_evidence(spark, sf_dir):
    """The words that an owner's products use, over the whole table, as evidence on a ladder."""
    lineitem, orders, customer, part, nation = load(spark, sf_dir, "lineitem", "orders", "customer", "part", "nation")
    sold = lineitem.where("l_quantity > 49").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    used = sold.select(F.col("c_nationkey").alias("owner"), F.explode(F.split("p_name", " ")).alias("used")).distinct()
    rows = part.withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int")).join(nation.select("n_nationkey"), "n_nationkey")
    words = rows.select("p_partkey", "p_brand", "n_nationkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    met = words.join(used, (F.col("n_nationkey") == F.col("owner")) & (F.col("word") == F.col("used")), "left")
    rows = met.groupBy("p_partkey", "p_brand", "n_nationkey").agg(F.count("used").alias("n"))
    shared = F.col("n")
    evidence = F.when(F.col("p_brand") == F.concat(F.lit("Brand#"), "n_nationkey"), "exact").when(shared == 2, "owner_lists").when(shared == 1, "shared_token").otherwise("none")
    return rows.select("p_partkey", "n_nationkey", evidence.alias("evidence"))


@query("""
WITH t AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws FROM part WHERE p_size <= 25), c AS (SELECT DISTINCT p_name AS other, string_split(p_name, ' ') AS os FROM part WHERE p_size > 25),
s AS (SELECT p_partkey, other, len(list_intersect(ws, os)) / len(ws) AS score FROM t JOIN c ON list_has_any(ws, os))
SELECT p_partkey, other, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS k FROM s) WHERE k = 1""")
def q_best_name(spark, sf_dir):
    """The name that holds most of another's words; names meet by words, not all by all."""
    part = load(spark, sf_dir, "part")
    names = part.where("p_size > 25").select(F.col("p_name").alias("other")).distinct().withColumn("word", F.explode(F.array_distinct(F.split("other", " "))))
    mine = part.where("p_size <= 25").select("p_name").distinct().withColumn("n", F.size(F.split("p_name", " "))).withColumn("word", F.explode(F.array_distinct(F.split("p_name", " "))))
    scored = mine.join(names, "word").groupBy("p_name", "n", "other").agg(F.count("*").alias("shared")).withColumn("score", F.col("shared") / F.col("n"))
    best = scored.groupBy("p_name").agg(F.min_by(F.struct("other", "score"), F.struct(-F.col("score"), F.col("other"))).alias("b"))
    return part.where("p_size <= 25").select("p_partkey", "p_name").join(best, "p_name").select("p_partkey", "b.other", "b.score")


@query("""
WITH RECURSIVE up(node, ancestor, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT node, (ancestor - 1) // 3, depth + 1 FROM up WHERE ancestor > 0 AND depth < 5),
r AS (SELECT node, arg_max(ancestor, depth) AS top FROM up GROUP BY node)
SELECT o_orderkey, CASE WHEN o_custkey = o_orderkey % 1000 THEN 'firm_is_brand' WHEN EXISTS (SELECT 1 FROM up WHERE node = o_custkey AND ancestor = o_orderkey % 40) THEN 'owner_brand' ELSE 'named_brand' END AS method, top FROM orders JOIN r ON node = o_custkey""")
def q_relabelled_links(spark, sf_dir):
    """Links relabelled where the issuer is the brand itself or below its owner; root of the issuer's tree."""
    from quern.operators.relational import ancestors

    orders, customer = load(spark, sf_dir, "orders", "customer")
    tree = customer.select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") > 0, F.floor((F.col("c_custkey") - 1) / 3)).alias("parent"))
    family = ancestors(tree, 5).groupBy("node").agg(F.collect_set("ancestor").alias("family"), F.max_by("ancestor", "depth").alias("top"))
    brand = F.col("o_orderkey") % 40
    method = F.when(F.col("o_custkey") == F.col("o_orderkey") % 1000, "firm_is_brand").when(F.array_contains("family", brand), "owner_brand").otherwise("named_brand")
    return orders.join(family, F.col("o_custkey") == F.col("node")).select("o_orderkey", method.alias("method"), "top")


@query("""
WITH d AS (SELECT * FROM (VALUES ('bolt', 'metal'), ('gear', 'steel'), ('red', 'dye')) AS v(name, kind))
SELECT p_partkey, coalesce(a.kind, b.kind, 'none') AS kind FROM part LEFT JOIN d a ON a.name = string_split(p_name, ' ')[2] LEFT JOIN d b ON b.name = string_split(p_name, ' ')[1]""")
def q_fallback_lookup(spark, sf_dir):
    """A small literal table looked up by the whole name's head and, failing that, by its base."""
    table = spark.createDataFrame([("bolt", "metal"), ("gear", "steel"), ("red", "dye")], "name string, kind string")
    words = F.split("p_name", " ")
    rows = load(spark, sf_dir, "part").select("p_partkey", words[1].alias("head"), words[0].alias("base"))
    for key in ("head", "base"):
        rows = rows.join(F.broadcast(table.toDF(f"{key}_name", f"{key}_kind")), F.col(key) == F.col(f"{key}_name"), "left")
    return rows.select("p_partkey", F.coalesce("head_kind", "base_kind", F.lit("none")).alias("kind"))


@query("""
WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part), f AS (SELECT * FROM a WHERE k <= 6),
b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM f))
SELECT 'dearest' AS shelf, p_brand, p_partkey, k::INT AS place FROM f UNION ALL SELECT 'largest', p_brand, p_partkey, k::INT FROM b WHERE k <= 6""")
def q_shelves(spark, sf_dir):
    """Two shelves of six a brand; the second has none of the first's."""
    part = load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    first = part.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("place <= 6")
    left = part.join(first.select("p_partkey"), "p_partkey", "left_anti")
    second = left.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))).where("place <= 6")
    shelf = lambda df, name: df.select(F.lit(name).alias("shelf"), "p_brand", "p_partkey", "place")
    return shelf(first, "dearest").union(shelf(second, "largest"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, bool_or(l_discount > 0.09) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS trace FROM lineitem""")
def q_sections(spark, sf_dir):
    """Once a marker is seen, all later items of the list are in its section."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bool_or(F.col("l_discount") > 0.09).over(place).alias("trace"))


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 500 AS fat, l_quantity AS carbs, l_tax * 400 AS protein, l_quantity * 1.03 - 3 AS sugar, l_discount * 520 - 2 AS saturated, l_extendedprice / 60 AS kcal, (l_partkey % 50)::DOUBLE AS sodium, CASE WHEN l_suppkey % 3 = 0 THEN 30.0 WHEN l_suppkey % 3 = 1 THEN 900.0 END AS serving FROM lineitem),
a AS (SELECT *, serving IS NOT NULL AND serving > 500 AS whole_pack, CASE WHEN serving <= 500 THEN serving / 100 END AS factor, fat + carbs + protein > 105 OR greatest(fat, carbs, protein, sugar, saturated) > 100 AS impossible, 9 * fat + 4 * protein + 4 * sugar AS least_kcal FROM n),
b AS (SELECT *, CASE WHEN kcal > 950 THEN 'kilojoules' WHEN least_kcal > 50 AND kcal < 0.75 * least_kcal THEN 'too_few_calories' END AS kcal_note FROM a)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, impossible, concat_ws(',', CASE WHEN whole_pack THEN 'serving' END, CASE WHEN sodium > 40 THEN 'sodium' END, kcal_note, CASE WHEN saturated > fat + 0.5 THEN 'saturated' END, CASE WHEN sugar > carbs + 1 THEN 'sugar' END) AS notes,
  CASE WHEN impossible OR kcal_note IS NOT NULL THEN NULL WHEN factor IS NULL THEN kcal ELSE floor(kcal * factor * 100 + 0.5) / 100 END AS calories, CASE WHEN NOT impossible AND sodium <= 40 THEN floor(sodium * 1000 * coalesce(factor, 1) * 100 + 0.5) / 100 END AS sodium_mg FROM b""")
def q_nutrients(spark, sf_dir):
    """values scaled to a plausible serving, what can't be left blank, and notes on each."""
    c = F.col
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_discount") * 500).alias("fat"), c("l_quantity").alias("carbs"), (c("l_tax") * 400).alias("protein"), (c("l_quantity") * 1.03 - 3).alias("sugar"), (c("l_discount") * 520 - 2).alias("saturated"),
        (c("l_extendedprice") / 60).alias("kcal"), (c("l_partkey") % 50).cast("double").alias("sodium"), F.when(c("l_suppkey") % 3 == 0, 30.0).when(c("l_suppkey") % 3 == 1, 900.0).alias("serving"))
    factor = F.when(c("serving") <= 500, c("serving") / 100)
    impossible = (c("fat") + c("carbs") + c("protein") > 105) | (F.greatest("fat", "carbs", "protein", "sugar", "saturated") > 100)
    least = 9 * c("fat") + 4 * c("protein") + 4 * c("sugar")
    kcal_note = F.when(c("kcal") > 950, "kilojoules").when((least > 50) & (c("kcal") < 0.75 * least), "too_few_calories")
    notes = F.concat_ws(",", F.when(c("serving") > 500, "serving"), F.when(c("sodium") > 40, "sodium"), kcal_note, F.when(c("saturated") > c("fat") + 0.5, "saturated"), F.when(c("sugar") > c("carbs") + 1, "sugar"))
    calories = F.when(impossible | kcal_note.isNotNull(), None).when(factor.isNull(), c("kcal")).otherwise(text.round_half_up(c("kcal") * factor))
    sodium = F.when(~impossible & (c("sodium") <= 40), text.round_half_up(c("sodium") * 1000 * F.coalesce(factor, F.lit(1.0))))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", impossible.alias("impossible"), notes.alias("notes"), calories.alias("calories"), sodium.alias("sodium_mg"))


@query("""
WITH p AS (SELECT page_id, nullif(trim(CASE WHEN page_id % 5 = 0 THEN ' ' ELSE url END), '') AS image, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'package' WHEN 2 THEN 'nutrition_panel' ELSE 'logo' END AS kind, CASE WHEN page_id % 3 = 0 THEN 'partial' ELSE 'disclosed' END AS state, page_id % 7 <> 0 AS published FROM pages),
u AS (SELECT *, image IS NOT NULL AND (kind IS NULL OR kind = 'package') AS usable FROM p)
SELECT page_id, concat_ws(',', CASE WHEN NOT usable THEN 'front_of_package' END, CASE WHEN state = 'partial' THEN 'ingredient_panel' END, CASE WHEN NOT published AND usable THEN 'read_name_from_existing_photo' END) AS tasks FROM u""")
def q_contributions(spark, sf_dir):
    """What is wanted for a row, in shelf order, from shared predicates."""
    k = F.col("page_id")
    image = F.nullif(F.trim(F.when(k % 5 == 0, " ").otherwise(F.col("url"))), F.lit(""))
    kind = F.when(k % 4 == 1, "package").when(k % 4 == 2, "nutrition_panel").when(k % 4 == 3, "logo")
    usable, published = image.isNotNull() & (kind.isNull() | (kind == "package")), k % 7 != 0
    tasks = F.concat_ws(",", F.when(~usable, "front_of_package"), F.when(k % 3 == 0, "ingredient_panel"), F.when(~published & usable, "read_name_from_existing_photo"))
    return load(spark, sf_dir, "pages").select("page_id", tasks.alias("tasks"))


@query(r"""
SELECT regexp_extract(url, '^[a-z]+://([^/:?]+)', 1) AS host, count(*) AS n, regexp_extract(url, '^[a-z]+://([^/:?]+)', 1) LIKE '%.example.com' AS allowed, count(*) FILTER (WHERE html NOT LIKE '%<title>%') AS untitled FROM pages WHERE url IS NOT NULL GROUP BY 1, 3""")
def q_hosts(spark, sf_dir):
    """P25: hosts of addresses, which of them are allowed, counted."""
    pages = load(spark, sf_dir, "pages").where("url IS NOT NULL").withColumn("host", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    return pages.groupBy("host").agg(F.count("*").alias("n"), F.first(F.col("host").endswith(".example.com")).alias("allowed"), F.count_if(~F.col("html").contains("<title>")).alias("untitled"))


@query("""
SELECT p_partkey, (CASE WHEN length(p_name) < 9 THEN 1 ELSE 0 END + CASE WHEN NOT contains(p_name, ' ') THEN 2 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 4 ELSE 0 END)::INT AS weakness FROM (SELECT p_partkey, p_name FROM part) WHERE starts_with(lower(p_name), 'r') OR length(p_name) BETWEEN 8 AND 9 OR regexp_matches(p_name, 'gear$') AND p_partkey NOT IN (1, 2, 3)""")
def q_weak_names(spark, sf_dir):
    """Prefix, list, pattern and length predicates; faults of a name as bits."""
    name, k = F.col("p_name"), F.col("p_partkey")
    shown = F.when(k % 4 == 0, F.upper(name)).otherwise(name)
    bit = lambda fault, b: F.when(fault, b).otherwise(0)
    weak = bit(F.length(shown) < 9, 1).bitwiseOR(bit(~shown.contains(" "), 2)).bitwiseOR(bit(shown == F.upper(shown), 4))
    return load(spark, sf_dir, "part").where(F.lower(name).startswith("r") | F.length(name).between(8, 9) | name.rlike("gear$") & ~k.isin(1, 2, 3)).select("p_partkey", weak.alias("weakness"))


@query("""
WITH v AS (SELECT p_type AS type, p_name, p_brand, p_size FROM part), m AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS noun FROM part WHERE p_size > 40)
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'is_company' WHEN string_split(p_name, ' ')[2] IN (SELECT noun FROM m) AND p_type = 'SMALL' THEN 'category_word' WHEN length(p_name) < 8 THEN 'no_identifier' ELSE 'named' END AS gate FROM part""")
def q_withholding(spark, sf_dir):
    """Rows withheld for a name that is the firm's, a word of a vocabulary, or too little."""
    part = load(spark, sf_dir, "part")
    nouns = part.where("p_size > 40").select(F.split("p_name", " ")[1].alias("noun")).distinct()
    rows = part.withColumn("own", F.when(F.col("p_size") % 9 == 0, F.upper("p_brand")).otherwise(F.col("p_name"))).join(nouns, F.split("p_name", " ")[1] == F.col("noun"), "left")
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    gate = F.when(plain("own") == plain("p_brand"), "is_company").when(F.col("noun").isNotNull() & (F.col("p_type") == "SMALL"), "category_word").when(F.length("p_name") < 8, "no_identifier").otherwise("named")
    return rows.select("p_partkey", gate.alias("gate"))


@query(r"""
WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 5) AS ws FROM benchmark)
SELECT item_id, len(ws) <> len(list_distinct(ws)) AS repeats, len(ws)::INT AS n FROM w""")
def q_repeated_words(spark, sf_dir):
    """A10: whether a text repeats a word of five letters or more."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 5)
    return load(spark, sf_dir, "benchmark").select("item_id", (F.size(words) != F.size(F.array_distinct(words))).alias("repeats"), F.size(words).alias("n"))


@query("""
WITH page AS (SELECT * FROM part WHERE p_type = 'PROMO' ORDER BY p_retailprice DESC, p_partkey LIMIT 24 OFFSET 24)
SELECT count(*) AS shown, count(*) FILTER (WHERE p_size > 25) AS large, count(*) FILTER (WHERE contains(p_name, 'gear')) AS gears FROM page""")
def q_page_tallies(spark, sf_dir):
    """Tallies over the rows of one page."""
    page = load(spark, sf_dir, "part").where("p_type = 'PROMO'").orderBy(F.desc("p_retailprice"), "p_partkey").offset(24).limit(24)
    return page.agg(F.count("*").alias("shown"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.col("p_name").contains("gear")).alias("gears"))


@query("""
WITH e AS (SELECT 'k' AS field, props::JSON->>'k' AS v FROM events UNION ALL SELECT 'missing', props::JSON->>'missing' FROM events)
SELECT field, count(v) AS present, count(DISTINCT v) AS values_, coalesce(max(v::INT), -1) AS highest FROM e GROUP BY field""")
def q_field_census(spark, sf_dir):
    """Which fields of nested records are present, and in what variety."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.get_json_object("props", f"$.{f}").alias("v")) for f in ("k", "missing")))
    rows = load(spark, sf_dir, "events").select(F.explode(fields).alias("e")).select("e.*")
    return rows.groupBy("field").agg(F.count("v").alias("present"), F.countDistinct("v").alias("values_"), F.coalesce(F.max(F.col("v").cast("int")), F.lit(-1)).alias("highest"))


@query("""
SELECT p_name AS phrase, count(DISTINCT p_brand) AS brands, count(*) AS products, array_to_string(list_sort(list(DISTINCT p_brand))[1:2], ',') AS samples FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2""")
def q_phrase_samples(spark, sf_dir):
    """Brands of each phrase, with two samples."""
    held = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("phrase")).agg(F.countDistinct("p_brand").alias("brands"), F.count("*").alias("products"), F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 2), ",").alias("samples"))
    return held.where("brands >= 2")


@query("""
WITH c AS (SELECT unnest(string_split(p_name, ' ')) AS class, p_partkey, p_size FROM part), o AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT class, count(*) AS names, sum(p_size)::BIGINT AS size, coalesce(sum(n), 0)::BIGINT AS products FROM c LEFT JOIN o ON l_partkey = p_partkey GROUP BY class""")
def q_class_totals(spark, sf_dir):
    """Totals of each of the classes that a row belongs to."""
    part, lineitem = load(spark, sf_dir, "part", "lineitem")
    n = lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    rows = part.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.explode(F.split("p_name", " ")).alias("class"), "p_size", "n")
    return rows.groupBy("class").agg(F.count("*").alias("names"), F.sum("p_size").alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("products"))


@query("""
WITH b AS (SELECT l_orderkey AS k, l_returnflag AS c FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), a AS (SELECT l_orderkey AS k, l_returnflag AS c FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
SELECT coalesce(a.c, b.c) AS class, count(*) FILTER (WHERE b.c IS NULL) AS added, count(*) FILTER (WHERE a.c IS NULL) AS removed FROM a FULL JOIN b ON a.k = b.k AND a.c = b.c GROUP BY 1""")
def q_change_classes(spark, sf_dir):
    """What each class gains and loses between two versions of a set."""
    lineitem = load(spark, sf_dir, "lineitem")
    held = lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_returnflag"))).alias("before"), F.collect_set(F.when(F.col("l_linenumber") > 1, F.col("l_returnflag"))).alias("after"))
    part = lambda a, b, added: held.select(F.explode(F.array_except(a, b)).alias("class"), F.lit(added).alias("added"))
    every = lineitem.select(F.col("l_returnflag").alias("class")).distinct().select("class", F.lit(None).cast("boolean").alias("added"))
    moved = part("after", "before", True).union(part("before", "after", False)).union(every)
    return moved.groupBy("class").agg(F.count_if(F.col("added")).alias("added"), F.count_if(~F.col("added")).alias("removed"))


@query("""
WITH f AS (SELECT s_suppkey, unnest(['balance', 'nation', 'parts']) AS fact, unnest([CASE WHEN s_acctbal < 0 THEN 'held' ELSE 'shown' END, CASE WHEN s_nationkey % 5 = 0 THEN 'missing' ELSE 'shown' END, CASE WHEN s_suppkey % 2 = 0 THEN 'held' ELSE 'missing' END]) AS state FROM supplier)
SELECT s_suppkey, string_agg(fact || ':' || state, ' ' ORDER BY fact) AS ledger, count(*) FILTER (WHERE state = 'held') AS held FROM f GROUP BY s_suppkey""")
def q_ledger(spark, sf_dir):
    """State of each class of facts of an entity, and how many are held back."""
    k = F.col("s_suppkey")
    fact = lambda name, state: F.struct(F.lit(name).alias("fact"), state.alias("state"))
    facts = F.array(fact("balance", F.when(F.col("s_acctbal") < 0, "held").otherwise("shown")), fact("nation", F.when(F.col("s_nationkey") % 5 == 0, "missing").otherwise("shown")), fact("parts", F.when(k % 2 == 0, "held").otherwise("missing")))
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.explode(facts).alias("f")).select("s_suppkey", "f.*")
    return rows.groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "fact", "state"))), " ").alias("ledger"), F.count_if(F.col("state") == "held").alias("held"))


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey)::INT AS place FROM (SELECT * FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 40)""")
def q_custom_rank(spark, sf_dir):
    """The first forty by a rank of their own, places counted on those alone."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    top = load(spark, sf_dir, "orders").select("o_orderkey", rank.alias("rank"), "o_totalprice").orderBy("rank", F.desc("o_totalprice"), "o_orderkey").limit(40)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("rank", F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("""
SELECT p_name, CASE WHEN starts_with(p_name, 're') THEN 0 ELSE 1 END AS rank, count(*) AS n FROM part WHERE contains(p_name, 're') OR contains(p_name, 'la') GROUP BY p_name ORDER BY rank, n DESC, p_name LIMIT 8""")
def q_suggestions(spark, sf_dir):
    """Eight suggestions, prefixes before what only holds the letters."""
    name = F.col("p_name")
    rows = load(spark, sf_dir, "part").where(name.contains("re") | name.contains("la")).groupBy("p_name").agg(F.count("*").alias("n"))
    return rows.withColumn("rank", F.when(name.startswith("re"), 0).otherwise(1)).orderBy("rank", F.desc("n"), "p_name").limit(8).select("p_name", "rank", "n")


@query("""
SELECT c_custkey, c_acctbal < 0 AS flagged FROM customer ORDER BY c_acctbal < 0 DESC, md5(c_custkey::VARCHAR), c_custkey LIMIT 120""")
def q_flagged_sample(spark, sf_dir):
    """Flagged rows first, then by a hash that any engine reproduces."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("flagged"))
    return rows.orderBy(F.desc("flagged"), F.md5(F.col("c_custkey").cast("string")), "c_custkey").limit(120)


@query("""
WITH a AS (SELECT l_orderkey AS k, count(DISTINCT p_type) FILTER (WHERE l_linestatus = 'O') AS ours, count(DISTINCT p_type) FILTER (WHERE l_linestatus = 'F') AS theirs FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT k AS l_orderkey, ours, theirs, CASE WHEN theirs < greatest(2, ceil(0.6 * ours)) THEN 'ours' ELSE 'theirs' END AS kept FROM a""")
def q_kept_list(spark, sf_dir):
    """Our list stays where theirs is much shorter."""
    lineitem, part = load(spark, sf_dir, "lineitem", "part")
    rows = lineitem.select("l_orderkey", "l_partkey", "l_linestatus").join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    count = lambda s: F.size(F.collect_set(F.when(F.col("l_linestatus") == s, F.col("p_type")))).cast("long")
    held = rows.groupBy("l_orderkey").agg(count("O").alias("ours"), count("F").alias("theirs"))
    return held.withColumn("kept", F.when(F.col("theirs") < F.greatest(F.lit(2), F.ceil(0.6 * F.col("ours"))), "ours").otherwise("theirs"))


@query("""
WITH n AS (SELECT 'orders' AS agency, o_orderkey AS ref, o_orderdate AS happened, o_orderpriority AS reason FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'events', event_id, ts, event_type FROM events WHERE event_type = 'error' UNION ALL SELECT 'items', l_orderkey * 10 + l_linenumber, l_shipdate, NULL FROM lineitem WHERE l_tax = 0.08)
SELECT agency, coalesce(reason, 'none') AS reason, count(*) AS n, max(happened) AS latest FROM n GROUP BY ALL""")
def q_notices(spark, sf_dir):
    """Sources of different shapes as one kind of notice."""
    orders, events, lineitem = load(spark, sf_dir, "orders", "events", "lineitem")
    notice = lambda df, agency, ref, at, *more: df.select(F.lit(agency).alias("agency"), ref.alias("ref"), F.col(at).alias("at"), *more)
    parts = [notice(orders.where("o_orderstatus = 'P'"), "orders", F.col("o_orderkey"), "o_orderdate", F.col("o_orderpriority").alias("reason")), notice(events.where("event_type = 'error'"), "events", F.col("event_id"), "ts", F.col("event_type").alias("reason")), notice(lineitem.where("l_tax = 0.08"), "items", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_shipdate")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return rows.groupBy("agency", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.max("at").alias("latest"))


@query("""
WITH t AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey AS k, -1.0 AS v FROM customer WHERE c_custkey % 2 = 0), u AS (SELECT k, v FROM t UNION ALL SELECT k, v FROM i WHERE k NOT IN (SELECT k FROM t)),
g AS (SELECT k, CASE WHEN k % 10 = 1 AND v IS NOT DISTINCT FROM (SELECT c_acctbal FROM customer WHERE c_custkey = k AND c_acctbal > 0) THEN 0.0 ELSE v END AS v FROM u)
SELECT k, v FROM g WHERE NOT EXISTS (SELECT 1 FROM (VALUES (5), (7), (8)) AS d(k) WHERE d.k = g.k)""")
def q_table_changes(spark, sf_dir):
    """Insert what isn't there, update where the old value still stands, delete listed keys; each a join that gives the new table."""
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    table, incoming = customer.where("k % 3 <> 0"), customer.where("k % 2 = 0").select("k", F.lit(-1.0).alias("v"))
    table = table.union(incoming.join(table.select("k"), "k", "left_anti"))
    plan = customer.where("k % 10 = 1").select(F.col("k").alias("plan_k"), F.when(F.col("v") > 0, F.col("v")).alias("old"), F.lit(0.0).alias("new"))
    table = table.join(plan, F.col("k") == F.col("plan_k"), "left").select("k", F.when(F.col("plan_k").isNotNull() & F.col("v").eqNullSafe(F.col("old")), F.col("new")).otherwise(F.col("v")).alias("v"))
    return table.join(F.broadcast(spark.createDataFrame([(5,), (7,), (8,)], "k long")), "k", "left_anti")


@query("""
WITH h AS (SELECT * FROM lineitem WHERE l_orderkey % 4 = 1 AND l_linenumber = 1)
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM h) UNION ALL SELECT l_orderkey, l_partkey, 99 FROM h""")
def q_replaced_children(spark, sf_dir):
    """K5: all children of some parents are replaced."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    fresh = rows.where("l_orderkey % 4 = 1 AND l_linenumber = 1").select("l_orderkey", "l_partkey", F.lit(99).alias("l_linenumber"))
    return rows.join(fresh.select("l_orderkey").distinct(), "l_orderkey", "left_anti").union(fresh)


@query("""SELECT c_custkey, c_name, floor(c_acctbal * 100 + 0.5) / 100 AS c_acctbal, c_custkey % 11 = 0 AS bad FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT NULL, NULL, NULL, true FROM customer WHERE c_custkey % 11 = 0""")
def q_recreated_rows(spark, sf_dir):
    """Rows made again from JSON; those that don't parse are kept apart, and counted."""
    customer = load(spark, sf_dir, "customer")
    whole = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))
    lines = customer.select(F.when(F.col("c_custkey") % 11 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("line"))
    rows = lines.select(F.from_json("line", "c_custkey long, c_name string, c_acctbal double, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("r")).select("r.*")
    bad = F.col("bad").isNotNull()
    kept = lambda c: F.when(~bad, c)
    return rows.select(kept(F.col("c_custkey")).alias("c_custkey"), kept(F.col("c_name")).alias("c_name"), kept(text.round_half_up(F.col("c_acctbal"))).alias("c_acctbal"), bad.alias("bad"))


@query("""
WITH w AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000), e AS (SELECT event_id, user_id, (props::JSON->>'k')::BIGINT AS v FROM events)
SELECT event_id, user_id, v FROM e WHERE user_id IN (SELECT k FROM w)""")
def q_wanted_lines(spark, sf_dir):
    """The key is cut out of a raw line and semi-joined to the wanted ones before anything is parsed."""
    customer, events = load(spark, sf_dir, "customer", "events")
    lines = events.select(F.to_json(F.struct("event_id", "user_id", "props")).alias("value"))
    wanted = customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("key"))
    held = lines.withColumn("key", F.regexp_extract("value", '"user_id":(\\d+)', 1).cast("long")).join(wanted, "key", "left_semi")
    rows = held.select(F.from_json("value", "event_id long, user_id long, props string").alias("r")).select("r.*")
    return rows.select("event_id", "user_id", F.from_json("props", "k long")["k"].alias("v"))
