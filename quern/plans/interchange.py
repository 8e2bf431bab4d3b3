"""Queries over files that are written first and read again, and over rules on single rows. Docstrings name the operators that a query stands for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import hazards, rules
from quern.operators import relational as ops
from quern.plans.catalogue import load, query
from quern.sources import files, sinks
from quern.sources.shared import shared_path


@query("""
SELECT CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS kind, event_id % 17 = 0 AS bad, count(*) AS n, sum(CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id END)::BIGINT AS ids
FROM events GROUP BY ALL""")
def q_feed_lines(spark, sf_dir):
    """A gzipped feed of JSON lines, some of them blank or broken off; broken ones are counted, not lost."""
    events, path = load(spark, sf_dir, "events"), shared_path(spark, "feed")
    whole = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    line = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit('{"kind": "'), F.col("event_type"))).otherwise(whole)
    events.select(F.explode(F.array(line, F.lit(" "))).alias("value")).write.option("compression", "gzip").text(path)
    return files.read_json_lines(spark, path, "id long, kind string").groupBy("kind", "bad").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""
SELECT 'part' AS held, p_partkey AS key, p_name || ', "' || p_brand || '"' || chr(10) || p_type AS label, p_brand || '|' || p_type AS tags FROM part
UNION ALL SELECT 'supplier', s_suppkey, s_name || ' "', NULL FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name || ',', NULL FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, NULL FROM region""")
def q_csv_exports(spark, sf_dir):
    """Four tables exported as gzipped CSV with quotes, commas and line breaks in the cells, read back with the columns checked."""
    part, supplier, nation, region = load(spark, sf_dir, "part", "supplier", "nation", "region")
    tables = {
        "part": part.select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type").alias("label"), F.array("p_brand", "p_type").alias("tags")),
        "supplier": supplier.select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(' "')).alias("label")),
        "nation": nation.select(F.col("n_nationkey").alias("key"), F.concat("n_name", F.lit(",")).alias("label")),
        "region": region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("label")),
    }
    read = []
    for name, table in tables.items():
        path = shared_path(spark, name)
        sinks.export_csv(table, path)
        back = files.require_columns(files.read_csv(spark, path), table.columns)
        tags = F.col("tags") if "tags" in table.columns else F.lit(None).cast("string")
        read.append(back.select(F.lit(name).alias("held"), F.col("key").cast("long").alias("key"), "label", tags.alias("tags")))
    return reduce(DataFrame.union, read)


@query("""
SELECT s_suppkey::VARCHAR AS key, 'Firm ' || s_suppkey || ', "of" ' || n_name AS name, round(s_acctbal)::BIGINT::VARCHAR AS balance
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def q_header_below_preamble(spark, sf_dir):
    """CSV files with a preamble and columns in changing order; the header is the first line in which each pattern finds a cell of its own."""
    supplier, nation = load(spark, sf_dir, "supplier", "nation")
    path = shared_path(spark, "sheets")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    cell = F.concat(F.lit('"Firm '), F.col("s_suppkey").cast("string"), F.lit(', ""of"" '), F.col("n_name"), F.lit('"'))
    key, balance = F.col("s_suppkey").cast("string"), F.round("s_acctbal").cast("long").cast("string")
    even = F.col("s_nationkey") % 2 == 0
    line = F.when(even, F.concat_ws(",", key, cell, balance)).otherwise(F.concat_ws(",", balance, cell, F.lit("x"), key))
    header = F.when(even, "Key of name,Name,Balance").otherwise("ACCOUNT BALANCE,Name of firm,Note,Key")
    body = rows.select("s_nationkey", F.lit(3).alias("at"), line.alias("value"))
    heads = rows.select("s_nationkey", F.explode(F.array(*(F.struct(F.lit(k).alias("at"), v.alias("value")) for k, v in enumerate((F.lit("Suppliers, by name"), F.lit("in one nation,,"), header))))).alias("h")).select("s_nationkey", "h.*").distinct()
    heads.union(body).repartition("s_nationkey").sortWithinPartitions("s_nationkey", "at", "value").select("s_nationkey", "value").write.partitionBy("s_nationkey").text(path)
    return files.read_csv_with_header_below(spark, path, {"key": "key", "name": "name", "balance": "balance"})


@query("""
SELECT 'supplier' AS held, s_suppkey::VARCHAR AS key, s_name AS name, NULL AS kind FROM supplier UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_name, c_mktsegment FROM customer UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name, NULL FROM nation""")
def q_found_columns(spark, sf_dir):
    """Exports of three sources, each with names of its own for the same columns, which are found by patterns in order."""
    path = shared_path(spark, "sources")
    wanted = {"key": [r"\bid\b", "key$"], "name": ["^(full )?name$", "name"], "kind": ["segment", "^kind$"]}
    named = {"supplier": {"s_suppkey": "Supplier ID", "s_name": "Full Name", "s_nationkey": "Name of nation"}, "customer": {"c_custkey": "Cust_Key", "c_mktsegment": "Market Segment", "c_name": "NAME"}, "nation": {"n_name": "Nation name", "n_nationkey": "nationkey"}}
    found = []
    for table, names in named.items():
        rows = load(spark, sf_dir, table)
        rows.select(*(F.col(c).alias(n) for c, n in names.items())).write.option("header", True).option("escape", '"').csv(f"{path}/{table}")
        found.append(files.with_columns_found(files.read_csv(spark, f"{path}/{table}"), wanted).select(F.lit(table).alias("held"), *wanted))
    return reduce(DataFrame.union, found)


@query("""
WITH o AS (SELECT *, o_orderkey % 3 AS kind FROM orders WHERE o_orderkey % 10 > 0)
SELECT CASE kind WHEN 0 THEN 'FDA' WHEN 1 THEN 'FSIS' ELSE 'CPSC' END AS agency, CASE kind WHEN 0 THEN 'F-' || o_orderkey WHEN 1 THEN 'R' || o_orderkey ELSE 'C' || o_orderkey END AS reference, strftime(o_orderdate, '%Y-%m-%d') AS dated, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS firm,
  CASE kind WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority || '; ' || o_orderstatus ELSE NULL END AS reason FROM o""")
def q_agency_feeds(spark, sf_dir):
    """Notices of three agencies, each in JSON of its own shape, as rows of one shape; lines that are no JSON are left out."""
    orders, path = load(spark, sf_dir, "orders"), shared_path(spark, "agencies")
    key, firm, day = F.col("o_orderkey").cast("string"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")), F.date_format("o_orderdate", "yyyy-MM-dd")
    shapes = [
        F.struct(F.concat(F.lit("F-"), key).alias("recall_number"), F.date_format("o_orderdate", "yyyyMMdd").alias("report_date"), F.col("o_orderpriority").alias("reason_for_recall"), firm.alias("recalling_firm")),
        F.struct(F.concat(F.lit("R"), key).alias("field_recall_number"), day.alias("field_recall_date"), F.array("o_orderpriority", "o_orderstatus").alias("field_reasons"), F.struct(firm.alias("name")).alias("establishment")),
        F.struct(F.concat(F.lit("C"), key).alias("RecallNumber"), day.alias("RecallDate"), F.array(F.struct(firm.alias("Name"))).alias("Manufacturers")),
    ]
    for kind, shape in enumerate(shapes):
        text = F.to_json(shape)
        lines = orders.where(F.col("o_orderkey") % 3 == kind).select(F.when(F.col("o_orderkey") % 10 > 0, text).otherwise(F.substring(text, F.lit(1), F.length(text) - 3)).alias("value"))
        lines.write.option("compression", "gzip").text(f"{path}/{kind}")

    def notices(kind, schema, agency, reference, dated, by, reason):
        read = files.read_json_lines(spark, f"{path}/{kind}", schema).where("NOT bad")
        return read.select(F.lit(agency).alias("agency"), F.expr(reference).alias("reference"), F.expr(dated).alias("dated"), F.expr(by).alias("firm"), F.expr(reason).cast("string").alias("reason"))

    fda = notices(0, "recall_number string, report_date string, reason_for_recall string, recalling_firm string", "FDA", "recall_number", "date_format(to_date(report_date, 'yyyyMMdd'), 'yyyy-MM-dd')", "recalling_firm", "reason_for_recall")
    fsis = notices(1, "field_recall_number string, field_recall_date string, field_reasons array<string>, establishment struct<name:string>", "FSIS", "field_recall_number", "field_recall_date", "establishment.name", "array_join(field_reasons, '; ')")
    cpsc = notices(2, "RecallNumber string, RecallDate string, Manufacturers array<struct<Name:string>>", "CPSC", "RecallNumber", "RecallDate", "Manufacturers[0].Name", "NULL")
    return fda.unionByName(fsis).unionByName(cpsc)


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS after_run, c_acctbal < 0 AND c_mktsegment <> 'REVIEW' AS planned, c_mktsegment AS after_undo FROM customer""")
def q_change_log(spark, sf_dir):
    """A planned change, written for review as TSV and logged under the label of its run, then applied, then undone from the log."""
    table = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    goal = table.withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "REVIEW").otherwise(F.col("c_mktsegment")))
    log, review = shared_path(spark, "log"), shared_path(spark, "review")
    plan = ops.changes(table, goal, "c_custkey", "c_mktsegment")
    plan.write.option("sep", "\t").option("header", True).csv(review)
    approved = spark.read.schema("c_custkey long, old_value string, new_value string").option("sep", "\t").option("header", True).csv(review)
    sinks.log_changes(approved, log, "run1")
    done = approved.select(F.col("c_custkey").alias("plan_key"), "new_value")
    after = table.join(done, F.col("c_custkey") == F.col("plan_key"), "left").withColumn("planned", F.col("plan_key").isNotNull())
    after = after.select("c_custkey", "planned", F.when(F.col("planned"), F.col("new_value")).otherwise(F.col("c_mktsegment")).alias("after_run"))
    undone = sinks.undo(spark, after.select("c_custkey", F.col("after_run").alias("value")), log, "run1", "c_custkey", "value")
    return after.join(undone.withColumnRenamed("value", "after_undo"), "c_custkey")


@query("""
WITH t AS (SELECT p_partkey, p_name, CASE p_partkey % 5 WHEN 0 THEN 'Made by ' || p_name || ' Foods' WHEN 1 THEN p_name || ', sold at stores' WHEN 2 THEN 'Packed for ' || p_name || '. ' || p_name || ' cakes' WHEN 3 THEN 'x' || p_name ELSE 'stand by: ' || p_name END AS said FROM part),
w AS (SELECT *, string_split(upper(trim(regexp_replace(said, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS ws, string_split(upper(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS ps FROM t)
SELECT p_partkey, len(list_filter(range(1, len(ws) - len(ps) + 2), lambda i: ws[i:i + len(ps) - 1] = ps AND (i = 1 OR ws[i - 1] NOT IN ('BY', 'FOR', 'FROM', 'AT')))) > 0 AS mentioned FROM w""")
def q_brand_mentions(spark, sf_dir):
    """A brand named in a text, but not as its maker or seller."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 5
    said = F.when(kind == 0, F.concat(F.lit("Made by "), name, F.lit(" Foods"))).when(kind == 1, F.concat(name, F.lit(", sold at stores")))
    said = said.when(kind == 2, F.concat(F.lit("Packed for "), name, F.lit(". "), name, F.lit(" cakes"))).when(kind == 3, F.concat(F.lit("x"), name)).otherwise(F.concat(F.lit("stand by: "), name))
    return load(spark, sf_dir, "part").select("p_partkey", rules.mentions_brand(said, name).alias("mentioned"))


#: What turns words of documents into grains, malts and their look-alikes.
GRAIN_WORDS = [(" the ", " wheat "), (" of ", " malted "), (" der ", " malt "), (" la ", " rice "), (" que ", " buckwheat "), (" de ", " ryegrass "), (" and ", " maltodextrin "), (" un ", " corn "), (" zu ", " rye "), (" y ", " graham ")]
GRAINS_SQL = reduce(lambda c, r: f"replace({c}, '{r[0]}', '{r[1]}')", GRAIN_WORDS, "text")


@query(f"""
WITH s AS (SELECT doc_id, unnest(ss) AS name, generate_subscripts(ss, 1)::INTEGER AS n FROM (SELECT doc_id, string_split({GRAINS_SQL}, '. ') AS ss FROM documents)),
w AS (SELECT doc_id, n, string_split_regex(lower(name), '[^a-z0-9_]+') AS ws FROM s)
SELECT doc_id, n, list_has_any(ws, {rules.GLUTEN_GRAINS!r}) OR (list_has_any(ws, ['malt', 'malted']) AND NOT list_has_any(ws, {rules.OTHER_MALT!r})) AS gluten FROM w""")
def q_gluten_grains(spark, sf_dir):
    """sentences of texts that name grains with gluten, with malt as an exception to the exception."""
    said = F.col("text")
    for word, grain in GRAIN_WORDS:
        said = F.replace(said, F.lit(word), F.lit(grain))
    named = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(said, r"\. ")).alias("at", "name"))
    return named.select("doc_id", (F.col("at") + 1).alias("n"), rules.names_gluten_grain(F.lower("name")).alias("gluten"))


@query("""
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'FSIS' WHEN o_orderpriority LIKE '5%' THEN NULL WHEN o_orderpriority LIKE '2%' THEN 'CPSC' ELSE 'FDA' END AS agency, CASE WHEN o_orderkey % 9 > 0 THEN CASE WHEN o_custkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END || '-' || o_orderkey END AS ref FROM orders)
SELECT o_orderkey, coalesce(agency = 'FSIS' OR (agency = 'FDA' AND (starts_with(upper(ref), 'F-') OR starts_with(upper(ref), 'H-'))), false) AS food FROM n""")
def q_food_notices(spark, sf_dir):
    """Notices about food, by agency and by the beginning of their reference."""
    priority, status = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    agency = F.when(priority == "1", "FSIS").when(priority == "2", "CPSC").when(priority != "5", "FDA")
    reference = F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.when(F.col("o_custkey") % 2 == 0, F.lower(status)).otherwise(status), F.lit("-"), F.col("o_orderkey").cast("string")))
    return load(spark, sf_dir, "orders").select("o_orderkey", rules.is_food_notice(agency, reference).alias("food"))


@query("""
WITH n AS (SELECT p_partkey, ['disclosed', 'partial', NULL, 'hidden'][p_partkey % 4 + 1] AS status, left(repeat(p_name || ', ', 40), (250 + p_partkey % 8)::INT) AS list FROM part)
SELECT p_partkey, coalesce(status = 'disclosed', false) AS absence, coalesce(status IN ('disclosed', 'partial'), false) AS any_list, length(list) IN (254, 255) AS cut_off, regexp_matches(list, '[A-Za-z]$') AS mid_word FROM n""")
def q_disclosure(spark, sf_dir):
    """what a list's status and its length allow to be said of what isn't in it."""
    status = F.element_at(F.array(*map(F.lit, ("disclosed", "partial", None, "hidden"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    listed = F.substring(F.repeat(F.concat("p_name", F.lit(", ")), 40), F.lit(1), (250 + F.col("p_partkey") % 8).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", rules.may_assert_absence(status).alias("absence"), rules.has_any_list(status).alias("any_list"), rules.looks_cut(listed).alias("cut_off"), rules.ends_in_a_letter(listed).alias("mid_word"))


@query("""
WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '  ' || p_name WHEN 1 THEN ' ' END AS english, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_type || ' ' END AS main, ['EN', 'fr', NULL, ''][p_partkey % 4 + 1] AS lang FROM part),
t AS (SELECT p_partkey, trim(coalesce(english, '')) AS e, trim(coalesce(main, '')) AS m, lower(coalesce(lang, '')) AS l FROM n)
SELECT p_partkey, CASE WHEN e <> '' OR (m <> '' AND l = 'en') THEN 'english' WHEN m <> '' THEN 'not_english' ELSE 'none' END AS kind,
  CASE WHEN e <> '' THEN e WHEN m <> '' AND l = 'en' THEN m END AS text, CASE WHEN e = '' AND m <> '' AND l <> 'en' THEN CASE WHEN l = '' THEN 'unknown' ELSE l END END AS lang FROM t""")
def q_english_text(spark, sf_dir):
    """which of a record's lists is English, or what language it is in."""
    three, five, key = F.col("p_partkey") % 3, F.col("p_partkey") % 5, F.col("p_partkey") % 4
    english = F.when(three == 0, F.concat(F.lit("  "), "p_name")).when(three == 1, " ")
    main = F.when(five == 0, "").when(five > 1, F.concat("p_type", F.lit(" ")))
    lang = F.element_at(F.array(*map(F.lit, ("EN", "fr", None, ""))), (key + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", rules.english_text(english, main, lang).alias("r")).select("p_partkey", "r.*")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 2 END AS n, CASE WHEN p_partkey % 4 <> 3 THEN p_name || '|x' ELSE '' END AS names, CASE WHEN p_partkey % 4 <> 3 THEN p_size::DOUBLE END AS percent FROM part""")
def q_named_parts(spark, sf_dir):
    """names and percentages out of JSON arrays, of which some elements, or all of the text, are malformed."""
    whole = F.concat(F.lit('[{"name": "'), "p_name", F.lit('", "percent": '), F.col("p_size").cast("string"), F.lit('}, {"percent": 3}, 7, "y", {"name": ""}, {"name": "x"}]'))
    found = load(spark, sf_dir, "part").select("p_partkey", rules.named_parts(F.when(F.col("p_partkey") % 4 == 3, "[{").otherwise(whole)).alias("parts"))
    return found.select("p_partkey", F.size("parts").alias("n"), F.array_join(F.col("parts.name"), "|").alias("names"), F.get("parts", F.lit(0))["percent"].alias("percent"))


@query("""
SELECT p_partkey, list_contains(string_split(p_name, ' '), 'bolt') AS has_bolt, list_has_any(string_split(p_name, ' '), ['red', 'large', 'cold']) AS has_any FROM part
WHERE list_contains(string_split(p_name, ' '), 'bolt') OR list_has_any(string_split(p_name, ' '), ['red', 'large', 'cold'])""")
def q_array_filters(spark, sf_dir):
    """P5: an array that holds an element, or any of several."""
    words = F.split("p_name", " ")
    found = load(spark, sf_dir, "part").select("p_partkey", F.array_contains(words, "bolt").alias("has_bolt"), F.arrays_overlap(words, F.array(*map(F.lit, ("red", "large", "cold")))).alias("has_any"))
    return found.where("has_bolt OR has_any")


@query("""
WITH n AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS stored, string_agg(l_linestatus || l_returnflag, ' ') AS said FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_sort(CASE WHEN len(list_filter(stored, lambda x: x NOT IN ('R', 'N'))) > 0 THEN list_filter(stored, lambda x: x NOT IN ('R', 'N')) ELSE stored END), ',') AS kept
FROM n WHERE regexp_matches(said, '(?i)o[rn]|fr')""")
def q_drop_gate(spark, sf_dir):
    """Rows that a cheap pattern finds lose elements of their list, unless none would be left."""
    orders = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("stored"), F.array_join(F.collect_list(F.concat("l_linestatus", "l_returnflag")), " ").alias("said"))
    kept = rules.without(F.col("stored"), F.array(F.lit("R"), F.lit("N")))
    return orders.where(F.col("said").rlike("(?i)o[rn]|fr")).select("l_orderkey", F.array_join(F.array_sort(kept), ",").alias("kept"))


@query("SELECT doc_id, lang IS NULL OR source IS NULL AS open FROM documents")
def q_open_columns(spark, sf_dir):
    """Rows in which one of a group of columns, put together at run time, still has no value."""
    return load(spark, sf_dir, "documents").select("doc_id", rules.any_missing("lang", "source").alias("open"))


#: A tag as a feed has it, the tags that it stands for, and the additive that it names.
TAGS = [
    ("en:milk en:soybeans", "en:milk|en:soybeans", ""),
    ("en:en:gluten-en:soybeans", "en:gluten|en:soybeans", ""),
    ("es:contiene-de:-trigo+", "", ""),
    (" EN:Tree  Nuts", "en:tree-nuts", ""),
    ("milk", "", ""),
    ("en:E322i", "en:e322i", "e322i"),
    ("en:crustacean-shellfish", "en:crustacean-shellfish", ""),
    ("fr:\u200blait, fr:blé", "fr:lait|fr:blé", ""),
    ("en:e1442;en:milk", "en:e1442|en:milk", "e1442"),
]


@query(f"SELECT p_partkey, ({[t for _, t, _ in TAGS]!r})[p_partkey % {len(TAGS)} + 1] AS tags, ({[a for _, _, a in TAGS]!r})[p_partkey % {len(TAGS)} + 1] AS additives FROM part")
def q_tags(spark, sf_dir):
    """tags in one form, several in one text taken apart, additives by number."""
    raw = F.element_at(F.array(*(F.lit(t) for t, _, _ in TAGS)), (F.col("p_partkey") % len(TAGS) + 1).cast("int"))
    found = load(spark, sf_dir, "part").select("p_partkey", rules.tags_of(raw).alias("t"))
    return found.select("p_partkey", F.array_join("t", "|").alias("tags"), F.array_join(rules.additive_numbers(F.col("t")), "|").alias("additives"))


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN 'unsure' WHEN 2 THEN 'untitled' WHEN 3 THEN 'differs' WHEN 4 THEN 'says_maker' WHEN 5 THEN 'wordless' WHEN 6 THEN 'undivided' END AS fault FROM part""")
def q_split_faults(spark, sf_dir):
    """proposed splits of names, refused where their parts don't put the name together again."""
    kind, nothing = F.col("p_partkey") % 7, F.lit(None).cast("string")
    brand, name, sort = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    whole = F.concat(brand, F.lit("&nbsp;"), name, F.lit(", "), sort)
    lead = F.when(kind.isin(4, 6), nothing).when(kind == 5, F.concat(brand, name)).otherwise(brand)
    title = F.when(kind == 2, " ").when(kind == 3, "Other").when(kind == 4, brand).when(kind == 5, "!!").when(kind == 6, whole).otherwise(name)
    second = F.when(kind == 4, F.concat(name, sort)).when(kind == 6, nothing).otherwise(sort)
    fault = rules.split_fault(F.array(lead, title, second), whole, title, brand, kind != 1)
    return load(spark, sf_dir, "part").select("p_partkey", fault.alias("fault"))


@query("""
SELECT o_orderpriority AS source, count(*) AS records, 'open' AS file_name FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL
UNION ALL SELECT o_orderpriority, count(*), 'filled' FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def q_run_log(spark, sf_dir):
    """Each run appends what it matched to the log of runs."""
    orders, path = load(spark, sf_dir, "orders"), shared_path(spark, "runs")
    for file_name, status in (("open", "O"), ("filled", "F")):
        sinks.append_run(orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("records")), path, file_name)
    return spark.read.schema("source string, records long, file_name string").parquet(path)


@query("""
WITH best AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC) AS k FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20))
SELECT l_partkey, l_orderkey, o_orderpriority FROM best JOIN orders ON o_orderkey = l_orderkey WHERE k = 1""")
def q_record_chain(spark, sf_dir):
    """The latest record of each wanted key in one file, then what a second file says under that record's id."""
    part, lineitem, orders = load(spark, sf_dir, "part", "lineitem", "orders")
    wanted = part.where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"))
    held = lineitem.select("l_partkey", "l_orderkey", "l_shipdate").join(wanted, "l_partkey", "left_semi")
    best = held.groupBy("l_partkey").agg(F.max(F.struct("l_shipdate", "l_orderkey"))["l_orderkey"].alias("l_orderkey"))
    said = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return best.join(said, "l_orderkey").select("l_partkey", "l_orderkey", "o_orderpriority")


#: What turns documents into notices: some of their words become hazards, harmless look-alikes, and the names of things.
NOTICE_WORDS = [(" the ", " Listeria "), (" que ", " E. coli "), (" de ", " metal, "), (" von ", " metallic "), (" und ", " undeclared eggs "), (" les ", " under-processed "), (" to ", " GMPs "), (" la ", " leads to "), (" zu ", " thawed "), (" in ", " without benefit of inspection ")]


def notice_texts(spark, sf_dir):
    said = F.col("text")
    for word, hazard in NOTICE_WORDS:
        said = F.replace(said, F.lit(word), F.lit(hazard))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(said, "\n")).alias("line", "said"))
    return rows.select("doc_id", "line", "said")


NOTICES_SQL = f"""
lines AS (SELECT doc_id, unnest(ls) AS said, generate_subscripts(ls, 1) - 1 AS line FROM (SELECT doc_id, string_split({reduce(lambda c, r: f"replace({c}, '{r[0]}', '{r[1]}')", NOTICE_WORDS, "text")}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
words AS (SELECT doc_id, line::INTEGER AS line, ' ' || regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g') || ' ' AS w FROM lines),
terms AS (SELECT unnest({[[k, str(i), t] for i, (k, ts) in enumerate((hazards.PROCESS | hazards.OTHER).items()) for t in ts]!r}::VARCHAR[][]) AS t),
named AS (SELECT DISTINCT doc_id, line, t[1] AS kind, t[2]::INTEGER AS k FROM words, terms WHERE contains(w, t[3])),
kinds AS (SELECT doc_id, line, string_agg(kind, '|' ORDER BY k) AS classes, bool_or(k < {len(hazards.PROCESS)}) AS process FROM named GROUP BY doc_id, line)"""


@query(f"WITH {NOTICES_SQL} SELECT doc_id, line, coalesce(classes, '') AS classes, coalesce(process, false) AS process FROM words LEFT JOIN kinds USING (doc_id, line)")
def q_process_faults(spark, sf_dir):
    """Lines of texts that name a fault of the process rather than of a label, with the classes of hazards that they name."""
    found = notice_texts(spark, sf_dir)
    return found.select("doc_id", "line", F.array_join(hazards.hazard_classes(F.col("said")), "|").alias("classes"), hazards.is_process_fault(F.col("said")).alias("process"))


def _sentence_sql(kind: str, plain: str, named: list[str], filled: str) -> str:
    if not named:
        return f"WHEN list_contains(cs, '{kind}') THEN '{plain}'"
    word = f"regexp_extract(w, ' ({'|'.join(named)})(?:e?s)? ', 1)"
    return f"WHEN list_contains(cs, '{kind}') THEN CASE WHEN {word} = '' THEN '{plain}' ELSE replace('{filled}', '{{}}', {word}) END"


@query(f"""
WITH {NOTICES_SQL}, c AS (SELECT doc_id, line, w, string_split(classes, '|') AS cs FROM words JOIN kinds USING (doc_id, line))
SELECT doc_id, line, CASE {" ".join(f"WHEN list_contains(cs, '{k}') THEN '{k}'" for k, *_ in hazards.SENTENCES)} END AS kind, CASE {" ".join(_sentence_sql(*s) for s in hazards.SENTENCES)} END AS sentence FROM c""")
def q_plain_reasons(spark, sf_dir):
    """what is wrong, in a sentence for readers, for every line of a text that names a hazard."""
    found = notice_texts(spark, sf_dir).select("doc_id", "line", hazards.plain_reason(F.col("said")).alias("r"))
    return found.where("r IS NOT NULL").select("doc_id", "line", "r.*")


@query("""
WITH k AS (SELECT *, CASE WHEN l_quantity < 2 THEN 'too_few' WHEN l_discount > 0.09 THEN 'too_cheap' END AS fault FROM lineitem)
SELECT 'company' AS held, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_suppkey)::BIGINT AS keys FROM k WHERE fault IS NULL
UNION ALL SELECT 'product', count(DISTINCT l_partkey), sum(DISTINCT l_partkey)::BIGINT FROM k WHERE fault IS NULL
UNION ALL SELECT 'link', count(*), sum(l_partkey)::BIGINT FROM (SELECT DISTINCT l_partkey, l_suppkey FROM k WHERE fault IS NULL)
UNION ALL SELECT fault, count(*), sum(l_orderkey)::BIGINT FROM k WHERE fault IS NOT NULL GROUP BY fault""")
def q_ingest_tables(spark, sf_dir):
    """One feed becomes several tables; each row that can't be written is kept beside them with its fault, and stops nothing else."""
    fault = F.when(F.col("l_quantity") < 2, "too_few").when(F.col("l_discount") > 0.09, "too_cheap")
    feed = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", fault.alias("fault"))
    path = shared_path(spark, "ingested")
    feed.write.partitionBy("fault").parquet(f"{path}/checked")  # the tables are taken from one pass over the feed
    checked = spark.read.schema("l_orderkey long, l_partkey long, l_suppkey long, fault string").parquet(f"{path}/checked")
    sound = checked.where(F.col("fault").isNull())
    tables = {"company": sound.select(F.col("l_suppkey").alias("key")).distinct(), "product": sound.select(F.col("l_partkey").alias("key")).distinct(), "link": sound.select(F.col("l_partkey").alias("key"), "l_suppkey").distinct()}
    for name, table in tables.items():
        table.write.mode("append").parquet(f"{path}/{name}")
    counts = [spark.read.schema("key long").parquet(f"{path}/{name}").agg(F.lit(name).alias("held"), F.count("*").alias("n"), F.sum("key").alias("keys")) for name in tables]
    refused = checked.where(F.col("fault").isNotNull()).groupBy(F.col("fault").alias("held")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))
    return reduce(DataFrame.union, counts).union(refused)


@query("SELECT table_name AS held, column_name AS name FROM information_schema.columns WHERE table_name IN ('part', 'supplier', 'nation') AND column_name LIKE '%name'")
def q_columns(spark, sf_dir):
    """Which columns tables have, from the catalogue, without reading a row."""
    found = []
    for name in ("part", "supplier", "nation"):
        load(spark, sf_dir, name).createOrReplaceTempView(f"columns_of_{name}")
        found += [(name, c.name) for c in spark.catalog.listColumns(f"columns_of_{name}") if c.name.endswith("name")]
    return spark.createDataFrame(found, "held string, name string")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 77")
def q_point_lookup(spark, sf_dir):
    """One row by its key; the key reaches the scan, whose statistics rule out other row groups."""
    return load(spark, sf_dir, "part").where(F.col("p_partkey") == 77).select("p_partkey", "p_name", "p_brand").limit(1)
