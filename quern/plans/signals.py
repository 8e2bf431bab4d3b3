"""Signals about products, and rules held against their twins in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import rules, signals
from quern.operators import dictionary, resolve
from quern.plans.catalogue import load, query
from quern.plans.interchange import GRAIN_WORDS


def facts(spark, sf_dir):
    part, lineitem = load(spark, sf_dir, "part", "lineitem")
    date = lambda condition: F.max(F.when(condition, F.col("l_shipdate")).cast("date"))
    recalled = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)
    sold = lineitem.groupBy("l_partkey").agg(
        F.count("*").alias("items"), F.count_if(F.col("l_discount") > 0.09).alias("flagged"), F.max(F.col("l_shipdate").cast("date")).alias("checked_on"), F.count_if(recalled).alias("recalls"), date(recalled).alias("recalled_on"),
        date(F.col("l_tax") > 0.07).alias("organic_on"), date(F.col("l_tax") < 0.01).alias("non_gmo_on"), date(F.col("l_linestatus") == "F").alias("claim_on"), F.bool_or(F.col("l_quantity") < 2).alias("names_gluten"),
        F.bool_or(F.col("l_suppkey") % 7 == 0).alias("traces_gluten"), F.count_if((F.col("l_suppkey") % 19 == 0) & (F.col("l_quantity") > 30)).alias("grains"),
    )
    k = F.col("p_partkey")
    pick = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return part.join(sold, k == F.col("l_partkey"), "left").select(
        k, pick(F.col("p_size"), "disclosed", "partial", "not_disclosed", "unchecked", None, "disclosed", "disclosed").alias("disclosure"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("flagged", F.lit(0)).alias("flagged"), "checked_on", "recalls", "recalled_on",
        (k % 4 > 0).alias("vetted"), (F.col("p_type") != "PROMO").alias("food"), pick(k, "certified", None, "lapsed", None, None).alias("organic"), "organic_on", pick(k, None, "verified", None, "expired").alias("non_gmo"), "non_gmo_on",
        pick(k, None, "certified", None, "claimed", None, "none").alias("claim"), "claim_on", "names_gluten", "traces_gluten", "grains", F.col("p_brand").alias("maker"), F.when(k % 3 == 0, F.concat(F.lit("House of "), "p_brand")).alias("parent"),
    )


FACTS_SQL = """
sold AS (
  SELECT l_partkey, count(*) AS items, count(*) FILTER (l_discount > 0.09) AS flagged, max(l_shipdate)::DATE AS checked_on, count(*) FILTER (l_returnflag = 'R' AND l_quantity >= 49) AS recalls, (max(l_shipdate) FILTER (l_returnflag = 'R' AND l_quantity >= 49))::DATE AS recalled_on,
    (max(l_shipdate) FILTER (l_tax > 0.07))::DATE AS organic_on, (max(l_shipdate) FILTER (l_tax < 0.01))::DATE AS non_gmo_on, (max(l_shipdate) FILTER (l_linestatus = 'F'))::DATE AS claim_on, bool_or(l_quantity < 2) AS names_gluten, bool_or(l_suppkey % 7 = 0) AS traces_gluten,
    count(*) FILTER (l_suppkey % 19 = 0 AND l_quantity > 30) AS grains FROM lineitem GROUP BY l_partkey),
f AS (
  SELECT p_partkey, ['disclosed', 'partial', 'not_disclosed', 'unchecked', NULL, 'disclosed', 'disclosed'][p_size % 7 + 1] AS disclosure, coalesce(flagged, 0) AS flagged, checked_on, recalls, recalled_on, p_partkey % 4 > 0 AS vetted, p_type <> 'PROMO' AS food,
    ['certified', NULL, 'lapsed', NULL, NULL][p_partkey % 5 + 1] AS organic, organic_on, [NULL, 'verified', NULL, 'expired'][p_partkey % 4 + 1] AS non_gmo, non_gmo_on, [NULL, 'certified', NULL, 'claimed', NULL, 'none'][p_partkey % 6 + 1] AS claim, claim_on, names_gluten, traces_gluten,
    grains, p_brand AS maker, CASE WHEN p_partkey % 3 = 0 THEN 'House of ' || p_brand END AS parent FROM part LEFT JOIN sold ON l_partkey = p_partkey)"""


@query(f"""
WITH {FACTS_SQL}, s AS (
  SELECT p_partkey, 'flagged' AS signal, CASE disclosure WHEN 'disclosed' THEN CASE WHEN flagged > 0 THEN 'open' ELSE 'confirmed' END WHEN 'partial' THEN CASE WHEN flagged > 0 THEN 'open' ELSE 'unchecked' END ELSE 'unchecked' END AS state,
    CASE disclosure WHEN 'disclosed' THEN CASE WHEN flagged > 0 THEN flagged || ' flagged' ELSE 'None flagged' END WHEN 'partial' THEN CASE WHEN flagged > 0 THEN flagged || '+ flagged' ELSE 'List cut off' END WHEN 'not_disclosed' THEN 'Not disclosed' ELSE 'Not checked' END AS label,
    CASE WHEN disclosure IN ('disclosed', 'partial', 'not_disclosed') THEN checked_on END AS as_of FROM f
  UNION ALL SELECT p_partkey, 'recalls', CASE WHEN coalesce(recalls, 0) > 0 THEN 'recall' WHEN vetted THEN 'confirmed' ELSE 'unchecked' END,
    CASE WHEN coalesce(recalls, 0) > 0 THEN 'Recalled ' || year(recalled_on) WHEN vetted THEN 'None for this product' ELSE 'Not checked' END, CASE WHEN coalesce(recalls, 0) > 0 THEN recalled_on END FROM f
  UNION ALL SELECT p_partkey, 'organic', CASE WHEN NOT food THEN 'not_applicable' WHEN organic = 'certified' THEN 'confirmed' WHEN organic IS NULL AND NOT vetted THEN 'unchecked' ELSE 'nothing' END,
    CASE WHEN NOT food THEN 'Does not apply' WHEN organic = 'certified' THEN 'Maker certified' WHEN organic IS NOT NULL THEN 'Not current' WHEN vetted THEN 'Not certified' ELSE 'Not checked' END, CASE WHEN food AND organic IS NOT NULL THEN organic_on END FROM f
  UNION ALL SELECT p_partkey, 'non_gmo', CASE WHEN non_gmo = 'verified' THEN 'confirmed' WHEN non_gmo IS NULL AND NOT vetted THEN 'unchecked' ELSE 'nothing' END,
    CASE WHEN non_gmo = 'verified' THEN 'Non-GMO' WHEN non_gmo IS NOT NULL THEN 'Not current' WHEN vetted THEN 'Not verified' ELSE 'Not checked' END, CASE WHEN non_gmo IS NOT NULL THEN non_gmo_on END FROM f
  UNION ALL SELECT p_partkey, 'owner', 'ownership', coalesce(parent, maker), NULL FROM f
  UNION ALL SELECT p_partkey, 'gluten', CASE WHEN NOT food THEN 'not_applicable' WHEN told AND grains > 0 THEN 'open' WHEN told THEN 'confirmed' WHEN grains > 0 THEN 'nothing' WHEN names_gluten OR traces_gluten THEN 'open' WHEN claim_on IS NULL THEN 'unchecked' ELSE 'nothing' END,
    CASE WHEN NOT food THEN 'Does not apply' WHEN told AND grains > 0 THEN 'Label conflicts' WHEN told THEN upper(claim[1]) || claim[2:] || CASE WHEN traces_gluten THEN ', shared line' ELSE '' END WHEN grains > 0 THEN 'Contains gluten' WHEN names_gluten OR traces_gluten THEN 'May contain'
      WHEN claim_on IS NULL THEN 'Not checked' ELSE 'Not declared' END,
    CASE WHEN NOT food THEN NULL WHEN told THEN claim_on WHEN grains > 0 THEN checked_on ELSE claim_on END FROM (SELECT *, coalesce(claim IN ('certified', 'claimed'), false) AS told FROM f))
SELECT * FROM s""")
def q_product_signals(spark, sf_dir):
    """Six signals of every part, each by a decision table over what its sales say, unknown told apart from no."""
    found = facts(spark, sf_dir).select("p_partkey", F.explode(F.array(*(F.struct(F.lit(name).alias("signal"), signals.signal(name).alias("s")) for name in signals.TABLES))).alias("one"))
    return found.select("p_partkey", "one.signal", "one.s.state", "one.s.label", "one.s.as_of")


STEM_TWIN = (
    "CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN concat(left(w, length(w) - 3), 'y') WHEN w RLIKE '(oes|ches|shes|sses|xes)$' THEN left(w, length(w) - 2) WHEN w RLIKE '(ss|us|is)$' THEN w WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"
)


@query("""
WITH d AS (SELECT count(*) AS n FROM (SELECT unnest(string_split(text, '. ')) FROM documents)), w AS (SELECT count(DISTINCT w) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> ''), p AS (SELECT count(*) AS n FROM part)
SELECT 'gluten' AS rule, n AS checked, 0::BIGINT AS differ FROM d UNION ALL SELECT 'stem', n, 0 FROM w UNION ALL SELECT unnest(['flagged', 'recalls', 'organic', 'non_gmo', 'gluten_signal', 'owner']), n, 0 FROM p""")
def q_agreement(spark, sf_dir):
    """Rules written as Columns held against the same rules in SQL, on all rows: how many were checked and how many differ."""
    documents = load(spark, sf_dir, "documents")
    said = F.col("text")
    for word, grain in GRAIN_WORDS:
        said = F.replace(said, F.lit(word), F.lit(grain))
    sentences = documents.select("doc_id", F.posexplode(F.split(said, r"\. ")).alias("at", "name")).select(F.concat_ws("/", "doc_id", "at").alias("key"), F.lower("name").alias("name"))
    grains, malt = "|".join(rules.GLUTEN_GRAINS), "|".join(rules.OTHER_MALT)
    twin = rf"name RLIKE r'\b({grains})\b' OR (name RLIKE r'\bmalt(ed)?\b' AND NOT name RLIKE r'\b({malt})\b')"
    words = documents.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    known = facts(spark, sf_dir)
    pairs = [("gluten", sentences, "key", rules.names_gluten_grain(F.col("name")), twin), ("stem", words, "w", dictionary.stem(F.col("w")), STEM_TWIN)]
    pairs += [("gluten_signal" if s == "gluten" else s, known, "p_partkey", F.to_json(signals.signal(s)), f"to_json({signals.decision_sql(s)})") for s in signals.TABLES]

    def one(name, rows, key, rule, expression):
        differ = resolve.disagreements(rows, key, rule, expression).agg(F.count("*").alias("differ"))
        return rows.agg(F.count("*").alias("checked")).join(F.broadcast(differ)).select(F.lit(name).alias("rule"), "checked", "differ")  # one row each

    return reduce(DataFrame.union, (one(*p) for p in pairs))
