"""Queries that requests make: trees of filters over parts and what was sold of them, searches of several kinds; nested records that nobody described; tables published together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import census, filters
from quern.plans.catalogue import load, query
from quern.sources.publish import Publication, ingest
from quern.sources.shared import shared_path

#: Conditions on the lines in which a part was sold.
REGISTRY = {"returned": "l_returnflag = 'R'", "bulk": "l_quantity >= 48", "cheap": "l_discount >= 0.09", "taxed": "l_tax >= 0.07", "open": "l_linestatus = 'O'", "tiny": "l_quantity <= 1"}

TREE = filters.All(
    (
        filters.AnyOf((filters.Text("p_name", "red"), filters.Text("p_name", "Gizmo"), filters.Within("p_type", ("PROMO", "SMALL")))),
        filters.AnyOf((filters.Not(filters.Has("returned")), filters.All((filters.Has("bulk"), filters.Not(filters.Has("tiny")))))),
        filters.Not(filters.All((filters.Has("cheap"), filters.Not(filters.Not(filters.Has("taxed"))), filters.Clear("open")))),
    )
)


def exists_sql(term: str) -> str:
    return f"EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND {REGISTRY[term]})"


@query(f"""
SELECT p_partkey, p_name, p_type FROM part
WHERE (contains(lower(p_name), 'red') OR contains(lower(p_name), 'gizmo') OR p_type IN ('PROMO', 'SMALL'))
  AND (NOT {exists_sql("returned")} OR ({exists_sql("bulk")} AND NOT {exists_sql("tiny")}))
  AND NOT ({exists_sql("cheap")} AND {exists_sql("taxed")} AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate IS NULL) AND NOT {exists_sql("open")})""")
def q_filter_tree(spark, sf_dir):
    """A tree of nested and negated conditions on parts and on their sales, which are read once."""
    part, lineitem = load(spark, sf_dir, "part", "lineitem")
    return filters.matching(part, "p_partkey", TREE, REGISTRY, lineitem, "l_partkey", assessed=F.col("l_shipdate").isNotNull()).select("p_partkey", "p_name", "p_type")


#: Requests as they come in URLs; the first two mean the same.
REQUESTS = ["without=returned,tiny&with=bulk&text=Red", "text=red&with=bulk&without=tiny&without=returned&without=tiny&with=unknown&text=x", "with=cheap,taxed", "text=%20blue%20%20bolt%20"]


@query(f"""
SELECT 0 AS request, 'without=returned&with=bulk&without=tiny&text=red' AS canonical, p_partkey FROM part WHERE NOT {exists_sql("returned")} AND {exists_sql("bulk")} AND NOT {exists_sql("tiny")} AND contains(lower(p_name), 'red')
UNION ALL SELECT 1, 'without=returned&with=bulk&without=tiny&text=red', p_partkey FROM part WHERE NOT {exists_sql("returned")} AND {exists_sql("bulk")} AND NOT {exists_sql("tiny")} AND contains(lower(p_name), 'red')
UNION ALL SELECT 2, 'with=cheap&with=taxed', p_partkey FROM part WHERE {exists_sql("cheap")} AND {exists_sql("taxed")}
UNION ALL SELECT 3, 'text=blue+bolt', p_partkey FROM part WHERE contains(lower(p_name), 'blue bolt')""")
def q_requests(spark, sf_dir):
    """Filters out of URLs, put in their canonical order, and what they let pass."""
    part, lineitem = load(spark, sf_dir, "part", "lineitem")

    def answer(k: int, request: str) -> DataFrame:
        parsed = filters.parse(request, REGISTRY)
        found = filters.matching(part, "p_partkey", filters.tree_of(parsed, "p_name"), REGISTRY, lineitem, "l_partkey")
        return found.select(F.lit(k).alias("request"), F.lit(filters.to_query(parsed)).alias("canonical"), "p_partkey")

    return reduce(DataFrame.union, (answer(k, r) for k, r in enumerate(REQUESTS)))


SEARCHES = ["4006381333931", "036000291452", "the red Brand#2", "bolt & ring", "4006381333932", "   "]


@query("""
WITH coded AS (SELECT *, CASE p_partkey % 50 WHEN 0 THEN '4006381333931' WHEN 1 THEN '0036000291452' ELSE 'none' END AS code FROM part)
SELECT 0 AS search, p_partkey FROM coded WHERE code = '4006381333931'
UNION ALL SELECT 1, p_partkey FROM coded WHERE code = '0036000291452'
UNION ALL SELECT 2, p_partkey FROM coded WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')) AND (contains(lower(p_name), 'brand') OR contains(lower(p_brand), 'brand'))
UNION ALL SELECT 3, p_partkey FROM coded WHERE (contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt')) AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring'))
UNION ALL SELECT 4, p_partkey FROM coded WHERE contains(lower(p_name), '4006381333932') OR contains(lower(p_brand), '4006381333932')""")
def q_search_dispatch(spark, sf_dir):
    """P10: a barcode finds its part, words find names and brands, a false barcode is only a word."""
    code = F.when(F.col("p_partkey") % 50 == 0, "4006381333931").when(F.col("p_partkey") % 50 == 1, "0036000291452").otherwise("none")
    coded = load(spark, sf_dir, "part").withColumn("code", code)
    found = (coded.where(filters._predicate(filters.normal(filters.dispatched(s, "code", "p_name", "p_brand")))).select(F.lit(k).alias("search"), "p_partkey") for k, s in enumerate(SEARCHES))
    return reduce(DataFrame.union, found)


FEED_SQL = """
lines AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY l_orderkey)"""


def feed(spark, sf_dir):
    """Orders with their lines as JSON texts; some lines have fields that others lack, some orders are no JSON."""
    orders, lineitem = load(spark, sf_dir, "orders", "lineitem")
    line = F.struct(F.col("l_linenumber").alias("no"), F.struct(F.col("l_quantity").cast("int").alias("pieces"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("back")).alias("how"))
    held = lineitem.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))  # the lines of one order
    joined = orders.join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("head"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey")).alias("id"), "lines"))
    return joined.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 5, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text).alias("text"))


@query(f"""
WITH {FEED_SQL}, o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, coalesce(n, 0) AS n, coalesce(r, 0) AS r FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 5),
l AS (SELECT lineitem.* FROM lineitem JOIN o ON l_orderkey = o_orderkey),
p AS (
  SELECT '$' AS path, 'OBJECT' AS type, count(*) AS records, count(*) AS n, NULL AS w FROM o
  UNION ALL SELECT '$', 'malformed', count(*), count(*), NULL FROM orders WHERE o_orderkey % 11 = 5 HAVING count(*) > 0
  UNION ALL SELECT '$.head', 'OBJECT', count(*), count(*), NULL FROM o
  UNION ALL SELECT '$.head.status', 'STRING', count(*), count(*), string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) FROM o
  UNION ALL SELECT '$.head.priority', 'STRING', count(*), count(*), string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM o
  UNION ALL SELECT '$.id', 'BIGINT', count(*), count(*), NULL FROM o WHERE o_orderkey % 7 > 0
  UNION ALL SELECT '$.lines', 'ARRAY', count(*), count(*), NULL FROM o WHERE n > 0
  UNION ALL SELECT '$.lines[*]', 'OBJECT', count(DISTINCT l_orderkey), count(*), NULL FROM l
  UNION ALL SELECT '$.lines[*].no', 'BIGINT', count(DISTINCT l_orderkey), count(*), string_agg(DISTINCT l_linenumber::VARCHAR, '|' ORDER BY l_linenumber::VARCHAR) FROM l
  UNION ALL SELECT '$.lines[*].how', 'OBJECT', count(DISTINCT l_orderkey), count(*), NULL FROM l
  UNION ALL SELECT '$.lines[*].how.pieces', 'BIGINT', count(DISTINCT l_orderkey), count(*), NULL FROM l
  UNION ALL SELECT '$.lines[*].how.back', 'STRING', count(DISTINCT l_orderkey), count(*), string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) FROM l WHERE l_returnflag = 'R')
SELECT path, type, records, n, w AS words FROM p""")
def q_nested_census(spark, sf_dir):
    """Paths, types, presence and small vocabularies of nested records, no field named beforehand."""
    walked = census.walk(spark, feed(spark, sf_dir), "o_orderkey", "text")
    return census.census(walked, "o_orderkey").select("path", "type", "records", "n", F.array_join("words", "|").alias("words"))


@query("""
SELECT event_id, CASE WHEN try_cast(props AS JSON) IS NULL THEN NULL WHEN (props->>'k')::INT >= 50 THEN props->>'k' WHEN event_type <> 'error' THEN event_type END AS value,
  CASE WHEN try_cast(props AS JSON) IS NULL THEN NULL WHEN (props->>'k')::INT >= 50 THEN 'number' WHEN event_type <> 'error' THEN 'kind' END AS found,
  CASE WHEN try_cast(props AS JSON) IS NULL THEN 'name: absent|number: absent|kind: absent' WHEN (props->>'k')::INT >= 50 THEN 'name: absent' WHEN event_type <> 'error' THEN 'name: absent|number: small' ELSE 'name: absent|number: small|kind: an error' END AS reasons
FROM events""")
def q_probed_records(spark, sf_dir):
    """the first of several places in a nested record whose value will do, and why the ones before it won't."""
    events = load(spark, sf_dir, "events")
    record = F.try_parse_json(F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "props": '), "props", F.lit("}")))
    probes = [("name", "$.props.name", []), ("number", "$.props.k", [("small", "^[0-4]?[0-9]$")]), ("kind", "$.kind", [("an error", "^error$")])]
    return events.select("event_id", census.probed(record, probes).alias("p")).select("event_id", "p.value", "p.found", F.array_join("p.reasons", "|").alias("reasons"))


@query("""
WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 17 = 3 THEN 'many' ELSE l_quantity::INT::VARCHAR END AS q, CASE WHEN l_suppkey % 13 = 2 THEN NULL ELSE l_shipdate::DATE::VARCHAR END AS d FROM lineitem)
SELECT 'quantities' AS name, count(*) AS n, sum(q::BIGINT)::BIGINT AS total FROM raw WHERE q <> 'many'
UNION ALL SELECT 'undated', count(*), sum(l_linenumber)::BIGINT FROM raw WHERE q <> 'many' AND d IS NULL
UNION ALL SELECT 'refused', count(*), sum(l_linenumber)::BIGINT FROM raw WHERE q = 'many'""")
def q_published(spark, sf_dir):
    """A feed converted into two tables, published together with the rows that don't convert, and read through the manifest."""
    lineitem = load(spark, sf_dir, "lineitem")
    quantity = F.when(F.col("l_partkey") % 17 == 3, "many").otherwise(F.col("l_quantity").cast("int").cast("string"))
    raw = lineitem.select("l_orderkey", "l_linenumber", quantity.alias("q"), F.when(F.col("l_suppkey") % 13 != 2, F.col("l_shipdate").cast("date").cast("string")).alias("d"))
    publication = Publication(spark, shared_path(spark, "published"))
    tables = {"quantities": lambda rows: rows.select("l_orderkey", F.col("q").alias("amount")), "undated": lambda rows: rows.where("d IS NULL").select("l_orderkey", F.col("l_linenumber").cast("long").alias("amount"))}
    ingest(publication, "first", raw, {"q": "bigint", "d": "date"}, tables)
    amounts = [publication.table(n).select(F.lit(n).alias("name"), "amount") for n in tables]
    refused = publication.table("refused").select(F.lit("refused").alias("name"), F.col("l_linenumber").cast("long").alias("amount"))
    return reduce(DataFrame.union, [*amounts, refused]).groupBy("name").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
