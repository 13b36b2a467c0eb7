"""Queries of section B over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import predicates as P

from .registry import Tables, query

EDGES = [0, 1000, 5000, 20000, 100000]


def known_orders(t: Tables):
    return t.orders.withColumn("priority", F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))).withColumn("year", F.year("o_orderdate"))


@query("filter_tree", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag IN ('R', 'A') AND NOT coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED') IN ('5-LOW'), false)
  AND (l_quantity BETWEEN 10 AND 20 OR o_orderstatus = 'P')""")
def _(t):
    rows = t.lineitem.join(known_orders(t), F.col("l_orderkey") == F.col("o_orderkey"))
    spec = {"and": [
        {"l_returnflag": ["R", "A"]},
        {"not": {"field": "priority", "values": ["5-LOW"]}},
        {"or": [{"field": "l_quantity", "min": 10, "max": 20}, {"field": "o_orderstatus", "is": "P"}]},
    ]}
    return P.filter_tree(rows, spec).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "priority")


def _statuses(t):
    return t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("statuses"))


@query("match_any", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus IN ('P')")
def _(t):
    return _statuses(t).where(P.match_any("statuses", ["P"])).select("o_custkey")


@query("match_all", "SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 2")
def _(t):
    return _statuses(t).where(P.match_all("statuses", ["F", "P"])).select("o_custkey")


@query("in_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def _(t):
    return t.orders.where(P.in_range("o_totalprice", 1000, 50000)).select("o_orderkey", "o_totalprice")


@query("bin_label", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN '100000+' WHEN o_totalprice >= 20000 THEN '20000-100000'
  WHEN o_totalprice >= 5000 THEN '5000-20000' WHEN o_totalprice >= 1000 THEN '1000-5000' WHEN o_totalprice >= 0 THEN '0-1000' END AS bin
FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", P.bin_label("o_totalprice", EDGES).alias("bin"))


@query("binned_range", "SELECT o_orderkey, 1000 AS covered_from, 20000 AS covered_to FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 20000")
def _(t):
    return P.binned_range(t.orders, "o_totalprice", EDGES, 2500, 9000).select("o_orderkey", "covered_from", "covered_to")


@query("flags_any", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag = 'R' OR (l_returnflag <> 'R' AND l_linestatus <> 'F' AND l_quantity <= 40)""")
def _(t):
    flags = F.when(F.col("l_returnflag") == "R", 1).otherwise(0) + F.when(F.col("l_linestatus") == "F", 2).otherwise(0) + F.when(F.col("l_quantity") > 40, 4).otherwise(0)
    return t.lineitem.where(P.flags_any(flags, ["returned", "unknown"], {"returned": 1, "filled": 2, "large": 4})).select("l_orderkey", "l_linenumber", "l_quantity")


@query("row_filter", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity + l_tax BETWEEN 5 AND 40 AND greatest(l_discount, l_tax) >= 0.05
  AND lower(l_returnflag) IN ('r', 'n') AND l_quantity <> 7 AND lower(l_linestatus) <> 'f'""")
def _(t):
    where = [("l_returnflag", "in", ["R", "N"]), ("l_quantity", "!=", 7), ("l_linestatus", "!=", "F")]
    return P.row_filter(t.lineitem, ("l_quantity", "l_tax"), ("l_discount", "l_tax"), 5, 40, 0.05, where).select("l_orderkey", "l_linenumber", "l_quantity")


FACTS_SQL = """(SELECT doc_id, quality AS value, CASE doc_id % 3 WHEN 0 THEN 'geo' WHEN 1 THEN 'pipeline' ELSE 'model' END AS source,
  (doc_id % 10) / 10.0::double AS confidence FROM labels)"""


def label_facts(t: Tables):
    source = F.when(F.col("doc_id") % 3 == 0, "geo").when(F.col("doc_id") % 3 == 1, "pipeline").otherwise("model")
    return t.labels.select("doc_id", F.col("quality").alias("value"), source.alias("source"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"))


@query("source_gate", f"SELECT doc_id, value, source FROM {FACTS_SQL} WHERE source = 'geo' OR (source = 'model' AND confidence >= 0.5)")
def _(t):
    return P.source_gate(label_facts(t), ["geo", "model>=0.5"]).select("doc_id", "value", "source")


@query("downloadable", """
SELECT c_custkey, coalesce(f, false) AND coalesce(n, 0) >= 2 AND c_custkey % 53 <> 0 AS downloadable
FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, bool_or(o_totalprice > 200000) AS f FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.bool_or(F.col("o_totalprice") > 200000).alias("f"))
    ok = P.downloadable(F.col("f"), F.col("n"), F.lit(None).cast("boolean"), F.col("c_custkey") % 53 == 0, 2)
    return t.customer.join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", ok.alias("downloadable"))


@query("text_accessions", """
SELECT DISTINCT doc_id, upper(unnest(regexp_extract_all(coalesce(text, ''), '(?i)\\b((?:mail|be|cf)[0-9]{1,})\\b', 1))) AS accession FROM documents""")
def _(t):
    return P.text_accessions(t.documents, "doc_id", "text", ["mail", "be", "cf"])


@query("min_weight", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 123456")
def _(t):
    return P.min_weight(t.orders, "o_totalprice", 123456).select("o_orderkey", "o_totalprice")


@query("quantised_range", """
SELECT event_id, floor(least(greatest(value / 100.0, 0.0), 1.0) * 254 + 0.5)::bigint AS code FROM events
WHERE floor(least(greatest(value / 100.0, 0.0), 1.0) * 254 + 0.5) BETWEEN 51 AND 127""")
def _(t):
    return t.events.where(P.quantised_range("value", 20.0, 50.0, 100.0)).select("event_id", P.quantised("value", 100.0).cast("long").alias("code"))


@query("like_bucket", """
SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_name LIKE 'a%' OR p_name LIKE 'a%' THEN 'a' ELSE 'other' END AS bucket FROM part""")
def _(t):
    bucket = F.when(P.like_bucket("p_type", [("%STEEL%", "steel")], "") == "steel", "steel").otherwise(P.like_bucket("p_name", [("a%", "a")], "other"))
    return t.part.select("p_partkey", bucket.alias("bucket"))


@query("closed_vocab", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS priority FROM orders")
def _(t):
    return t.orders.select("o_orderkey", P.closed_vocab("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("priority"))


@query("search_filters", """
WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p, count(*) AS n, sum(o_totalprice::decimal(18,2)) AS total FROM orders GROUP BY o_custkey),
m AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 50000 GROUP BY o_custkey HAVING count(*) >= 2)
SELECT o_custkey, c_mktsegment, n FROM g JOIN customer ON c_custkey = o_custkey
WHERE list_has_any(p, ['1-URGENT', '2-HIGH']) AND n BETWEEN 3 AND 12 AND c_mktsegment = 'BUILDING' AND o_custkey IN (SELECT o_custkey FROM m)""")
def _(t):
    groups = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("priorities"), F.count("*").alias("n"))
    groups = groups.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    spec = {"any": {"priorities": ["1-URGENT", "2-HIGH"]}, "ranges": {"n": (3, 12)}, "equals": {"c_mktsegment": "BUILDING"},
            "member": {"and": [{"o_orderstatus": ["F"]}, {"field": "o_totalprice", "min": 50000}]}, "member_least": 2}
    return P.search_filters(groups, t.orders, "o_custkey", spec).select("o_custkey", "c_mktsegment", "n")


@query("sample_filters", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 20000 AND o_orderkey % 97 <> 0""")
def _(t):
    bad = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, 2).when(F.col("o_orderkey") % 89 == 0, 1).otherwise(0).alias("tier"))
    samples = t.orders.withColumn("status", F.col("o_orderstatus"))
    return P.sample_filters(samples, bad, "o_orderkey", {"where": {"field": "o_totalprice", "min": 20000}}, ["F", "O"], with_low=True).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("list_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 90000")
def _(t):
    out = P.list_filter(t.orders, {"o_orderstatus": "O"}, {"o_totalprice": (None, 90000)}, "o_totalprice", ["o_totalprice", "o_orderdate"], ["o_orderkey"], "o_orderdate")
    return out.select("o_orderkey", "o_totalprice")
