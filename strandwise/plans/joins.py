"""Queries of section C over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import joins as J

from .registry import Tables, query

SERVED = "o_orderkey % 97 <> 0 AND o_custkey % 53 <> 0"


def served_orders(t: Tables):
    excluded = t.orders.where("o_orderkey % 97 = 0")
    withheld = t.customer.where("c_custkey % 53 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.served(t.orders, excluded, withheld, "o_orderkey", "o_custkey")


def closure(t: Tables):
    """Nation below region below root, selves included: term, ancestor, distance."""
    n, r = F.concat(F.lit("N:"), F.col("n_nationkey")), F.concat(F.lit("R:"), F.col("n_regionkey"))
    up = t.nation.select(F.explode(F.array(F.struct(n.alias("term"), n.alias("ancestor"), F.lit(0).alias("distance")), F.struct(n.alias("term"), r.alias("ancestor"), F.lit(1).alias("distance")), F.struct(n.alias("term"), F.lit("ROOT").alias("ancestor"), F.lit(2).alias("distance")))).alias("x")).select("x.*")
    q = F.concat(F.lit("R:"), F.col("r_regionkey"))
    mid = t.region.select(F.explode(F.array(F.struct(q.alias("term"), q.alias("ancestor"), F.lit(0).alias("distance")), F.struct(q.alias("term"), F.lit("ROOT").alias("ancestor"), F.lit(1).alias("distance")))).alias("x")).select("x.*")
    return up.unionByName(mid)


CLOSURE_SQL = """(SELECT 'N:' || n_nationkey AS term, unnest(['N:' || n_nationkey, 'R:' || n_regionkey, 'ROOT']) AS ancestor, unnest([0, 1, 2]) AS distance FROM nation
  UNION ALL SELECT 'R:' || r_regionkey, unnest(['R:' || r_regionkey, 'ROOT']), unnest([0, 1]) FROM region)"""


@query("weighted_join", f"""
SELECT o_orderpriority, sum(l_quantity::bigint) AS weight, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {SERVED} GROUP BY 1""")
def _(t):
    return J.weighted_join(t.lineitem, served_orders(t), "l_orderkey", "o_orderkey").groupBy("o_orderpriority").agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"), F.count("*").alias("n"))


@query("semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(t):
    return J.semi_join(t.orders, t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey", "o_custkey")


@query("served", f"SELECT o_orderkey, o_custkey FROM orders WHERE {SERVED}")
def _(t):
    return served_orders(t).select("o_orderkey", "o_custkey")


@query("descendant_join", "SELECT c_custkey, 'N:' || c_nationkey AS term FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_nationkey = 2")
def _(t):
    facts = t.customer.select("c_custkey", F.concat(F.lit("N:"), F.col("c_nationkey")).alias("term"))
    return J.descendant_join(facts, closure(t), "term", ["R:1", "N:2"]).select("c_custkey", "term")


NAMES = [("bolts", "T:1", 3), ("bolt", "T:1", 2), ("ring", "T:2", 2), ("widget", "T:3", 1), ("gear", "T:4", 3), ("brass", "T:5", 2), ("plate", "T:6", 2), ("t:9", "T:9", 0)]
_VALUES = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in NAMES)


def labels(t: Tables):
    return t.spark.createDataFrame(NAMES, "name string, term_id string, tier int")


def part_words(t: Tables):
    return t.part.select(F.element_at(F.split("p_name", " "), 2).alias("value"))


_WORDS = "(SELECT DISTINCT split_part(p_name, ' ', 2) AS value FROM part)"


@query("resolve_labels", f"""
WITH asked AS (SELECT value || 's' AS value FROM {_WORDS}),
forms AS (SELECT value, lower(value) AS name, 0 AS form FROM asked UNION ALL
  SELECT value, regexp_replace(lower(value), 'ies$', 'y'), 1 FROM asked WHERE value LIKE '%ies' UNION ALL
  SELECT value, regexp_replace(lower(value), 'es$', ''), 2 FROM asked WHERE value LIKE '%es' UNION ALL
  SELECT value, regexp_replace(lower(value), 's$', ''), 3 FROM asked WHERE value LIKE '%s' AND value NOT LIKE '%ss'),
hits AS (SELECT value, term_id, tier, row_number() OVER (PARTITION BY value ORDER BY form > 0, tier, form, term_id) AS r FROM forms JOIN (VALUES {_VALUES}) l(name, term_id, tier) USING (name))
SELECT value, term_id, tier FROM asked LEFT JOIN (SELECT * FROM hits WHERE r = 1) USING (value)""")
def _(t):
    return J.resolve_labels(part_words(t).select(F.concat("value", F.lit("s")).alias("value")), labels(t))


@query("unique_tier_lookup", """
WITH l AS (SELECT DISTINCT p_name || ' ' || p_size AS value, p_brand AS term_id, p_partkey % 3 AS tier FROM part WHERE p_partkey % 4 <> 0),
b AS (SELECT *, min(tier) OVER (PARTITION BY value) AS best FROM l)
SELECT value, min(term_id) AS term_id, tier FROM b WHERE tier = best GROUP BY value, tier HAVING count(*) = 1""")
def _(t):
    name = F.concat_ws(" ", "p_name", "p_size")
    known = t.part.where("p_partkey % 4 != 0").select(name.alias("name"), F.col("p_brand").alias("term_id"), (F.col("p_partkey") % 3).alias("tier"))
    return J.unique_tier_lookup(t.part.select(name.alias("value")), known)


BANDS = [(1, 0.0, 100000.0), (2, 50000.0, 150000.0), (3, 50000.0, 60000.0), (4, 120000.0, None), (5, 130000.0, 150000.0), (6, 130000.0, 150000.0)]


@query("narrowest_interval", """
WITH b(id, low, high) AS (VALUES (1, 0.0::double, 100000.0::double), (2, 50000.0, 150000.0), (3, 50000.0, 60000.0), (4, 120000.0, NULL), (5, 130000.0, 150000.0), (6, 130000.0, 150000.0)),
h AS (SELECT o_orderkey, id, row_number() OVER (PARTITION BY o_orderkey ORDER BY coalesce(high - low, 1e300), id) AS r FROM orders JOIN b ON o_totalprice >= low AND (high IS NULL OR o_totalprice < high))
SELECT o.o_orderkey, o_totalprice, h.id AS interval_id FROM orders o LEFT JOIN h ON h.o_orderkey = o.o_orderkey AND r = 1""")
def _(t):
    return J.narrowest_interval(t.orders, t.spark.createDataFrame(BANDS, "id int, low double, high double"), "o_orderkey", "o_totalprice")


@query("narrowest_of_many", """
WITH i AS (SELECT o_orderkey AS id, o_totalprice AS low, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice + o_orderkey % 97 END AS high FROM orders),
p AS (SELECT DISTINCT p_retailprice * 100 AS price FROM part),
h AS (SELECT price, arg_min(id, {'w': coalesce(high - low, 1e300), 'id': id}) AS id FROM p JOIN i ON price >= low AND (high IS NULL OR price < high) GROUP BY price)
SELECT p_partkey, p_retailprice * 100 AS price, h.id AS interval_id FROM part LEFT JOIN h ON h.price = p_retailprice * 100""")
def _(t):
    high = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice") + F.col("o_orderkey") % 97)
    intervals = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("low"), high.alias("high"))
    return J.narrowest_interval(t.part.withColumn("price", F.col("p_retailprice") * 100), intervals, "p_partkey", "price")


RULES = [("exact", "red widget", "signal"), ("contains", "bolt", "fastener"), ("contains", "red", "red"), ("contains", "ring", "seal")]


@query("first_rule", """
SELECT p_partkey, CASE WHEN lower(trim(p_name)) = 'red widget' THEN 'signal' WHEN lower(p_name) LIKE '%bolt%' THEN 'fastener' WHEN lower(p_name) LIKE '%red%' THEN 'red' WHEN lower(p_name) LIKE '%ring%' THEN 'seal' END AS grp FROM part""")
def _(t):
    return J.first_rule(t.part, RULES, "p_name", "grp").select("p_partkey", "grp")


@query("fallback_join", """
WITH f AS (SELECT l_orderkey AS o_orderkey, l_returnflag AS value, l_discount AS confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_returnflag) AS r FROM lineitem)
SELECT o.o_orderkey, coalesce(nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, ''), f.value) AS label
FROM orders o LEFT JOIN f ON f.o_orderkey = o.o_orderkey AND r = 1""")
def _(t):
    own = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("label"))
    facts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("value"), F.col("l_discount").alias("confidence"))
    return J.fallback_join(own, facts, "o_orderkey", "label").select("o_orderkey", "label")


@query("related", """
WITH one AS (SELECT * FROM customer WHERE c_custkey = 7),
hits AS (SELECT c.c_custkey, c.c_acctbal, 0 AS tier FROM customer c JOIN one ON c.c_nationkey = one.c_nationkey AND c.c_mktsegment = one.c_mktsegment
  UNION ALL SELECT c.c_custkey, c.c_acctbal, 1 FROM customer c JOIN one ON nullif(c.c_mktsegment, 'MACHINERY') = nullif(one.c_mktsegment, 'MACHINERY'))
SELECT c_custkey, c_acctbal, min(tier) AS tier FROM hits WHERE c_custkey <> 7 GROUP BY ALL ORDER BY tier, c_acctbal DESC, c_custkey LIMIT 8""")
def _(t):
    tiers = [("both", F.concat_ws("|", "c_nationkey", "c_mktsegment")), ("segment", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")))]
    return J.related(t.customer, "c_custkey", 7, tiers, "c_acctbal")


@query("matched_controls", """
WITH g AS (SELECT c_custkey, c_nationkey, c_mktsegment, floor(c_acctbal / 2000)::bigint AS band, list(DISTINCT o_orderstatus) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT g.c_custkey, CASE WHEN g.c_mktsegment = o.c_mktsegment THEN 2 ELSE 0 END + CASE WHEN g.band = o.band THEN 1 ELSE 0 END AS score
FROM g JOIN (SELECT * FROM g WHERE c_custkey = 2) o ON g.c_nationkey = o.c_nationkey
WHERE g.c_custkey <> 2 AND NOT list_contains(g.s, 'P') ORDER BY score DESC, g.c_custkey LIMIT 10""")
def _(t):
    groups = t.customer.join(t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderstatus").alias("labels")), "c_custkey").withColumn("band", F.floor(F.col("c_acctbal") / 2000))
    return J.matched_controls(groups, "c_custkey", 2, ["c_nationkey"], "labels", ["F", "O"], [("c_mktsegment", 2), ("band", 1)])


@query("ratio_mismatch", """
SELECT o_orderkey, o_totalprice, total FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::decimal(18,2))::double AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_totalprice > 3 * total OR total > 3 * o_totalprice""")
def _(t):
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return J.ratio_mismatch(t.orders, sums, "o_orderkey", "o_totalprice", "total", 3)


@query("orphans", """
WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey % 5 <> 0), c AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)
SELECT 'child' AS side, o_custkey AS key FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
UNION ALL SELECT 'parent', c_custkey FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM o)""")
def _(t):
    orders = t.orders.where("o_orderpriority != '1-URGENT' and o_custkey % 5 != 0")
    return J.orphans(orders, t.customer.where("c_custkey % 7 != 0"), "o_custkey", "c_custkey")


@query("gene_space_map", """
SELECT p_partkey, p_partkey AS from_position, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 2 END AS to_position FROM part""")
def _(t):
    a = t.part.select("p_partkey", F.col("p_partkey").alias("position"))
    b = t.part.where("p_partkey % 3 <> 0").select("p_partkey", (F.col("p_partkey") * 2).alias("position"))
    return J.gene_space_map(a, b, "p_partkey", "position")


@query("match_names", """
WITH asked AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'P' || p_partkey WHEN 1 THEN p_name WHEN 2 THEN lower('P' || p_partkey) ELSE 'none' || p_partkey END AS name FROM part WHERE p_partkey < 400),
k AS (SELECT 'P' || p_partkey AS id, p_name AS symbol FROM part),
h AS (SELECT name, 0 AS tier, min(id) AS match FROM asked JOIN k ON name = id GROUP BY 1 UNION ALL
  SELECT name, 1, min(id) FROM asked JOIN k ON name = symbol GROUP BY 1 UNION ALL
  SELECT name, 2, min(id) FROM asked JOIN k ON lower(name) = lower(id) GROUP BY 1 UNION ALL
  SELECT name, 3, min(id) FROM asked JOIN k ON lower(name) = lower(symbol) GROUP BY 1)
SELECT name, b.match AS match, b.tier AS tier FROM asked LEFT JOIN (SELECT name, min(tier) AS tier, arg_min(match, tier) AS match FROM h GROUP BY 1) b USING (name)""")
def _(t):
    id_ = F.concat(F.lit("P"), F.col("p_partkey"))
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, id_).when(k == 1, F.col("p_name")).when(k == 2, F.lower(id_)).otherwise(F.concat(F.lit("none"), F.col("p_partkey")))
    return J.match_names(t.part.where("p_partkey < 400").select(name.alias("name")), t.part.select(id_.alias("id"), F.col("p_name").alias("symbol")), "name", "id", "symbol")


@query("override_labels", """
SELECT label, sum(l_quantity::bigint) AS weight FROM (
  SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'line:' || (l_orderkey % 33) ELSE l_returnflag END AS label, l_quantity FROM lineitem) GROUP BY 1""")
def _(t):
    lines = t.orders.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("line:"), F.col("o_orderkey") % 33).alias("label"))
    fact = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("called"), "l_quantity")
    return J.override_labels(fact, lines, "l_orderkey", "called").groupBy(F.col("called").alias("label")).agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"))
