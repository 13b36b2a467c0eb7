"""Queries of sections E, F, G, H and I over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import cohort as C
from strandwise.operators import facets as E
from strandwise.operators import ranking as R
from strandwise.operators import windows as G

from .aggregates import CELLS_SQL, cells
from .joins import CLOSURE_SQL, closure
from .registry import Tables, query

FACTS = """(SELECT o_orderkey, o_custkey, o_orderstatus AS status, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, year(o_orderdate)::varchar AS year, o_totalprice, trunc(o_totalprice)::bigint AS w FROM orders)"""


def facts(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority"), F.year("o_orderdate").cast("string").alias("year"), "o_totalprice", F.col("o_totalprice").cast("long").alias("w"))


_S, _P = "status IN ('F')", "priority IN ('1-URGENT', '2-HIGH')"


@query("facets", f"""
SELECT 'status' AS field, status AS value, count(*) AS n FROM {FACTS} WHERE {_P} GROUP BY status
UNION ALL SELECT 'priority', priority, count(*) FROM {FACTS} WHERE {_S} AND priority IS NOT NULL GROUP BY priority
UNION ALL SELECT 'year', year, count(*) FROM {FACTS} WHERE {_S} AND {_P} GROUP BY year
UNION ALL SELECT 'total', '', count(*) FROM {FACTS} WHERE {_S} AND {_P}""")
def _(t):
    filters = {"status": F.col("status").isin("F"), "priority": F.col("priority").isin("1-URGENT", "2-HIGH")}
    return E.facets(facts(t), filters, ["status", "priority", "year"])


@query("sample_facets", """
SELECT 'l_returnflag' AS field, l_returnflag AS value, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus', l_linestatus, count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus
UNION ALL SELECT 'total', '', count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")
def _(t):
    filters = {"l_returnflag": F.col("l_returnflag") == "R", "l_linestatus": F.col("l_linestatus") == "F"}
    return E.facets(t.lineitem, filters, ["l_returnflag", "l_linestatus"], parent="l_orderkey")


@query("array_facet", "SELECT o_orderpriority AS value, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def _(t):
    groups = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return E.array_facet(groups, "o_custkey", "p", 3)


@query("threshold_facet", """
SELECT CASE WHEN o_totalprice >= 400000 THEN 400000.0::double WHEN o_totalprice >= 100000 THEN 100000.0 WHEN o_totalprice >= 10000 THEN 10000.0 END AS bucket, count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    return E.threshold_facet(t.orders, "o_totalprice", [10000, 100000, 400000])


@query("bin_facet", """
SELECT CASE WHEN l_quantity >= 40 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS place, CASE WHEN l_quantity >= 40 THEN '40+' WHEN l_quantity >= 10 THEN '10-40' ELSE '2-10' END AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 2 GROUP BY ALL""")
def _(t):
    return E.bin_facet(t.lineitem, "l_quantity", [2, 10, 40])


@query("facet_unknown", """
WITH r AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT quality AS value, count(*) AS n, (SELECT count(quality) FROM r) AS known, (SELECT count(*) FILTER (WHERE quality IS NULL) FROM r) AS unknown FROM r WHERE quality IS NOT NULL GROUP BY 1""")
def _(t):
    return E.facet_unknown(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality")


def _weighted(fields):
    return " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}::varchar, 'unknown') AS value, sum(weight)::bigint AS weight, count(DISTINCT o_orderkey) AS samples FROM c GROUP BY 2" for f in fields)


_C = f"WITH c AS (SELECT l_returnflag, l_linestatus, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, weight, o_orderkey, o_custkey FROM {CELLS_SQL})"


@query("weighted_facets", f"{_C} {_weighted(['l_returnflag', 'l_linestatus', 'priority'])}")
def _(t):
    rows = cells(t).withColumn("priority", F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")))
    return E.weighted_facets(rows, ["l_returnflag", "l_linestatus", "priority"], "weight", "o_orderkey")


_ENTRY = "l_returnflag IN ('R', 'A') AND NOT coalesce(priority IN ('5-LOW'), false)"


@query("entry_weighted_search", f"""
{_C}, f AS (SELECT * FROM c WHERE {_ENTRY})
SELECT 'total' AS field, '' AS value, sum(weight)::bigint AS weight, count(DISTINCT o_orderkey) AS samples FROM f UNION ALL {_weighted(['l_returnflag', 'l_linestatus', 'priority']).replace('FROM c', 'FROM f')}""")
def _(t):
    from strandwise.operators.predicates import filter_tree

    rows = cells(t).withColumn("priority", F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")))
    rows = filter_tree(rows, {"and": [{"l_returnflag": ["R", "A"]}, {"not_priority": ["5-LOW"]}]}).withColumn("total", F.lit(""))
    return E.weighted_facets(rows, ["total", "l_returnflag", "l_linestatus", "priority"], "weight", "o_orderkey")


@query("flag_facet", """
WITH f AS (SELECT unnest(CASE WHEN l_returnflag <> 'R' AND l_quantity <= 40 AND l_discount < 0.05 THEN ['unknown'] ELSE list_filter([CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount >= 0.05 THEN 'cheap' END], lambda x: x IS NOT NULL) END) AS flag, l_quantity::bigint AS w FROM lineitem)
SELECT flag, sum(w)::bigint AS weight, count(*) AS n FROM f GROUP BY 1""")
def _(t):
    return E.flag_facet(t.lineitem, {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 40, "cheap": F.col("l_discount") >= 0.05}, "l_quantity")


@query("contributing_terms", f"""
SELECT 'N:' || c_nationkey AS term, sum(trunc(c_acctbal)::bigint)::bigint AS weight FROM customer WHERE 'N:' || c_nationkey IN (SELECT term FROM {CLOSURE_SQL} WHERE ancestor IN ('R:1', 'N:0')) GROUP BY 1 HAVING sum(trunc(c_acctbal)::bigint) > 0""")
def _(t):
    return E.contributing_terms(t.customer.withColumn("term", F.concat(F.lit("N:"), "c_nationkey")), closure(t), "term", ["R:1", "N:0"], "c_acctbal")


@query("top_vocab", "SELECT lower(trim(p_name)) AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def _(t):
    return E.top_vocab(t.part, "p_name", 10)


CLAUSES = [C.Clause("status", "include", "status", ("F", "O")), C.Clause("low", "exclude", "priority", ("5-LOW",)), C.Clause("years", "include", "year", ("1996", "1997", "2099")), C.Clause("stated", "require", "priority", ())]
_PASS = {"status": "coalesce(status IN ('F', 'O'), false)", "low": "NOT coalesce(priority = '5-LOW', false)", "years": "year IN ('1996', '1997')", "stated": "priority IS NOT NULL"}
_ALL = " AND ".join(_PASS.values())


def _without(name):
    return " AND ".join(v for k, v in _PASS.items() if k != name)


@query("resolve_cohort", f"""
WITH m AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM {FACTS} WHERE {_ALL})
SELECT count(*) AS samples, count(DISTINCT o_custkey) AS studies, sum(w)::bigint AS weight FROM m WHERE n >= 2""")
def _(t):
    return C.resolve_cohort(facts(t), CLAUSES, "o_custkey", "w", 2)


@query("min_group_size", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def _(t):
    return C.min_group_size(t.orders, "o_custkey", 12).select("o_orderkey", "o_custkey")


def _totals(name, where):
    return f"SELECT '{name}' AS clause, coalesce(sum(n), 0)::bigint AS samples, coalesce(sum(w), 0)::bigint AS weight FROM (SELECT o_custkey, count(*) AS n, sum(w) AS w FROM {FACTS} WHERE {where} GROUP BY 1 HAVING count(*) >= 2)"


@query("what_if", "WITH x AS (" + " UNION ALL ".join([_totals("(all)", _ALL)] + [_totals(k, _without(k)) for k in _PASS]) + ") SELECT *, samples - (SELECT samples FROM x WHERE clause = '(all)') AS gain FROM x")
def _(t):
    return C.what_if(facts(t), CLAUSES, "o_custkey", "w", 2)


@query("unknown_by_attr", " UNION ALL ".join(f"SELECT '{c.name}' AS clause, count(*) AS unknown FROM {FACTS} WHERE {_without(c.name)} AND {c.attr} IS NULL" for c in CLAUSES))
def _(t):
    return C.unknown_by_attr(facts(t), CLAUSES)


@query("ambiguities", f"""
WITH l AS (SELECT unnest(['status', 'priority', 'year']) AS attr, unnest([status, priority, year]) AS value FROM {FACTS}), c AS (SELECT attr, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT attr, n / sum(n) OVER (PARTITION BY attr) AS s FROM c) SELECT attr, count(*) AS values FROM s WHERE s >= 0.05 GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    return C.ambiguities(facts(t), ["status", "priority", "year"])


@query("unmatched_values", "SELECT 'years' AS clause, '2099' AS value")
def _(t):
    return C.unmatched_values(facts(t), CLAUSES)


@query("relaxations", " UNION ALL ".join(f"SELECT '{k}' AS clause, (SELECT coalesce(sum(w), 0)::bigint FROM {FACTS} WHERE {v}) AS alone, (SELECT coalesce(sum(w), 0)::bigint FROM {FACTS} WHERE {_without(k)}) AS without" for k, v in _PASS.items()))
def _(t):
    return C.relaxations(facts(t), CLAUSES, "w")


@query("suggestions", " UNION ALL ".join(f"SELECT 'drop' AS action, '{k}' AS clause, (SELECT count(*) FROM {FACTS} WHERE {_without(k)}) AS total" for k in _PASS))
def _(t):
    return C.suggestions(facts(t), CLAUSES)


@query("page_with_totals", """
SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT sum(trunc(o_totalprice)::bigint) FROM orders)::bigint AS total_weight FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def _(t):
    return G.page_with_totals(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20, "o_totalprice").select("o_orderkey", "total", "total_weight")


_LINE_ORDER = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@query("first_n_per_group", f"SELECT l_orderkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) <= 3")
def _(t):
    return G.first_n_per_group(t.lineitem, "l_orderkey", [F.col(c) for c in _LINE_ORDER], 3).select("l_orderkey", "l_extendedprice")


@query("best_fact", f"SELECT l_orderkey, l_returnflag, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, {', '.join(_LINE_ORDER)}, l_returnflag) = 1")
def _(t):
    return G.best_fact(t.lineitem, "l_orderkey", [F.desc("l_discount"), *(F.col(c) for c in _LINE_ORDER), F.col("l_returnflag")]).select("l_orderkey", "l_returnflag", "l_discount")


@query("runs", """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber::bigint AS p FROM lineitem), i AS (SELECT *, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS g FROM d)
SELECT l_orderkey, min(p) AS start, count(*) AS length FROM i GROUP BY l_orderkey, g""")
def _(t):
    return G.runs(t.lineitem, "l_orderkey", "l_linenumber")


@query("coalesce_ranges", """
WITH r AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + ceil(value)::bigint * 60 AS e FROM events),
n AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3600 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM n)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS n, max(e) - min(s) AS covered, sum(e - s)::bigint AS payload FROM g GROUP BY user_id, g""")
def _(t):
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    rows = t.events.select("user_id", start.alias("s"), (start + F.ceil("value").cast("long") * 60).alias("e"))
    return G.coalesce_ranges(rows, "user_id", "s", "e", 3600)


def _sizes(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("size"))


@query("prefix_allocation", """
WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY size DESC, o_custkey) AS r, sum(size) OVER (ORDER BY size DESC, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM s)
SELECT o_custkey, size FROM r WHERE r <= (SELECT max(r) FROM r WHERE r = 1 OR total <= 3000 OR size * 3000 / total >= 3)""")
def _(t):
    return G.prefix_allocation(_sizes(t), "o_custkey", "size", 3000, 3)


ROBUST_SQL = """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, ln(o_totalprice) AS l FROM orders WHERE o_totalprice > 0),
m AS (SELECT o_custkey, median(l) AS m, median(o_totalprice) AS raw FROM r GROUP BY 1 HAVING count(*) >= 4),
d AS (SELECT o_custkey, median(abs(l - m)) * 1.4826 AS d FROM r JOIN m USING (o_custkey) GROUP BY 1),
z AS (SELECT o_custkey, o_orderkey, (l - m) / CASE WHEN d = 0 THEN 0.15 ELSE d END AS z, o_totalprice, raw FROM r JOIN m USING (o_custkey) JOIN d USING (o_custkey))
"""


@query("robust_z", ROBUST_SQL + "SELECT o_custkey, o_orderkey, round(z, 4) AS z, z < -4 AND o_totalprice < raw / 5 AS outlier FROM z")
def _(t):
    return G.robust_z(t.orders, "o_custkey", "o_totalprice").select("o_custkey", "o_orderkey", F.round("z", 4).alias("z"), "outlier")


@query("sorted_page", "SELECT o_orderkey, priority FROM (SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders) ORDER BY priority DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25")
def _(t):
    sorts = {"priority": F.col("priority").desc_nulls_last(), "total": F.col("o_totalprice").desc_nulls_last()}
    rows = facts(t).withColumn("minus", -F.col("o_totalprice"))
    return R.sorted_page(rows, sorts, "priority", ["minus", "o_orderkey"], 2, 25).select("o_orderkey", "priority")


@query("accession_order", "SELECT c_name, regexp_extract(c_name, '([0-9]+)$', 1)::bigint AS number FROM customer ORDER BY number LIMIT 50")
def _(t):
    return R.accession_order(t.customer, "c_name").limit(50).select("c_name", R.accession_number("c_name").alias("number"))


@query("rank_onehot", f"""
WITH s AS (SELECT o_orderkey, round(CASE WHEN (status IS NOT NULL)::int + (priority IS NOT NULL)::int > 0 THEN
  ((CASE WHEN status = 'F' THEN 2.0::double ELSE 0 END) + (CASE WHEN priority = '1-URGENT' THEN 1.0::double WHEN priority = '2-HIGH' THEN 0.5 ELSE 0 END)) / (sqrt((status IS NOT NULL)::int + (priority IS NOT NULL)::int) * sqrt(5.25::double)) ELSE 0 END, 6) AS score FROM {FACTS})
SELECT o_orderkey, score FROM s WHERE score > 0 ORDER BY score DESC, o_orderkey LIMIT 30""")
def _(t):
    return R.rank_onehot(facts(t), "o_orderkey", {"status": {"F": 2.0}, "priority": {"1-URGENT": 1.0, "2-HIGH": 0.5}}, 30)


@query("cursor_page", "SELECT DISTINCT l_suppkey, l_partkey, l_orderkey FROM lineitem WHERE (l_suppkey, l_partkey, l_orderkey) > (3, 500, 100) ORDER BY ALL LIMIT 40")
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey").distinct()
    return R.cursor_page(rows, ["l_suppkey", "l_partkey", "l_orderkey"], [3, 500, 100], 40)


@query("rank_groups", """
SELECT o_custkey, sum(trunc(o_totalprice)::bigint)::bigint AS weight, row_number() OVER (ORDER BY sum(trunc(o_totalprice)::bigint) DESC, o_custkey) AS place FROM orders GROUP BY 1 ORDER BY place LIMIT 25""")
def _(t):
    return R.rank_groups(t.orders, "o_custkey", "o_totalprice", "weight", 25)


@query("top_studies", "SELECT o_custkey, sum(trunc(o_totalprice)::bigint)::bigint AS weight, true AS truncated FROM orders GROUP BY 1 ORDER BY weight DESC, o_custkey LIMIT 10")
def _(t):
    return R.top_studies(t.orders, "o_custkey", "o_totalprice", 10)


@query("hit_union", "SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM documents WHERE n_chars > 3000")
def _(t):
    return R.hit_union(t.documents.where("lang = 'fr'").select("doc_id"), t.documents.where("n_chars > 3000").select("doc_id"))


@query("merge_scores", """
WITH a AS (SELECT doc_id, n_chars % 100 AS s FROM documents WHERE lang = 'fr'), b AS (SELECT conv_id AS doc_id, length(text) % 100 AS s FROM conversations)
SELECT doc_id, max(x) AS a_score, max(y) AS b_score, count(y) AS matches FROM (SELECT doc_id, s AS x, NULL AS y FROM a UNION ALL SELECT doc_id, NULL, s FROM b) GROUP BY 1""")
def _(t):
    a = t.documents.where("lang = 'fr'").select("doc_id", (F.col("n_chars") % 100).alias("score"))
    b = t.conversations.select(F.col("conv_id").alias("doc_id"), (F.length("text") % 100).cast("long").alias("score"))
    return R.merge_scores(a, b, "doc_id")


@query("mask_ops", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000)
SELECT (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS both, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_a""")
def _(t):
    return R.mask_ops(t.orders.where("o_orderstatus = 'P'").select("o_custkey"), t.orders.where("o_totalprice > 400000").select("o_custkey"))


@query("carry_dedupe", """
WITH x AS (SELECT c_custkey, c_acctbal, 0 AS tier FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, c_acctbal, 1 FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, c_acctbal, min(tier) AS tier FROM x GROUP BY ALL ORDER BY tier, c_acctbal, c_custkey LIMIT 100""")
def _(t):
    return R.carry_dedupe([t.customer.where("c_nationkey = 3"), t.customer.where("c_mktsegment = 'BUILDING'")], "c_custkey", ["c_acctbal"], 100)
