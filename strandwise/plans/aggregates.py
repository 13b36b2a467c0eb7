"""Queries of section D over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.functions.staging import scratch
from strandwise.operators import aggregates as A
from strandwise.operators.quantiles import quantiles
from strandwise.sources.stored import StoredTable, refresh

from .joins import CLOSURE_SQL, SERVED, closure, served_orders
from .registry import Tables, query

def cells(t: Tables):
    return t.lineitem.join(served_orders(t), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("weight", F.col("l_quantity").cast("long"))


CELLS_SQL = f"(SELECT *, l_quantity::bigint AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {SERVED})"


@query("totals", f"SELECT sum(weight)::bigint AS weight, count(DISTINCT o_orderkey) AS samples, count(DISTINCT o_custkey) AS studies, count(*) AS n_rows FROM {CELLS_SQL}")
def _(t):
    return A.totals(cells(t), "weight", "o_orderkey", "o_custkey")


@query("grouped_count", f"SELECT l_returnflag, l_linestatus, sum(weight)::bigint AS weight, false AS truncated FROM {CELLS_SQL} GROUP BY ALL")
def _(t):
    return A.grouped_count(cells(t), ["l_returnflag", "l_linestatus"], "weight")


_SUMMED = "SELECT l_returnflag, sum(l_quantity::bigint)::bigint AS weight, false AS truncated FROM lineitem WHERE l_linestatus IN ('F') AND {} GROUP BY 1"


def _summed(t: Tables, **more):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_discount", F.col("l_quantity").cast("long").alias("weight"))
    summary = rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("weight").alias("weight"))
    return A.grouped_count(rows, ["l_returnflag"], "weight", summary=summary, where={"l_linestatus": ["F"]}, **more)


@query("grouped_count_summary", _SUMMED.format("true"))
def _(t):
    return _summed(t)


@query("grouped_count_row_filter", _SUMMED.format("l_discount > 0.05"))
def _(t):
    return _summed(t, rows=F.col("l_discount") > 0.05)


@query("corpus_stats", """
WITH r AS (SELECT count(*)::double AS a, count(*) FILTER (WHERE o_orderstatus = 'F')::double AS d, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS v, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END)::double AS k FROM orders)
SELECT 'all' AS metric, a AS value FROM r UNION ALL SELECT 'done', d FROM r UNION ALL SELECT 'avg_done', v FROM r UNION ALL SELECT 'kinds_done', k FROM r
UNION ALL SELECT 'failure:' || o_orderpriority, count(*)::double FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderpriority""")
def _(t):
    out = A.corpus_stats(t.orders, "o_orderstatus", "o_totalprice", "o_orderpriority", "F", "P")
    return out.withColumn("value", F.round("value", 4))


@query("accounting", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS rest FROM orders")
def _(t):
    return A.accounting(t.orders, {"done": F.col("o_orderstatus") == "F", "failed": F.col("o_orderstatus") == "P"})


@query("clean_distinct", "SELECT count(DISTINCT lower(trim(p_name))) AS n_distinct FROM part WHERE p_name LIKE '% %' AND lower(p_name) <> 'red widget'")
def _(t):
    return A.clean_distinct(t.part, "p_name", ["Red Widget"])


@query("majority", """
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
def _(t):
    return A.majority(t.orders, "o_custkey", "o_orderpriority")


@query("distinct_list", """
WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM d)
SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM r WHERE r <= 3 GROUP BY 1""")
def _(t):
    return A.distinct_list(t.orders, "o_custkey", "o_orderpriority", 3).select("o_custkey", F.array_join("o_orderpriority", "|").alias("priorities"))


def qc(t: Tables):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 31 == 0, 2).when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0).alias("tier"))


QC_SQL = "(CASE WHEN o_orderkey % 31 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)"


def rollup(t: Tables):
    return A.study_rollup(served_orders(t), qc(t), "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "F")


_ROLLUP_SQL = f"""
WITH s AS (SELECT *, {QC_SQL} AS tier FROM orders WHERE {SERVED}),
m AS (SELECT o_custkey, o_orderpriority FROM s GROUP BY o_custkey, o_orderpriority QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) = 1)
SELECT s.o_custkey, count(*) AS n_total, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, coalesce(sum(trunc(o_totalprice)::bigint) FILTER (WHERE o_orderstatus = 'F'), 0)::bigint AS weight,
  count(*) FILTER (WHERE tier = 0) AS n_usable, count(*) FILTER (WHERE tier >= 1) AS n_low, coalesce(sum(trunc(o_totalprice)::bigint) FILTER (WHERE tier >= 1), 0)::bigint AS low_weight,
  any_value(m.o_orderpriority) AS main_kind, string_agg(DISTINCT s.o_orderpriority, '|' ORDER BY s.o_orderpriority) AS kinds
FROM s JOIN m USING (o_custkey) GROUP BY 1"""


@query("study_rollup", _ROLLUP_SQL)
def _(t):
    return rollup(t)


class _Orders:
    """The given tables with other orders."""

    def __init__(self, t: Tables, orders):
        self.tables, self.orders = t, orders

    def __getattr__(self, name: str):
        return getattr(self.tables, name)


@query("refreshed_rollup", _ROLLUP_SQL)
def _(t):
    """Built from former orders; then the true ones come for every customer they changed."""
    ddl = lambda df: ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    stale = F.col("o_custkey") % 9 == 0
    former = t.orders.where(~stale | (F.col("o_orderkey") % 2 == 0)).withColumn("o_totalprice", F.when(stale, F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice")))
    samples = StoredTable(t.spark, scratch(t.spark, "samples"), "o_custkey", ddl(t.orders))
    samples.create(former)
    make = lambda rows: rollup(_Orders(t, rows))
    first = make(samples.read())
    stored = StoredTable(t.spark, scratch(t.spark, "rollup"), "o_custkey", ddl(first))
    stored.create(first)
    changed = t.orders.where(stale)
    samples.replace(changed, changed, 1)
    refresh(stored, samples, changed, make, 1)
    return stored.read()


@query("rollup_drift", f"""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE {SERVED} GROUP BY 1), s AS (SELECT o_custkey, CASE WHEN o_custkey % 10 = 0 THEN n + 1 ELSE n END AS n FROM a WHERE o_custkey % 17 <> 0)
SELECT coalesce(a.o_custkey, s.o_custkey) AS o_custkey FROM a FULL JOIN s ON a.o_custkey = s.o_custkey WHERE a.n IS DISTINCT FROM s.n""")
def _(t):
    fresh = rollup(t).select("o_custkey", "n_total")
    stored = fresh.where("o_custkey % 17 <> 0").withColumn("n_total", F.when(F.col("o_custkey") % 10 == 0, F.col("n_total") + 1).otherwise(F.col("n_total")))
    return A.rollup_drift(stored, fresh, "o_custkey", ["n_total"])


@query("share_facts", """
WITH s AS (SELECT l_orderkey, l_returnflag, sum(l_quantity::bigint)::bigint AS n FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, sum(n)::bigint AS total FROM s GROUP BY 1)
SELECT l_orderkey, l_returnflag, round(n / total, 4) AS share, n || ' of ' || total AS evidence FROM s JOIN a USING (l_orderkey) WHERE total >= 50 AND n / total >= 0.4""")
def _(t):
    return A.share_facts(t.lineitem, "l_orderkey", "l_returnflag", "l_quantity", 50, 0.4)


@query("share_facts_rolled", f"""
WITH b AS (SELECT c_mktsegment, 'N:' || c_nationkey AS term, count(*) AS n FROM customer GROUP BY ALL), a AS (SELECT c_mktsegment, sum(n)::bigint AS total FROM b GROUP BY 1),
u AS (SELECT c_mktsegment, ancestor AS term, sum(n)::bigint AS n FROM b JOIN {CLOSURE_SQL} USING (term) GROUP BY ALL)
SELECT c_mktsegment, term, round(n / total, 4) AS share, n || ' of ' || total AS evidence FROM u JOIN a USING (c_mktsegment) WHERE total >= 10 AND n / total >= 0.05""")
def _(t):
    facts = t.customer.select("c_mktsegment", F.concat(F.lit("N:"), "c_nationkey").alias("term"), F.lit(1).alias("n1"))
    return A.share_facts_rolled(facts, closure(t), "c_mktsegment", "term", "n1", 10, 0.05)


@query("label_rollup", """
SELECT o_custkey, 'priority' AS attr, o_orderpriority AS value, count(DISTINCT o_orderkey) AS n_samples, max((o_orderkey % 10) / 10.0::double) AS best_confidence FROM orders GROUP BY ALL""")
def _(t):
    facts = t.orders.select("o_custkey", F.lit("priority").alias("attr"), F.col("o_orderpriority").alias("value"), "o_orderkey", ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"))
    return A.label_rollup(facts, "o_custkey", "attr", "value", "o_orderkey", "confidence")


@query("lineage_rollup", f"""
SELECT ancestor AS term, sum(trunc(c_acctbal)::bigint)::bigint AS weight FROM customer JOIN {CLOSURE_SQL} ON term = 'N:' || c_nationkey GROUP BY 1 ORDER BY weight DESC, term LIMIT 60""")
def _(t):
    return A.lineage_rollup(t.customer.withColumn("term", F.concat(F.lit("N:"), "c_nationkey")), closure(t), "term", "c_acctbal")


@query("expression_summary", """
WITH p AS (SELECT l_orderkey, p_brand, sum(l_quantity::decimal(18,2)) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
s AS (SELECT l_orderkey, sum(v) AS total FROM p GROUP BY 1), n AS (SELECT o_orderstatus, count(*) AS n_cells FROM orders GROUP BY 1)
SELECT o_orderstatus, p_brand, any_value(n_cells) AS n_cells, round(sum(v)::double / any_value(n_cells), 6) AS mean,
  round(sum(round(v::double * 10000 / total::double, 6)::decimal(28,6))::double / any_value(n_cells), 4) AS per_10k, round(count(*) FILTER (WHERE v > 0) / any_value(n_cells), 6) AS nonzero
FROM p JOIN s USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey JOIN n USING (o_orderstatus) GROUP BY ALL""")
def _(t):
    triples = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("cell"), "p_brand", "l_quantity")
    return A.expression_summary(triples, t.orders.select(F.col("o_orderkey").alias("cell"), "o_orderstatus"), "cell", "p_brand", "l_quantity", "o_orderstatus")


@query("sum_layers", "SELECT l_partkey, l_orderkey, sum(l_quantity::decimal(18,2))::double AS l_quantity FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY ALL")
def _(t):
    return A.sum_layers(t.lineitem.where("l_returnflag = 'R'"), t.lineitem.where("l_returnflag = 'A'"), "l_partkey", "l_orderkey", "l_quantity")


@query("tally", """
WITH r AS (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS v, p_partkey AS o FROM part),
c AS (SELECT p_brand, lower(trim(v)) AS f, count(*) AS n, arg_min(v, o) AS value, min(o) AS o FROM r GROUP BY ALL)
SELECT p_brand, value, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, o) AS place FROM c""")
def _(t):
    rows = t.part.withColumn("v", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")))
    return A.tally(rows, "p_brand", "v", "p_partkey")


@query("study_card", """
WITH l AS (SELECT o_custkey, o_orderkey, 'status' AS attr, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'priority', nullif(o_orderpriority, '4-NOT SPECIFIED') FROM orders),
c AS (SELECT o_custkey, attr, coalesce(value, 'not stated') AS value, count(DISTINCT o_orderkey) AS n FROM l GROUP BY ALL)
SELECT *, count(*) FILTER (WHERE value <> 'not stated') OVER (PARTITION BY o_custkey, attr) >= 2 AS axis FROM c""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority"))
    return A.study_card(rows, "o_custkey", "o_orderkey", ["status", "priority"])


@query("span_in_common_unit", """
WITH f AS (SELECT p_brand, p_size::double AS n, CASE p_partkey % 4 WHEN 0 THEN 'days' WHEN 1 THEN 'weeks' ELSE 'months' END AS unit FROM part),
k(unit, d) AS (VALUES ('days', 1.0::double), ('weeks', 7.0), ('months', 30.4375)),
m AS (SELECT p_brand, unit AS common_unit FROM f GROUP BY p_brand, unit QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, unit) = 1)
SELECT p_brand, common_unit, round(min(n * k.d / c.d), 4) AS low, round(max(n * k.d / c.d), 4) AS high FROM f JOIN m USING (p_brand) JOIN k USING (unit) JOIN k c ON c.unit = common_unit GROUP BY ALL""")
def _(t):
    unit = F.when(F.col("p_partkey") % 4 == 0, "days").when(F.col("p_partkey") % 4 == 1, "weeks").otherwise("months")
    facts = t.part.select("p_brand", F.col("p_size").cast("double").alias("n"), unit.alias("unit"))
    return A.span_in_common_unit(facts, "p_brand", "n", "unit", {"days": 1.0, "weeks": 7.0, "months": 30.4375})


@query("conditions", """
WITH l AS (SELECT o_custkey, o_orderkey, unnest(['status', 'priority', 'id']) AS k, unnest([o_orderstatus, o_orderpriority, o_orderkey::varchar]) AS v FROM orders),
c AS (SELECT o_custkey, k, v, count(DISTINCT o_orderkey) AS n FROM l GROUP BY ALL), s AS (SELECT o_custkey, k FROM c GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12 AND max(n) > 1)
SELECT o_custkey, k, v, n FROM c SEMI JOIN s USING (o_custkey, k)""")
def _(t):
    pairs = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").cast("string").alias("id"))
    return A.conditions(pairs.unpivot(["o_custkey", "o_orderkey"], ["status", "priority", "id"], "k", "v"), "o_custkey", "o_orderkey", "k", "v")


@query("completeness", """
WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS st, CASE o_orderpriority WHEN '1-URGENT' THEN 'memory' WHEN '2-HIGH' THEN 'input' ELSE 'other' END AS r FROM orders)
SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE st = 'processed') AS processed, count(*) FILTER (WHERE st = 'queued') AS queued, count(*) FILTER (WHERE st = 'failed') AS failed,
  count(*) FILTER (WHERE st = 'failed' AND r = 'input') AS failed_input, count(*) FILTER (WHERE st = 'failed' AND r = 'memory') AS failed_memory, count(*) FILTER (WHERE st = 'failed' AND r = 'other') AS failed_other,
  CASE WHEN count(*) FILTER (WHERE st = 'processed') = count(*) THEN 'complete' WHEN count(*) FILTER (WHERE st = 'queued') > 0 THEN 'in progress' WHEN count(*) FILTER (WHERE st = 'processed') > 0 THEN 'partial' ELSE 'none' END AS state
FROM s GROUP BY 1""")
def _(t):
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return A.completeness(t.orders.withColumn("status", status), "o_custkey", "status", "o_orderpriority", {"1-URGENT": "memory", "2-HIGH": "input"})


@query("layer_stats", """
WITH f AS (SELECT DISTINCT l_suppkey AS s, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'bolt' AS layer, count(DISTINCT s) FILTER (WHERE p_name LIKE '%bolt%') AS n_studies, count(DISTINCT s) FILTER (WHERE p_name LIKE '%bolt%' AND s % 2 = 0) AS n_human FROM f
UNION ALL SELECT 'red', count(DISTINCT s) FILTER (WHERE p_name LIKE '%red%'), count(DISTINCT s) FILTER (WHERE p_name LIKE '%red%' AND s % 2 = 0) FROM f""")
def _(t):
    files = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return A.layer_stats(files, "l_suppkey", "p_name", {"bolt": "bolt", "red": "red"}, F.col("l_suppkey") % 2 == 0)


_FIELDS = """(SELECT *, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, trunc(o_totalprice)::bigint AS w FROM orders)"""


def fields(t: Tables):
    return t.orders.select(F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").cast("long").alias("w"))


@query("coverage", f"""
SELECT 'priority' AS field, count(priority) AS known, sum(w) FILTER (WHERE priority IS NOT NULL)::bigint AS known_weight, round(count(priority) / count(*), 4) AS share, round(sum(w) FILTER (WHERE priority IS NOT NULL) / sum(w), 4) AS weight_share FROM {_FIELDS}
UNION ALL SELECT 'status', count(status), sum(w) FILTER (WHERE status IS NOT NULL)::bigint, round(count(status) / count(*), 4), round(sum(w) FILTER (WHERE status IS NOT NULL) / sum(w), 4) FROM {_FIELDS}""")
def _(t):
    return A.coverage(fields(t), ["priority", "status"], "w")


@query("unseen_by_filter", f"""
SELECT 'priority' AS field, count(*) FILTER (WHERE priority IS NULL) AS unseen, sum(w) FILTER (WHERE priority IS NULL)::bigint AS unseen_weight FROM {_FIELDS}
UNION ALL SELECT 'status', count(*) FILTER (WHERE status IS NULL), sum(w) FILTER (WHERE status IS NULL)::bigint FROM {_FIELDS}""")
def _(t):
    return A.unseen_by_filter(fields(t), ["priority", "status"], "w")


@query("compare", """
WITH l AS (SELECT c_custkey, unnest(['nation', 'segment', 'name', 'kind']) AS field, unnest([c_nationkey::varchar, c_mktsegment, c_name, 'customer']) AS v FROM customer WHERE c_custkey IN (3, 5, 8))
SELECT field, max(v) FILTER (WHERE c_custkey = 3) AS "3", max(v) FILTER (WHERE c_custkey = 5) AS "5", max(v) FILTER (WHERE c_custkey = 8) AS "8" FROM l GROUP BY 1 HAVING count(DISTINCT v) > 1""")
def _(t):
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    return A.compare(rows, "c_custkey", [3, 5, 8], ["nation", "segment", "name", "kind"])


@query("qc_medians", "SELECT l_suppkey, median(l_quantity) AS median_l_quantity, median(l_discount) AS median_l_discount, count(*) FILTER (WHERE l_quantity < 5) AS n_under FROM lineitem GROUP BY 1")
def _(t):
    return A.qc_medians(t.lineitem, "l_suppkey", ["l_quantity", "l_discount"], ("l_quantity", 5))


@query("quantiles_of_hot_keys", """
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS price_median, round(quantile_cont(l_extendedprice, 0.99), 4) AS price_q99, round(quantile_cont(l_quantity, 0.1), 4) AS quantity_q10 FROM lineitem GROUP BY 1""")
def _(t):
    named = {"price_median": ("l_extendedprice", 0.5), "price_q99": ("l_extendedprice", 0.99), "quantity_q10": ("l_quantity", 0.1)}
    # three keys hold all rows: a low bound takes them through the selection by rank
    out = quantiles(t.lineitem, "l_returnflag", named, [F.count("*").alias("n")], hot=1000)
    return out.withColumns({name: F.round(name, 4) for name in named})


@query("status_rollup", """
WITH c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_totalprice < 20000) AS bad, count(*) FILTER (WHERE o_orderstatus = 'P') AS op FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT c_custkey AS o_custkey, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN bad > 0 THEN 'fail' WHEN op > 0 THEN 'incomplete' ELSE 'pass' END AS state FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def _(t):
    everyone = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return A.status_rollup(t.orders, everyone, "o_custkey", F.col("o_totalprice") >= 20000, F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus") != "P")


@query("dedupe_terms", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_samples FROM orders GROUP BY 1")
def _(t):
    return A.dedupe_terms(t.orders, "o_orderpriority", "o_custkey")


@query("matrix_bytes", """
SELECT l_orderkey, sum(CASE WHEN l_returnflag IN ('A', 'N') THEN l_quantity::bigint * 1000 ELSE 0 END)::bigint AS bytes, sum(CASE WHEN l_returnflag IN ('A', 'N') THEN l_quantity::bigint * 1000 ELSE 0 END) >= 60000 AS usable FROM lineitem GROUP BY 1""")
def _(t):
    entries = t.lineitem.select("l_orderkey", F.array(F.struct(F.col("l_returnflag").alias("name"), (F.col("l_quantity").cast("long") * 1000).alias("bytes"))).alias("files"))
    return A.matrix_bytes(entries, "l_orderkey", "files", ["A", "N"], 60000)


@query("pareto", """
WITH b AS (SELECT p_retailprice, max(p_size) AS q FROM part GROUP BY 1), f AS (SELECT *, max(q) OVER (ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b)
SELECT p_partkey, p_size, part.p_retailprice FROM part JOIN f ON part.p_retailprice = f.p_retailprice AND p_size = q WHERE prev IS NULL OR q > prev""")
def _(t):
    return A.pareto(t.part, "p_partkey", "p_size", "p_retailprice")


@query("study_detail", f"""
SELECT c_custkey AS o_custkey, c_mktsegment, n_pass, n_low, n_removed, unusable, samples FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) FILTER (WHERE {QC_SQL} = 0) AS n_pass, count(*) FILTER (WHERE {QC_SQL} = 1) AS n_low, count(*) FILTER (WHERE {QC_SQL} = 2) AS n_removed,
    coalesce(string_agg(o_orderkey::varchar, '|' ORDER BY o_orderkey) FILTER (WHERE {QC_SQL} = 2), '') AS unusable, string_agg(o_orderkey::varchar, '|' ORDER BY o_orderkey) AS samples FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    study = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return A.study_detail(study, t.orders, qc(t), "o_custkey", "o_orderkey")
