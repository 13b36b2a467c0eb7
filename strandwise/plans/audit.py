"""Queries of section L over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import audit as L
from strandwise.operators import joins as J

from .facets import ROBUST_SQL
from .registry import query


def genes():
    return (F.col("o_totalprice") / 5000).cast("int").cast("double")


def mapping():
    return F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_orderkey") % 100) / 100.0)


_Q = "(SELECT *, trunc(o_totalprice / 5000)::double AS genes, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 100) / 100.0::double END AS mapping FROM orders)"


@query("qc_tier", f"SELECT o_orderkey, CASE WHEN mapping < 0.05 AND genes < 10 THEN 2 WHEN genes < 30 OR mapping < 0.2 THEN 1 ELSE 0 END AS tier FROM {_Q}")
def _(t):
    return t.orders.select("o_orderkey", L.qc_tier(genes(), mapping()).alias("tier"))


@query("qc_reasons", f"""
SELECT o_orderkey, concat_ws(', ', CASE WHEN genes < 30 THEN 'median ' || round(genes)::bigint || ' genes per cell (below 30)' END, CASE WHEN mapping < 0.2 THEN (o_orderkey % 100) || '.0% of reads mapped (below 20%)' END) AS reasons FROM {_Q}""")
def _(t):
    return t.orders.select("o_orderkey", L.qc_reasons(genes(), mapping()).alias("reasons"))


@query("count_verdict", """
SELECT o_orderkey, CASE WHEN NOT many AND cells > 200000 THEN 'suspect' WHEN plate AND cells > 5000 THEN 'suspect' WHEN NOT plate AND NOT many AND cells > 20000 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'unverified' WHEN (o_orderkey % 1000) < 500 THEN 'suspect' ELSE 'ok' END ELSE 'ok' END AS verdict
FROM (SELECT *, o_orderpriority = '1-URGENT' AS plate, o_orderpriority = '2-HIGH' AS many, o_totalprice AS cells FROM orders)""")
def _(t):
    umis = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 1000)
    return t.orders.select("o_orderkey", L.count_verdict(F.col("o_orderpriority"), F.col("o_totalprice"), umis, ["1-URGENT"], ["2-HIGH"]).alias("verdict"))


@query("study_suspect", """
SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AND sum(o_totalprice::decimal(18,2))::double / count(*) > 250000 AS suspect FROM orders GROUP BY 1""")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("families"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("cells"), F.count("*").alias("n"))
    return per.select("o_custkey", L.study_suspect(F.col("families"), F.col("cells"), F.col("n"), "1-URGENT", 250000).alias("suspect"))


@query("usable", "SELECT o_orderkey, o_totalprice >= 50000 AND o_orderkey % 5 >= 1 AS usable FROM orders")
def _(t):
    return t.orders.select("o_orderkey", L.usable(F.col("o_totalprice"), F.col("o_orderkey") % 5, 50000).alias("usable"))


_CHECKS = {
    "discount above price": (3, "l_discount > 0.09"),
    "quantity below one": (5, "l_quantity < 1"),
    "tax and discount": (2, "l_tax > l_discount"),
    "tiny quantity": (1, "l_quantity <= 2"),
}


def _check_sql(checks, table, reach):
    rows = " UNION ALL ".join(f"SELECT '{n}' AS c, count(*) FILTER (WHERE {q}) AS hits, count(*) FILTER (WHERE ({q}) AND {reach}) AS reachable, {s} AS s FROM {table}" for n, (s, q) in checks.items())
    ranked = f"SELECT c, hits, reachable, round(s * log10(hits + 1), 4) AS rank_score FROM ({rows})"
    return f'SELECT c AS "check", hits, reachable, rank_score, row_number() OVER (ORDER BY rank_score DESC, c) AS place FROM ({ranked})'


def _checks(checks):
    return [L.Check(n, s, F.expr(q)) for n, (s, q) in checks.items()]


@query("run_checks", _check_sql(_CHECKS, "lineitem", "l_returnflag <> 'N'"))
def _(t):
    return L.run_checks(t.lineitem, _checks(_CHECKS), F.col("l_returnflag") != "N")


_FAILING = {"bad price": (4, "l_extendedprice < 1000"), "text as number": (5, "cast(l_returnflag as int) > 0"), "large": (2, "l_quantity > 45"), "no divisor": (3, "l_orderkey / (l_linenumber - l_linenumber) > 1")}


@query("run_checks_each", """
WITH c AS (SELECT 'bad price' AS "check", 4 AS severity, count(*) FILTER (WHERE l_extendedprice < 1000) AS hits FROM lineitem UNION ALL SELECT 'large', 2, count(*) FILTER (WHERE l_quantity > 45) FROM lineitem),
r AS (SELECT "check", hits, hits AS reachable, round(severity * log10(hits + 1), 4) AS rank_score, NULL AS error FROM c UNION ALL SELECT 'text as number', NULL, NULL, NULL, 'CAST_INVALID_INPUT' UNION ALL SELECT 'no divisor', NULL, NULL, NULL, 'DIVIDE_BY_ZERO')
SELECT *, row_number() OVER (ORDER BY rank_score DESC NULLS LAST, "check")::int AS place FROM r""")
def _(t):
    return L.run_checks_each(t.lineitem, _checks(_FAILING))


_IMPOSSIBLE = {
    "negative total": (5, "o_totalprice < 0"),
    "fraction outside": (4, "(o_orderkey % 120) / 100.0 > 1"),
    "unique above total": (4, "o_orderkey > o_custkey * 1000"),
}


@query("check_impossible_values", _check_sql(_IMPOSSIBLE, "orders", "true"))
def _(t):
    return L.run_checks(t.orders, _checks(_IMPOSSIBLE))


@query("check_never_populated", "SELECT 'zero' AS column UNION ALL SELECT 'none'")
def _(t):
    rows = t.events.select("value", F.lit(0).alias("zero"), F.lit(None).cast("double").alias("none"), "user_id")
    return L.never_populated(rows, ["value", "zero", "none", "user_id"])


_THRESHOLDS = {
    "few": (2, "l_quantity < 3"),
    "huge": (3, "l_extendedprice > 90000"),
    "low ratio": (1, "l_extendedprice / l_quantity < 300"),
}


@query("check_thresholds", _check_sql(_THRESHOLDS, "lineitem", "true"))
def _(t):
    return L.run_checks(t.lineitem, _checks(_THRESHOLDS))


@query("check_sources_disagree", """
SELECT o_orderkey, o_totalprice, total FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::decimal(18,2))::double AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_totalprice > 10 * total OR total > 10 * o_totalprice""")
def _(t):
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return J.ratio_mismatch(t.orders, sums, "o_orderkey", "o_totalprice", "total", 10)


@query("check_missing_rows", """
SELECT 'child' AS side, l_orderkey AS key FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
UNION ALL SELECT 'parent', o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def _(t):
    return J.orphans(t.lineitem, t.orders.where("o_orderstatus != 'P'"), "l_orderkey", "o_orderkey")


@query("check_vocabulary", """
SELECT lower(trim(v)) AS folded, count(DISTINCT v) AS spellings FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 7 = 0 THEN ' ' || p_name ELSE p_name END AS v FROM part) GROUP BY 1 HAVING count(DISTINCT v) > 1""")
def _(t):
    spelled = F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    return L.case_variants(t.part.select(spelled.alias("v")), "v")


@query("check_dates_and_text", "SELECT md5(text) AS fingerprint, count(DISTINCT doc_id) AS entities FROM documents WHERE length(trim(text)) > 0 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def _(t):
    return L.duplicate_text(t.documents, "text", "doc_id")


@query("duplicate_fingerprint", "SELECT l_quantity, l_discount, l_tax, count(DISTINCT l_orderkey) AS entities, min(l_orderkey) AS first_entity FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) > 1")
def _(t):
    return L.duplicate_fingerprint(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_orderkey")


@query("peer_outliers", ROBUST_SQL + "SELECT o_orderkey FROM z WHERE z < -4 AND o_totalprice < raw / 5")
def _(t):
    return L.peer_outliers(t.orders, "o_custkey", "o_totalprice").select("o_orderkey")


@query("implausible_ratio", "SELECT o_orderkey, round(o_totalprice / (o_orderkey + 1), 6) AS ratio FROM orders WHERE round(o_totalprice / (o_orderkey + 1), 6) < 10 ORDER BY ratio, o_orderkey LIMIT 200")
def _(t):
    return L.implausible_ratio(t.orders.withColumn("n", F.col("o_orderkey") + 1), "o_orderkey", "o_totalprice", "n", 10, 200)


@query("check_species_reference", """
SELECT o_orderkey, species <> build AS mismatch FROM (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'mouse' END AS species, CASE o_orderkey % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'mouse' WHEN 2 THEN 'both' END AS build FROM orders)
WHERE species IS NOT NULL AND build IS NOT NULL AND build <> 'both' AND species <> build""")
def _(t):
    from strandwise.operators import facts as K

    species = F.when(F.col("o_custkey") % 3 == 0, "human").when(F.col("o_custkey") % 3 == 1, "mouse")
    build = F.when(F.col("o_orderkey") % 4 == 0, "GRCh38").when(F.col("o_orderkey") % 4 == 1, "mm10").when(F.col("o_orderkey") % 4 == 2, "GRCh38_and_mm10")
    rows = t.orders.select("o_orderkey", K.reference_mismatch(species, build).alias("mismatch"))
    return rows.where("mismatch")
