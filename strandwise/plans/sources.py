"""Queries of section A, and of the streaming forms, over the given tables. Sources that
read files read what Spark has written before from a given table, in the shared folder."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from strandwise.functions import staging
from strandwise.sources import tables as A
from strandwise.sources.layout import LaidOutTable
from strandwise.streaming import events as S

from .registry import Tables, query


def scratch(t: Tables, name: str) -> str:
    """A new folder that driver and executors share."""
    return staging.scratch(t.spark, name)


@query("laid_out_range", "SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_shipdate BETWEEN TIMESTAMP '1994-03-01' AND TIMESTAMP '1994-05-31' AND l_quantity >= 40")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_quantity")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    table = LaidOutTable(t.spark, scratch(t, "laid"), ddl, "l_returnflag", ["l_shipdate"])
    table.write(rows, bloom={"l_orderkey": 100_000})
    months = tuple(datetime.datetime(1994, *day) for day in ((3, 1), (5, 31)))
    return table.read(ranges={"l_shipdate": months, "l_quantity": (40, None)}, by=["A", "R"])


@query("read_rows", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    path = scratch(t, "rows")
    low = t.nation.where("n_nationkey < 10").select("n_nationkey", "n_name")
    high = t.nation.where("n_nationkey >= 10").select("n_nationkey", "n_name")
    low.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(f"{path}/a")
    high.groupBy(F.col("n_nationkey") % 2).agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("results")).agg(F.to_json(F.collect_list(F.struct("results"))).alias("value")).write.text(f"{path}/b")
    return A.read_rows(t.spark, f"{path}/*", "n_nationkey int, n_name string")


@query("export_page", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50)")
def _(t):
    return A.export_page(t.orders, "o_orderkey", 1000, 50, t.lineitem, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("read_snapshots", "SELECT date_trunc('day', ts)::timestamp AS t, count(*) AS total FROM events GROUP BY 1")
def _(t):
    path = scratch(t, "snapshots")
    day = F.date_trunc("day", "ts")
    per = t.events.groupBy(day.alias("d")).agg(F.count("*").alias("total"))
    per.select(F.to_json(F.struct(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), "total")).alias("value"), F.date_format("d", "yyyyMMdd").alias("day")).write.partitionBy("day").text(path)
    t.spark.createDataFrame([("{broken",)], "value string").write.text(f"{path}/day=none")
    rows = A.read_snapshots(t.spark, f"{path}/*", "generated_at string, total long")
    return rows.select(F.col("t").cast("timestamp_ntz").alias("t"), "total")


@query("upsert", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 4 <> 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 4 = 1 THEN 2 WHEN c_custkey % 2 = 0 AND c_custkey % 10 = 0 THEN 2 ELSE 1 END AS stamp FROM customer WHERE c_custkey % 4 <> 1 OR c_custkey % 3 = 0""")
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    old = rows.where("c_custkey % 4 != 1").withColumn("stamp", F.lit(1))
    changed = F.when((F.col("c_custkey") % 10 == 0) & (F.col("c_custkey") % 4 != 1), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    new = rows.where("c_custkey % 2 = 0 or (c_custkey % 4 = 1 and c_custkey % 3 = 0)").withColumn("c_acctbal", changed).withColumn("stamp", F.lit(2))
    return A.upsert(old, new, ["c_custkey"], "stamp")


@query("update_only", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal, s_suppkey % 3 = 0 AND s_acctbal <> 0 AS changed FROM supplier")
def _(t):
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    new = rows.where("s_suppkey % 2 = 0 or s_suppkey % 3 = 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") * 2).otherwise(F.col("s_acctbal")))
    beyond = new.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000)
    return A.update_only(rows, new.unionByName(beyond), "s_suppkey")


@query("replace_partition", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey % 5 <> 0 OR o_orderkey % 2 = 0")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    new = rows.where("o_custkey % 5 = 0 and o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("new"))
    return A.replace_partition(rows, new, t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("read_csv_rejects", "SELECT p_partkey, p_size FROM part WHERE p_partkey % 50 <> 7 AND p_partkey % 2 = 0")
def _(t):
    path = scratch(t, "csv")
    size = F.when(F.col("p_partkey") % 50 == 7, "many").otherwise(F.col("p_size").cast("string"))
    t.part.select("p_partkey", size.alias("p_size")).write.option("header", "true").csv(path)
    return A.read_csv_rejects(t.spark, path, "p_partkey long, p_size int", F.col("p_partkey") % 2 == 0)[0]


@query("write_delimited", "SELECT o_custkey::varchar AS o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, 'a b' AS note FROM orders GROUP BY 1")
def _(t):
    path = scratch(t, "tsv")
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities")).withColumn("note", F.lit("a\t\nb"))
    A.write_delimited(rows, path)
    return t.spark.read.schema("o_custkey string, priorities string, note string").option("header", "true").option("sep", "\t").csv(path)


@query("export_triples", """
WITH s AS (SELECT p_brand, l_suppkey, sum(l_quantity::decimal(18,2))::double AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT dense_rank() OVER (ORDER BY p_brand) AS i, dense_rank() OVER (ORDER BY l_suppkey) AS j, value FROM s""")
def _(t):
    return A.export_triples(t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")), "p_brand", "l_suppkey", "l_quantity")


@query("export_features", """
SELECT row_number() OVER (ORDER BY p_brand) AS i, p_brand AS id, symbol, 'Gene Expression' AS kind FROM (SELECT p_brand, min(p_name) AS symbol FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)""")
def _(t):
    return A.export_features(t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")), "p_brand", F.col("p_name"))


@query("export_cells", """
SELECT row_number() OVER (ORDER BY s_suppkey)::int AS j, s_suppkey::varchar AS cell, s_name, 'a|b' AS labels FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)""")
def _(t):
    cells = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey")).distinct().join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey")
    return A.export_cells(cells.withColumn("labels", F.array(F.lit("a"), F.lit("b"))), "s_suppkey", ["s_name", "labels"])


@query("flat_sample_table", """
SELECT o_orderkey, o_custkey, tier, c_mktsegment, CASE WHEN tier = 2 THEN 'removed' WHEN o_totalprice < 20000 THEN 'small' ELSE 'ok' END AS gate
FROM (SELECT *, CASE WHEN o_orderkey % 31 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS tier FROM orders) LEFT JOIN customer ON c_custkey = o_custkey""")
def _(t):
    from .aggregates import qc

    samples = t.orders.withColumn("weight", F.col("o_totalprice"))
    studies = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return A.flat_sample_table(samples, qc(t), studies, "o_orderkey", "o_custkey", 20000).select("o_orderkey", "o_custkey", "tier", "c_mktsegment", "gate")


@query("merge_facts", """
WITH own AS (SELECT o_orderkey, 'status' AS attr, o_orderstatus AS value, 'catalogue' AS source FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT o_orderkey, 'status' AS attr, 'X|Y' AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'geo' ELSE 'model' END AS source FROM orders UNION ALL SELECT o_orderkey, 'age', '7', 'geo' FROM orders WHERE o_orderkey % 5 <> 0),
g AS (SELECT * FROM f WHERE source <> 'geo' OR attr <> 'status' OR o_orderkey % 2 <> 0)
SELECT DISTINCT o_orderkey, attr, unnest(string_split(value, '|')) AS value, source FROM (SELECT * FROM own UNION ALL SELECT * FROM g)""")
def _(t):
    flat = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    status = t.orders.select("o_orderkey", F.lit("status").alias("attr"), F.lit("X|Y").alias("value"), F.when(F.col("o_orderkey") % 3 == 0, "geo").otherwise("model").alias("source"), F.lit(None).cast("string").alias("unit"))
    age = t.orders.select("o_orderkey", F.lit("age").alias("attr"), F.lit("7").alias("value"), F.lit("geo").alias("source"), F.when(F.col("o_orderkey") % 5 == 0, "weeks").otherwise("years").alias("unit"))
    return A.merge_facts(flat, status.unionByName(age), "o_orderkey", ["status"], {"age": "years"})


def _stream(t: Tables):
    """The events as a stream of files."""
    path = scratch(t, "events")
    t.events.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "ts").write.parquet(path)
    return S.read_events(t.spark, path)


@query("stream_traffic_series", "SELECT date_trunc('hour', ts)::timestamp AS bucket, count(*) FILTER (WHERE event_type = 'view') AS views, coalesce(sum(floor(value)::bigint) FILTER (WHERE event_type = 'view'), 0)::bigint AS seconds FROM events GROUP BY 1")
def _(t):
    out, at = scratch(t, "series"), scratch(t, "at")
    rows = S.traffic_series(_stream(t), late="400 days")

    def put(batch, _):
        batch.write.mode("overwrite").parquet(out)

    S.run_to_table(rows, out, at, "complete", put)
    return t.spark.read.parquet(out).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "views", "seconds")


@query("stream_rate_window", "SELECT user_id, date_trunc('hour', ts)::timestamp AS bucket, count(*) AS calls, least(count(*), 2) AS admitted FROM events GROUP BY ALL")
def _(t):
    out, at = scratch(t, "rates"), scratch(t, "at")

    def put(batch, _):
        batch.write.mode("overwrite").parquet(out)

    S.run_to_table(S.rate_counts(_stream(t), late="400 days", limit=2), out, at, "complete", put)
    return t.spark.read.parquet(out).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("stream_append_point", "SELECT event_id, user_id FROM events")
def _(t):
    out, at = scratch(t, "points"), scratch(t, "at")
    twice = _stream(t)
    S.run_to_table(S.distinct_points(twice.select("event_id", "ts", "user_id"), "400 days"), out, at)
    return t.spark.read.schema("event_id long, ts timestamp, user_id long").parquet(out).select("event_id", "user_id")


@query("stream_admissions", """
WITH e AS (SELECT user_id, event_id, ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AS admitted FROM events)
SELECT user_id, window_end::timestamp AS window_end, event_id, ts::timestamp AS ts, admitted FROM e
WHERE NOT admitted OR window_end < (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def _(t):
    path, out, at = scratch(t, "calls"), scratch(t, "admissions"), scratch(t, "at")
    t.events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    # all files at once: which of them come late is then not left to the order of a listing
    S.run_to_table(S.admissions(S.read_events(t.spark, path, 1_000_000), limit=1), out, at)
    found = t.spark.read.schema(S.ADMISSIONS).parquet(out)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "window_end")})
