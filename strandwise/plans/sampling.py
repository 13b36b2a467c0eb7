"""Queries of sections M, N and O over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.functions.hashing import fnv1a32, hash32
from strandwise.functions.staging import stage
from strandwise.operators import derived as N
from strandwise.operators import events as O
from strandwise.operators import sampling as M
from strandwise.operators import windows as G

from .joins import CLOSURE_SQL, served_orders
from .registry import Tables, query


def mix_sql(x: str) -> str:
    """The mixer in SQL, on 128-bit integers."""
    m = "4294967296"
    a = f"(xor({x}, {x} >> 16)::hugeint * 2146121005 % {m})::bigint"
    b = f"(xor(a, a >> 15)::hugeint * 2221713035 % {m})::bigint"
    return f"(SELECT xor(b, b >> 16) FROM (SELECT {b} AS b FROM (SELECT {a} AS a)))"


def hash_sql(seed: int, a: str, b: str) -> str:
    return f"(SELECT {mix_sql('z')} FROM (SELECT xor(y, {b}) AS z FROM (SELECT {mix_sql('x')} AS y FROM (SELECT xor({seed}, {a}) AS x))))"


@query("hash32", f"SELECT DISTINCT l_orderkey, l_partkey, {hash_sql(42, 'l_orderkey', 'l_partkey')} AS h FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", hash32(42, F.col("l_orderkey"), F.col("l_partkey")).alias("h")).distinct()


@query("seeded_sample", f"""
WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT l_orderkey, l_partkey, {hash_sql(7, 'l_orderkey', 'l_partkey')} AS h, (SELECT count(*) FROM d) AS eligible, (SELECT count(*) FROM d) - 500 AS remaining FROM d ORDER BY h, l_orderkey, l_partkey LIMIT 500""")
def _(t):
    return M.seeded_sample(t.lineitem.select("l_orderkey", "l_partkey").distinct(), "l_orderkey", "l_partkey", 500, 7)


_SIZES = "(SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1)"


def allocate_sql(cap: int, floor: int) -> str:
    """CTEs of the allocation over orders per customer; ``g`` is the result."""
    return f"""
b AS (SELECT o_custkey, size, '7|' || o_custkey AS x FROM {_SIZES}),
s(k, x, i, h) AS (SELECT o_custkey, x, 0, 2166136261::hugeint FROM b UNION ALL SELECT k, x, i + 1, xor(h::bigint, ascii(x[i + 1]))::hugeint * 16777619 % 4294967296 FROM s WHERE i < length(x)),
o AS (SELECT o_custkey, size, h::bigint AS t, row_number() OVER w AS r, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM b JOIN s ON k = o_custkey AND i = length(s.x) WINDOW w AS (ORDER BY size DESC, h DESC, o_custkey DESC)),
l AS (SELECT *, r <= (SELECT max(r) FROM o WHERE r = 1 OR total <= {cap} OR size * {cap}.0::double / total >= {floor}) AS live FROM o),
q AS (SELECT *, (SELECT sum(size) FROM l WHERE live) AS rest, CASE WHEN live THEN size * {cap}.0::double / (SELECT sum(size) FROM l WHERE live) ELSE -1.0 END AS q FROM l),
u AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN live THEN q - floor(q) ELSE -1.0 END DESC, t, o_custkey) AS turn, {cap} - (SELECT sum(floor(q)) FROM q WHERE live) AS open FROM q),
g AS (SELECT o_custkey, size, CASE WHEN NOT live THEN 0 WHEN rest <= {cap} THEN size ELSE least(size, floor(q) + CASE WHEN turn <= open THEN 1 ELSE 0 END) END::bigint AS keep FROM u)"""


@query("allocate", f"WITH RECURSIVE {allocate_sql(3000, 2)} SELECT o_custkey, size, keep FROM g")
def _(t):
    return M.allocate(t.orders.groupBy("o_custkey").agg(F.count("*").alias("size")), "o_custkey", "size", 3000, "7", 2)


@query("fnv1a32", """
WITH RECURSIVE b AS (SELECT c_custkey, c_name, encode(c_name) AS x FROM customer WHERE c_custkey >= 0),
s(c_custkey, x, i, h) AS (SELECT c_custkey, c_name, 0, 2166136261::hugeint FROM b UNION ALL
  SELECT c_custkey, x, i + 1, xor(h::bigint, ascii(x[i + 1]))::hugeint * 16777619 % 4294967296 FROM s WHERE i < length(x))
SELECT c_custkey, h::bigint AS h FROM s WHERE i = length(x)""")
def _(t):
    return t.customer.select("c_custkey", fnv1a32(F.col("c_name")).alias("h"))


def positions_sql(groups: str) -> str:
    """``drawn`` (key, pos) from ``groups`` (key, n, k): the seeded stream's values have a
    closed form, the selection goes along the positions."""
    fnv = "list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split('7|' || key, ''), lambda c: unicode(c)::ubigint)), lambda h, b: (xor(h, b) * 16777619::ubigint) % 4294967296::ubigint)"
    m = "% 4294967296::ubigint"
    return f"""seeded AS (SELECT key, n::bigint AS n, k::bigint AS k, {fnv} AS seed FROM ({groups})),
walk AS (
  SELECT key, n, k, seed, 0::bigint AS i, 0::bigint AS kept, -1::bigint AS pos FROM seeded
  UNION ALL
  SELECT key, n, k, seed, i + 1, kept + took, CASE took WHEN 1 THEN i ELSE -1 END
  FROM (SELECT *, (xor(t2, t2 >> 14) / 4294967296.0::double * (n - i) < k - kept)::int AS took
    FROM (SELECT *, xor(t1, (t1 + (xor(t1, t1 >> 7) * (t1 | 61::ubigint)) {m}) {m}) AS t2
      FROM (SELECT *, (xor(t0, t0 >> 15) * (t0 | 1::ubigint)) {m} AS t1
        FROM (SELECT *, (seed + (i + 1)::ubigint * 1831565813::ubigint) {m} AS t0 FROM walk WHERE i < n AND kept < k))))
), drawn AS (SELECT key, pos FROM walk WHERE pos >= 0)"""


_THIRD = "SELECT o_custkey::varchar AS key, count(*) AS n, ceil(count(*) / 3) AS k FROM orders GROUP BY o_custkey"


def thirds(t: Tables):
    groups = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("k", F.ceil(F.col("n") / 3))
    return M.select_positions(groups, "o_custkey", "n", "k", "7")


@query("select_positions", f"WITH RECURSIVE {positions_sql(_THIRD)} SELECT key, pos AS position FROM drawn")
def _(t):
    return thirds(t)


@query("kept_runs", f"""
WITH RECURSIVE {positions_sql(_THIRD)}, r AS (SELECT key, pos, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS island FROM drawn)
SELECT key, min(pos) AS start, count(*) AS length FROM r GROUP BY key, island""")
def _(t):
    return G.runs(thirds(t), "key", "position")


@query("downsample_positions", f"""
WITH RECURSIVE {allocate_sql(3000, 1)},
{positions_sql("SELECT o_custkey::varchar AS key, count(*) AS n, any_value(keep) AS k FROM orders JOIN g USING (o_custkey) WHERE keep > 0 GROUP BY o_custkey")},
placed AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders)
SELECT o_custkey, o_orderkey, position FROM placed JOIN drawn ON key = o_custkey::varchar AND pos = position""")
def _(t):
    return M.downsample_positions(t.orders, "o_custkey", [F.col("o_orderkey")], 3000, 7, 1).select("o_custkey", "o_orderkey", "position")


@query("downsample", f"""
WITH RECURSIVE {allocate_sql(3000, 1)}, h AS (SELECT o_custkey, o_orderkey, {hash_sql(7, 'o_custkey', 'o_orderkey')} AS place FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY place, o_orderkey) AS r FROM h)
SELECT o_custkey, o_orderkey FROM n JOIN g USING (o_custkey) WHERE r <= keep""")
def _(t):
    order = [hash32(7, F.col("o_custkey"), F.col("o_orderkey")), F.col("o_orderkey")]
    return M.downsample(t.orders, "o_custkey", order, 3000, 7, 1).select("o_custkey", "o_orderkey")


@query("sample_prune", """
SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_quantity) >= 45 AND min(l_quantity) <= 5 AND max(l_discount) >= 0.09""")
def _(t):
    stats = N.sample_stats(t.lineitem, "l_orderkey", ["l_quantity", "l_discount"])
    return M.sample_prune(stats, {"l_quantity": (45, 5), "l_discount": (0.09, None)}).select("l_orderkey")


@query("encode", "SELECT lower(p_brand) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(p_brand)) AS code FROM part GROUP BY 1")
def _(t):
    return N.encode(t.part, "p_brand")


@query("cell_summary", "SELECT l_orderkey, l_returnflag, l_linestatus, sum(l_quantity::bigint)::bigint AS weight, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return N.cell_summary(t.lineitem, ["l_orderkey", "l_returnflag", "l_linestatus"], "l_quantity")


@query("sample_stats", """
SELECT l_suppkey, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity_q50, round(quantile_cont(l_quantity, 0.9), 6) AS l_quantity_q90 FROM lineitem GROUP BY 1""")
def _(t):
    out = N.sample_stats(t.lineitem, "l_suppkey", ["l_quantity"])
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity_q50", "l_quantity_q90")})


@query("closure", f"SELECT term, ancestor, min(distance) AS distance FROM (SELECT * FROM {CLOSURE_SQL} UNION ALL SELECT 'ROOT', 'ROOT', 0) GROUP BY ALL")
def _(t):
    up = t.nation.select(F.concat(F.lit("N:"), "n_nationkey").alias("term"), F.concat(F.lit("R:"), "n_regionkey").alias("parent"))
    return N.closure(up.unionByName(t.region.select(F.concat(F.lit("R:"), "r_regionkey").alias("term"), F.lit("ROOT").alias("parent"))))


@query("sample_facts", """
WITH b AS (SELECT l_orderkey, arg_min(l_returnflag, (-l_discount, l_returnflag)) AS flag, arg_min(l_linestatus, (-l_discount, l_linestatus)) AS line FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus, flag, line FROM orders LEFT JOIN b ON l_orderkey = o_orderkey WHERE o_orderkey % 97 <> 0 AND o_custkey % 53 <> 0""")
def _(t):
    long = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"))
    facts = long.unpivot(["o_orderkey", "confidence"], ["flag", "line"], "attr", "value")
    return N.sample_facts(served_orders(t).select("o_orderkey", "o_orderstatus"), facts, "o_orderkey", ["flag", "line"])


@query("manifest_rows", """
WITH k AS (SELECT o_custkey, count(*) AS n, sum(trunc(o_totalprice)::bigint)::bigint AS b FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1)
SELECT c_custkey AS o_custkey, coalesce(n, 0) AS n_samples, coalesce(b, 0) AS bytes, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'single' ELSE 'bundle' END AS format FROM customer LEFT JOIN k ON o_custkey = c_custkey""")
def _(t):
    groups = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return N.manifest_rows(groups, t.orders, t.orders.where("o_orderkey % 97 = 0"), "o_custkey", "o_orderkey", "o_totalprice")


NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def web(t: Tables):
    """Events as page views: some malformed on purpose."""
    e = t.events
    return e.select(
        "event_id",
        F.when(F.col("event_type") == "view", "view").when(F.col("event_type") == "error", "crash").otherwise("leave").alias("event"),
        F.concat(F.when(F.col("user_id") % 17 == 0, "x").otherwise("/"), "event_type", F.lit("?k="), "user_id").alias("path"),
        F.concat(F.lit("page-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("page_id"),
        F.concat(F.lit("session-"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("visitor-"), F.col("user_id").cast("string")).alias("visitor_id"),
        F.when(F.col("user_id") % 3 == 0, "www.Site.org").when(F.col("user_id") % 3 == 1, "WWW.other.net").alias("referrer"),
        F.when(F.col("user_id") % 2 == 0, "News Letter").otherwise("<b>").alias("utm_source"),
        (F.col("value") * 100000).alias("visible_ms"),
        F.col("value").alias("scroll_pct"),
        F.lit(None).cast("double").alias("width"),
    )


@query("clean_events", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' ELSE 'leave' END AS event, '/' || event_type AS path, CASE user_id % 3 WHEN 1 THEN 'other.net' ELSE '' END AS referrer, CASE WHEN user_id % 2 = 0 THEN 'news letter' ELSE '' END AS utm_source,
  least(round(value * 100000), 3600000)::bigint AS visible_ms, least(round(value), 100)::bigint AS scroll_pct, 0::bigint AS width
FROM events WHERE event_type <> 'error' AND user_id % 17 <> 0""")
def _(t):
    return O.clean_events(web(t), "site.org").select("event_id", "event", "path", "referrer", "utm_source", "visible_ms", "scroll_pct", "width")


_AGENTS = ["Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537", "Mozilla/5.0 (iPhone; CPU iPhone OS 17) Safari/604", "Mozilla/5.0 (X11; Linux) Firefox/121", "Googlebot/2.1", "", "Mozilla/5.0 (Macintosh; Mac OS X) Edg/120"]


@query("describe_agent", """
SELECT event_id, CASE user_id % 6 WHEN 1 THEN 'mobile' ELSE CASE WHEN value BETWEEN 0.0001 AND 7.6799999 THEN 'mobile' ELSE 'desktop' END END AS device,
  ['Chrome', 'Safari', 'Firefox', 'Other', 'Other', 'Edge'][user_id % 6 + 1] AS browser, ['Windows', 'iOS', 'Linux', 'Other', 'Other', 'macOS'][user_id % 6 + 1] AS os, user_id % 6 IN (3, 4) AS bot FROM events""")
def _(t):
    agent = F.element_at(F.array(*map(F.lit, _AGENTS)), (F.col("user_id") % 6 + 1).cast("int"))
    rows = t.events.select("event_id", agent.alias("agent"), (F.col("value") * 100).alias("width"))
    return O.describe_agent(rows, "agent", "width").select("event_id", "device", "browser", "os", "bot")


_TRAFFIC = """count(*) FILTER (WHERE event_type = 'view') AS views, count(DISTINCT user_id) AS visitors, count(DISTINCT (user_id, ts::date)) AS sessions,
  coalesce(sum(floor(value)::bigint) FILTER (WHERE event_type = 'view'), 0)::bigint AS seconds, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers"""


@query("traffic_summary", f"SELECT {_TRAFFIC} FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
def _(t):
    return O.traffic_summary(t.events, 14, now())


@query("visitor_kinds", f"""
WITH f AS (SELECT user_id, min(ts)::date AS first FROM events GROUP BY 1), e AS (SELECT events.*, ts::date > first AS again FROM events LEFT JOIN f USING (user_id))
SELECT count(DISTINCT user_id) AS visitors, count(DISTINCT user_id) FILTER (WHERE again) AS "returning", count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS signed_in FROM e WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY""")
def _(t):
    return O.visitor_kinds(O.mark_returning(t.events), 14, now(), F.col("returning"), F.col("event_type") == "purchase")


@query("visitors_by_sketch", "SELECT date_trunc('day', ts)::timestamp AS day, count(*) FILTER (WHERE event_type = 'view') AS views, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY 1")
def _(t):
    day = F.date_trunc("day", "hour").cast("timestamp_ntz").alias("day")
    stored = stage(O.visitor_sketches(t.events), "sketches")
    exact = t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.countDistinct("user_id").alias("exact"))
    # four standard errors of a sketch with 2 ** 12 registers
    close = F.abs(F.col("visitors") - F.col("exact")) <= F.greatest(F.lit(2.0), F.col("exact") * 4 * 1.04 / 64)
    return O.visitors_over(stored, day).join(exact, "day").select("day", "views", "exact", close.alias("close"))


@query("traffic_series", f"SELECT date_trunc('day', ts)::timestamp AS bucket, {_TRAFFIC} FROM events GROUP BY 1")
def _(t):
    return O.traffic_series(t.events, "day")


def visits(t: Tables):
    """Events as cleaned page views, with the columns that reports group by."""
    u, i = F.col("user_id"), F.col("event_id")
    agent = F.element_at(F.array(*map(F.lit, _AGENTS)), (u % 6 + 1).cast("int"))
    rows = t.events.select(
        F.when(F.col("event_type") == "error", "leave").otherwise("view").alias("event"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), (i % 7).cast("string")).alias("path"),
        F.concat_ws("|", u, F.to_date("ts")).alias("session_id"),
        u.alias("visitor_id"),
        F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("site"), (u % 5).cast("string"))).alias("referrer"),
        F.when(u % 2 == 0, "news").otherwise("").alias("utm_source"),
        F.when(u % 4 == 0, "mail").otherwise("").alias("utm_medium"),
        F.concat(F.lit("c"), (u % 3).cast("string")).alias("utm_campaign"),
        F.concat(F.lit("C"), (u % 40).cast("string")).alias("country"),
        (i % 3 == 0).alias("landing"),
        (1 + u % 3).alias("weight"),
        F.floor(F.col("value") * 1000).cast("long").alias("visible_ms"),
        F.col("value").alias("scroll_pct"),
        agent.alias("agent"),
        F.lit(None).cast("double").alias("width"),
    )
    return O.describe_agent(rows, "agent", "width")


_VISITS = """v AS (SELECT CASE WHEN event_type = 'error' THEN 'leave' ELSE 'view' END AS event, '/' || event_type || '/' || event_id % 7 AS path, user_id || '|' || ts::date AS session_id, user_id AS visitor_id,
  CASE WHEN user_id % 3 = 0 THEN '' ELSE 'site' || user_id % 5 END AS referrer, CASE WHEN user_id % 2 = 0 THEN 'news' ELSE '' END AS utm_source, CASE WHEN user_id % 4 = 0 THEN 'mail' ELSE '' END AS utm_medium,
  'c' || user_id % 3 AS utm_campaign, 'C' || user_id % 40 AS country, event_id % 3 = 0 AS landing, 1 + user_id % 3 AS weight, floor(value * 1000)::bigint AS visible_ms, value AS scroll_pct,
  ['desktop', 'mobile', 'desktop', 'desktop', 'desktop', 'desktop'][user_id % 6 + 1] AS device, ['Chrome', 'Safari', 'Firefox', 'Other', 'Other', 'Edge'][user_id % 6 + 1] AS browser FROM events)"""


@query("top_pages", f"""
WITH {_VISITS} SELECT path, coalesce(sum(weight) FILTER (WHERE event = 'view'), 0)::bigint AS views, count(DISTINCT visitor_id) AS visitors, coalesce(sum(visible_ms * weight) FILTER (WHERE event = 'leave'), 0)::bigint AS visible_ms,
  round(avg(scroll_pct) FILTER (WHERE event = 'leave'), 4) AS scroll FROM v GROUP BY 1 ORDER BY views DESC, path LIMIT 50""")
def _(t):
    return O.top_pages(visits(t))


def _sessions_sql(by: str, extra: str = "") -> str:
    return f"WITH {_VISITS} SELECT {by}, count(DISTINCT session_id) AS sessions, count(DISTINCT visitor_id) AS visitors FROM v WHERE event = 'view' AND landing {extra} GROUP BY {by} ORDER BY sessions DESC, {by} LIMIT 25"


def _visitors_sql(by: str) -> str:
    return f"WITH {_VISITS} SELECT {by}, count(DISTINCT visitor_id) AS visitors, coalesce(sum(weight) FILTER (WHERE event = 'view'), 0)::bigint AS views FROM v GROUP BY 1 ORDER BY visitors DESC, {by} LIMIT 25"


@query("landing", _sessions_sql("path"))
def _(t):
    return O.landing(visits(t))


@query("referrers", _sessions_sql("referrer"))
def _(t):
    return O.referrers(visits(t))


@query("campaigns", _sessions_sql("utm_source, utm_medium, utm_campaign", "AND utm_source <> ''"))
def _(t):
    return O.campaigns(visits(t))


@query("by_country", _visitors_sql("country"))
def _(t):
    return O.by_country(visits(t))


@query("by_device", _visitors_sql("device"))
def _(t):
    return O.by_device(visits(t))


@query("by_browser", _visitors_sql("browser"))
def _(t):
    return O.by_browser(visits(t))


@query("rate_window", """
WITH w AS (SELECT event_id, user_id, (floor(epoch(ts) / 3600) * 3600)::bigint AS window_start, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS place FROM w)
SELECT event_id, window_start, place, place <= 1 AS admitted FROM r""")
def _(t):
    return O.rate_window(t.events, "user_id", "ts", 3600, 1, "event_id").select("event_id", "window_start", "place", "admitted")


@query("daily_quota", """
WITH r AS (SELECT event_id, ts::date AS day, row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts, event_id) AS place FROM events)
SELECT event_id, place, place <= 2 AS allowed, greatest(2 - place, 0) AS remaining FROM r""")
def _(t):
    return O.daily_quota(t.events, "user_id", "ts", 2, "event_id").select("event_id", "place", "allowed", "remaining")


@query("monthly_usage", "SELECT user_id, strftime(ts, '%Y-%m') AS month, event_type, count(*) AS calls, max(ts) AS last_used FROM events GROUP BY ALL")
def _(t):
    return O.monthly_usage(t.events, "user_id", "event_type", "ts")


@query("snapshot_ticks", """
WITH h AS (SELECT date_trunc('hour', ts)::timestamp AS t, event_type, count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN value END), 4) AS u FROM events GROUP BY ALL)
SELECT t, sum(n)::bigint AS total, coalesce(sum(n) FILTER (WHERE event_type = 'error'), 0)::bigint AS errors, round(avg(u), 8) AS mean_util FROM h GROUP BY 1""")
def _(t):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    per = t.events.groupBy(hour.alias("generated_at"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), 4).alias("u"))
    snaps = per.groupBy("generated_at").agg(
        F.struct(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("n"))), F.lit(0)).alias("errors")).alias("kpi"),
        F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("name"), F.col("u").alias("cpu_util_pct")))).alias("partitions"),
    )
    return O.snapshot_ticks(snaps)


@query("append_point", """
WITH s AS (SELECT date_trunc('hour', ts)::timestamp AS t, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1), p AS (SELECT date_trunc('hour', ts)::timestamp AS t, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT * FROM p UNION ALL SELECT * FROM s ANTI JOIN p USING (t)""")
def _(t):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")
    count = lambda where: t.events.where(where).groupBy(hour).agg(F.count("*").alias("n"))
    return O.append_point(count("event_type != 'view'"), count("event_type = 'view'"), "t")


@query("thin_series", f"""
WITH a AS (SELECT event_id, ts - to_days((event_id % 400)::int) AS t FROM events), b AS (SELECT *, epoch(TIMESTAMP '{NOW}')::bigint - floor(epoch(t))::bigint AS age FROM a)
SELECT event_id, t FROM b WHERE CASE WHEN age > 365 * 86400 THEN false WHEN age <= 7 * 86400 THEN true WHEN age <= 60 * 86400 THEN minute(t) < 30 ELSE minute(t) < 30 AND hour(t) % 6 = 0 END ORDER BY t DESC, event_id LIMIT 6000""")
def _(t):
    at = F.col("ts") - F.make_dt_interval((F.col("event_id") % 400).cast("int"))
    return O.thin_series(t.events.select("event_id", at.alias("t")), "t", now(), tie=["event_id"])


@query("trailing_range", f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def _(t):
    return O.in_range(t.events.select("event_id", "ts"), "7d", now())


@query("clean_point", """SELECT event_id, substr(json_extract_string(props, '$.k') || '-aaaaaaaaaaaaaaaaaaaaaa', 1, 16) AS k, 1 AS n FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k")
    point = F.create_map(F.lit("k"), F.concat(k, F.lit("-aaaaaaaaaaaaaaaaaaaaaa")), F.lit("bad key"), k, F.lit("nested"), F.col("props"))
    rows = O.clean_point(t.events.select("event_id", point.alias("p")), "p")
    return rows.select("event_id", F.element_at("p", "k").alias("k"), F.size("p").alias("n"))


@query("prune", "SELECT o_orderkey FROM orders WHERE o_orderdate::date >= (DATE '2001-08-01' - to_months((CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 24 END)::int))::date")
def _(t):
    months = F.when(F.col("o_custkey") % 2 == 0, 2).otherwise(24)
    return O.prune(t.orders, "o_orderdate", F.lit("2001-08-01").cast("date"), months).select("o_orderkey")
