"""Events and telemetry (section O). Functions take a batch or a stream alike where they
only project and filter; the streaming forms are in ``strandwise.streaming``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.columns import yes

# Fixed patterns of the event format.
ID = "^[A-Za-z0-9-]{8,40}$"
UTM = r"^[A-Za-z0-9_ .%+-]{1,60}$"
HOST = "^[a-z0-9.-]{1,100}$"
BOT = "(?i)bot|crawl|spider|slurp|headless|lighthouse|pingdom|preview|facebookexternalhit|embedly|python-requests|curl|wget"


def _number(c: Column, most: int) -> Column:
    return F.coalesce(F.least(F.greatest(F.round(c), F.lit(0)), F.lit(most)), F.lit(0)).cast("long")


def _utm(c: str) -> Column:
    return F.when(F.col(c).rlike(UTM), F.lower(c)).otherwise("")


def clean_events(df: DataFrame, site: str) -> DataFrame:
    """Valid events, trimmed and clamped; others are dropped."""
    path = F.substring(F.split("path", "[?#]")[0], 1, 200)
    host = F.lower(F.coalesce("referrer", F.lit("")))
    ok = F.col("event").isin("view", "leave") & path.startswith("/")
    for c in ("page_id", "session_id", "visitor_id"):
        ok = ok & F.col(c).rlike(ID)
    rows = df.where(F.coalesce(ok, F.lit(False)))
    return rows.withColumns(
        {
            "path": path,
            "referrer": F.when(host.rlike(HOST) & ~host.isin(site, f"www.{site}"), F.regexp_replace(host, r"^www\.", "")).otherwise(""),
            "utm_source": _utm("utm_source"),
            "visible_ms": _number(F.col("visible_ms"), 3_600_000),
            "scroll_pct": _number(F.col("scroll_pct"), 100),
            "width": _number(F.col("width"), 10_000),
        }
    )


def is_bot(agent: Column) -> Column:
    return F.coalesce(agent, F.lit("")).rlike(BOT) | (F.coalesce(agent, F.lit("")) == "")


def _first(agent: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    out = F.lit(other)
    for pattern, name in reversed(rules):
        out = F.when(agent.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def describe_agent(df: DataFrame, agent: str, width: str) -> DataFrame:
    ua = F.coalesce(F.col(agent), F.lit(""))
    small = (F.col(width) > 0) & (F.col(width) < 768)
    device = F.when(ua.rlike("(?i)iPad|Tablet"), "tablet").when(ua.rlike("(?i)Mobi|iPhone|Android") | F.coalesce(small, F.lit(False)), "mobile").otherwise("desktop")
    browser = _first(ua, [("Edg/", "Edge"), ("OPR/|Opera", "Opera"), ("Firefox/", "Firefox"), ("Chrome/", "Chrome"), ("Safari/", "Safari")], "Other")
    os = _first(ua, [("Windows", "Windows"), ("iPhone|iPad|iOS", "iOS"), ("Mac OS X", "macOS"), ("Android", "Android"), ("Linux", "Linux")], "Other")
    return df.withColumns({"device": device, "browser": browser, "os": os, "bot": is_bot(F.col(agent))})


_TRAFFIC = ("views", "visitors", "sessions", "seconds", "buyers")


def _traffic() -> list[Column]:
    view = F.col("event_type") == "view"
    session = F.concat_ws("|", "user_id", F.to_date("ts"))
    return [
        F.count_if(view).alias("views"),
        F.countDistinct("user_id").alias("visitors"),
        F.countDistinct(session).alias("sessions"),
        F.coalesce(F.sum(F.when(view, F.floor("value").cast("long"))), F.lit(0)).alias("seconds"),
        F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"),
    ]


def in_range(df: DataFrame, span: str, now: Column, at: str = "ts") -> DataFrame:
    """Trailing ``24h``, ``7d`` or ``all``."""
    hours = {"24h": 24, "7d": 168}.get(span)
    return df if hours is None else df.where(F.col(at) >= now - F.expr(f"interval {hours} hours"))


def traffic_summary(df: DataFrame, days: int, now: Column) -> DataFrame:
    return df.where(F.col("ts") >= now - F.expr(f"interval {days} days")).agg(*_traffic())


def mark_returning(df: DataFrame, user: str = "user_id", at: str = "ts") -> DataFrame:
    """Adds ``returning``: the visitor was seen on an earlier day."""
    first = df.groupBy(F.col(user).alias("_user")).agg(F.to_date(F.min(at)).alias("_first"))
    marked = df.join(first, F.col(user) == F.col("_user"), "left")
    return marked.withColumn("returning", yes(F.to_date(at) > F.col("_first"))).drop("_user", "_first")


def visitor_kinds(df: DataFrame, days: int, now: Column, returning: Column, signed_in: Column, user: str = "user_id") -> DataFrame:
    """One row: distinct visitors of a trailing range, of these returning ones and ones that
    signed in (a visitor counts with any such event in the range)."""
    rows = df.where(F.col("ts") >= now - F.expr(f"interval {days} days"))
    of = lambda c: F.countDistinct(F.when(yes(c), F.col(user)))
    return rows.agg(F.countDistinct(user).alias("visitors"), of(returning).alias("returning"), of(signed_in).alias("signed_in"))


def visitor_sketches(df: DataFrame, user: str = "user_id", precision: int = 12) -> DataFrame:
    """``hour, sketch, views``: what any later range needs, a small row per hour. Sketches of
    hours merge (``visitors_over``), distinct counts do not."""
    return df.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.hll_sketch_agg(user, precision).alias("sketch"), F.count_if(F.col("event_type") == "view").alias("views"))


def visitors_over(sketches: DataFrame, *by: Column) -> DataFrame:
    """Estimated distinct visitors and exact views over all hours of each group."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors"), F.sum("views").alias("views"))


def traffic_series(df: DataFrame, bucket: str) -> DataFrame:
    """The same per ``hour`` or ``day``."""
    return df.groupBy(F.date_trunc(bucket, "ts").cast("timestamp_ntz").alias("bucket")).agg(*_traffic())


def top_pages(df: DataFrame, most: int = 50) -> DataFrame:
    """``path, views, visitors, visible_ms, scroll``: views weighted by ``weight`` (how
    many rows each stands for), time and mean scroll over leaving events."""
    leave = F.col("event") == "leave"
    rows = df.groupBy("path").agg(
        F.sum(F.when(F.col("event") == "view", F.col("weight")).otherwise(0)).cast("long").alias("views"),
        F.countDistinct("visitor_id").alias("visitors"),
        F.coalesce(F.sum(F.when(leave, (F.col("visible_ms") * F.col("weight")).cast("long"))), F.lit(0)).alias("visible_ms"),
        F.round(F.avg(F.when(leave, F.col("scroll_pct").cast("double"))), 4).alias("scroll"),
    )
    return rows.orderBy(F.desc("views"), "path").limit(most)


def sessions_by(df: DataFrame, by: Sequence[str], most: int = 25) -> DataFrame:
    """Sessions and visitors per key over the views that a session starts with."""
    rows = df.where((F.col("event") == "view") & F.col("landing"))
    counts = rows.groupBy(*by).agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("visitor_id").alias("visitors"))
    return counts.orderBy(F.desc("sessions"), *by).limit(most)


def visitors_by(df: DataFrame, by: str, most: int = 25) -> DataFrame:
    """Visitors and weighted views per key over all events."""
    views = F.sum(F.when(F.col("event") == "view", F.col("weight")).otherwise(0)).cast("long")
    counts = df.groupBy(by).agg(F.countDistinct("visitor_id").alias("visitors"), views.alias("views"))
    return counts.orderBy(F.desc("visitors"), by).limit(most)


def landing(df: DataFrame) -> DataFrame:
    return sessions_by(df, ["path"])


def referrers(df: DataFrame) -> DataFrame:
    return sessions_by(df, ["referrer"])


def campaigns(df: DataFrame) -> DataFrame:
    """Only what carries a source."""
    return sessions_by(df.where("utm_source != ''"), ["utm_source", "utm_medium", "utm_campaign"])


def by_country(df: DataFrame) -> DataFrame:
    return visitors_by(df, "country")


def by_device(df: DataFrame) -> DataFrame:
    return visitors_by(df, "device")


def by_browser(df: DataFrame) -> DataFrame:
    return visitors_by(df, "browser")


def rate_window(df: DataFrame, key: str, at: str, seconds: int, limit: int, tie: str) -> DataFrame:
    """Each call with its fixed window, its place there and whether it is admitted."""
    window = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds) * seconds
    rows = df.withColumn("window_start", window)
    place = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(at, tie))
    return rows.withColumn("place", place).withColumn("admitted", F.col("place") <= limit)


def daily_quota(df: DataFrame, key: str, at: str, limit: int, tie: str) -> DataFrame:
    """First n calls a day are allowed; ``remaining`` after each."""
    day = F.to_date(F.col(at))
    place = F.row_number().over(Window.partitionBy(key, day).orderBy(at, tie))
    return df.withColumn("day", day).withColumn("place", place).withColumn("allowed", F.col("place") <= limit).withColumn("remaining", F.greatest(F.lit(limit) - F.col("place"), F.lit(0)))


def monthly_usage(df: DataFrame, key: str, tool: str, at: str) -> DataFrame:
    return df.groupBy(key, F.date_format(at, "yyyy-MM").alias("month"), tool).agg(F.count("*").alias("calls"), F.max(at).alias("last_used"))


def snapshot_ticks(df: DataFrame) -> DataFrame:
    """Nested snapshots to flat ticks: ``t, total, errors, mean_util`` (partitions whose
    utilisation is missing are left out of the mean)."""
    used = F.filter(F.transform("partitions", lambda p: p["cpu_util_pct"]), lambda x: x.isNotNull())
    mean = F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(used), F.lit(0))
    return df.select(F.col("generated_at").alias("t"), F.col("kpi.total").alias("total"), F.col("kpi.errors").alias("errors"), F.round(mean, 8).alias("mean_util")).orderBy("t")


def append_point(series: DataFrame, points: DataFrame, at: str) -> DataFrame:
    """Points by time; a new point replaces one at the same time."""
    return points.unionByName(series.join(points.select(at), at, "left_anti"))


def keep_point(at: Column, now: Column) -> Column:
    """All for 7 days, then the first half of each hour to 60 days, then of every sixth
    hour to a year, then none."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    day = 86400
    early = F.minute(at) < 30
    return F.when(age > 365 * day, F.lit(False)).when(age <= 7 * day, F.lit(True)).when(age <= 60 * day, early).otherwise(early & (F.hour(at) % 6 == 0))


def thin_series(df: DataFrame, at: str, now: Column, most: int = 6000, tie: Sequence[str] = ()) -> DataFrame:
    """Thinned points, newest ``most`` kept; ``tie`` orders points of one time."""
    return df.where(keep_point(F.col(at), now)).orderBy(F.desc(at), *tie).limit(most)


def clean_point(df: DataFrame, column: str, most: int = 40, longest: int = 16) -> DataFrame:
    """A map column with safe keys only and short values, at most ``most`` entries."""
    safe = F.map_filter(column, lambda k, v: k.rlike("^[A-Za-z0-9_.-]{1,40}$") & v.isNotNull() & ~v.rlike(r"^[\[{]"))
    entries = F.slice(F.array_sort(F.map_entries(safe)), 1, most)
    cut = F.transform(entries, lambda e: F.struct(e["key"], F.substring(e["value"], 1, longest)))
    return df.withColumn(column, F.map_from_entries(cut))


def prune(df: DataFrame, at: str, now: Column, months: Column) -> DataFrame:
    """Drops rows older than their number of months."""
    return df.where(F.to_date(F.col(at)) >= F.add_months(F.to_date(now), -months))
