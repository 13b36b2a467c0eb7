"""Window functions (section G)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.ordered import ordered

from .quantiles import HOT, large_keys, quantiles_beside


def page_with_totals(df: DataFrame, order: Sequence[Column], page: int, size: int, weight: str) -> DataFrame:
    """One page with the count and weight of the whole result: a one-row aggregate beside
    a top-n, instead of a window over all rows."""
    totals = df.agg(F.count("*").alias("total"), F.sum(F.col(weight).cast("long")).alias("total_weight"))
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.join(totals, F.lit(True))


def first_n_per_group(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    place = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= n).drop("_r")


def best_fact(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return first_n_per_group(df, key, order, 1)


def runs(df: DataFrame, key: str, position: str) -> DataFrame:
    """Consecutive positions per key as ``start, length``; repeats count once."""
    one = df.select(key, F.col(position).cast("long").alias("_p")).distinct()
    island = F.col("_p") - F.row_number().over(Window.partitionBy(key).orderBy("_p"))
    return one.withColumn("_i", island).groupBy(key, "_i").agg(F.min("_p").alias("start"), F.count("*").alias("length")).drop("_i")


def coalesce_ranges(df: DataFrame, key: str, start: str, end: str, gap: int) -> DataFrame:
    """Ranges of a key closer than ``gap`` become one: ``start, end, n, covered, payload``
    (bytes from first to last, and bytes asked for)."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col(start) - before > gap)).cast("int")
    grouped = df.withColumn("_n", new).withColumn("_g", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy(key, "_g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"), F.sum(F.col(end) - F.col(start)).alias("payload"))
    return out.select(key, "start", "end", "n", (F.col("end") - F.col("start")).alias("covered"), "payload")


def prefix_allocation(df: DataFrame, key: str, size: str, cap: int, floor: int) -> DataFrame:
    """The largest groups kept: the fewest smallest are dropped so that every kept
    group's share of ``cap`` reaches ``floor``; the last is never dropped.

    ``df`` has one row per group. Kept groups are a prefix by size, largest first.
    """
    rows = ordered(df.select(key, size), [F.desc(size), F.col(key)], "_r", [(size, "sum", "_s")])
    # the smallest of the first r groups is row r itself
    fits = (F.col("_r") == 1) | (F.col("_s") <= cap) | (F.col(size) * F.lit(cap) / F.col("_s") >= floor)
    last = rows.agg(F.max(F.when(fits, F.col("_r"))).alias("_last"))
    return rows.join(last, F.col("_r") <= F.col("_last")).select(key, size)


def robust_z(df: DataFrame, key: str, column: str, least: int = 4, hot: int = HOT) -> DataFrame:
    """Log value against the group's median and MAD (x 1.4826, 0.15 when zero), with
    ``outlier``: z under -4 and below a fifth of the median. Medians are exact; those of a
    key with more than ``hot`` rows are selected by rank over ranges."""
    rows = df.where(F.col(column) > 0).withColumn("_l", F.log(F.col(column).cast("double")))
    large = large_keys(rows, key, hot)
    mid = quantiles_beside(rows, key, {"_m": ("_l", 0.5), "_raw": (column, 0.5)}, [F.count("*").alias("_n")], large).where(F.col("_n") >= least)
    rows = rows.join(mid, key).withColumn("_off", F.abs(F.col("_l") - F.col("_m")))
    mad = quantiles_beside(rows, key, {"_mad": ("_off", 0.5)}, [], large).select(key, (F.col("_mad") * 1.4826).alias("_d"))
    rows = rows.join(mad, key)
    z = (F.col("_l") - F.col("_m")) / F.when(F.col("_d") == 0, 0.15).otherwise(F.col("_d"))
    return rows.withColumn("z", z).withColumn("outlier", (F.col("z") < -4) & (F.col(column) < F.col("_raw") / 5)).drop("_l", "_m", "_raw", "_n", "_off", "_d")
