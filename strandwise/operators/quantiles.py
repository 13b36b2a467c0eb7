"""Exact quantiles per key, also where one key holds most rows (D25, G7, N3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.staging import stage

HOT = 1 << 20  # rows of a key that one task may count by itself


def large_keys(df: DataFrame, key: str, hot: int = HOT) -> DataFrame | None:
    """``_k``: keys of more than ``hot`` rows, written; None if there are none."""
    large = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_size")).where(F.col("_size") > hot).select("_k")
    return None if large.isEmpty() else stage(large, "large")


def quantiles(df: DataFrame, key: str, named: Mapping[str, tuple[str, float]], beside: Sequence[Column] = (), hot: int = HOT) -> DataFrame:
    """``key``, the aggregates of ``beside`` and, per name, the quantile of a column with
    linear interpolation: ``{"q90": ("x", 0.9)}``. Nulls take no part; a null key is a key.

    A key of at most ``hot`` rows is settled in one task by ``percentile``, which counts
    its distinct values there. Those of a larger one are selected by rank, see ``_by_rank``.
    """
    return quantiles_beside(df, key, named, beside, large_keys(df, key, hot))


def quantiles_beside(df: DataFrame, key: str, named: Mapping[str, tuple[str, float]], beside: Sequence[Column], large: DataFrame | None) -> DataFrame:
    """``quantiles`` where ``large_keys`` has been asked before, for these or more rows."""
    plain = [F.percentile(F.col(c).cast("double"), F.lit(float(q))).alias(name) for name, (c, q) in named.items()]
    if large is None:
        return df.groupBy(key).agg(*beside, *plain)
    large_key = F.col(key).eqNullSafe(F.col("_k"))
    small = df.join(large, large_key, "left_anti").groupBy(key).agg(*beside, *plain)
    rows = df.join(large, large_key, "left_semi")
    found = rows.groupBy(key).agg(*beside, F.count("*").alias("_size"))
    found = found.join(_by_rank(rows, key, named), large_key, "left").drop("_k", "_size")
    return small.unionByName(found)


def _by_rank(rows: DataFrame, key: str, named: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``_k`` and the quantiles by rank selection; no task holds all values of a key.

    Equal values are counted where they lie, then the distinct ones are dealt into ranges
    of (column, key, value), so that a key with many values spans many ranges. One count
    per key and range tells the ranges that hold a wanted rank; only those are sorted.
    """
    columns = list(dict.fromkeys(c for c, _ in named.values()))
    cell = F.explode(F.array(*(F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns))))
    cells = rows.select(F.col(key).alias("_k"), cell.alias("_x")).select("_k", "_x.*").where("_v is not null")
    counts = cells.groupBy("_c", "_k", "_v").agg(F.count("*").alias("_n"))
    dealt = stage(counts.repartitionByRange("_c", "_k", "_v").withColumn("_part", F.spark_partition_id()), "ranges")

    of_key = Window.partitionBy("_c", "_k")
    before = F.sum("_m").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt.groupBy("_c", "_k", "_part").agg(F.sum("_n").alias("_m"))
    ranges = ranges.withColumns({"_last": F.sum("_m").over(of_key) - 1, "_before": F.coalesce(before, F.lit(0))})

    def place(q: float) -> Column:
        return F.col("_last") * F.lit(float(q))

    wanted = F.lit(False)
    for c, q in set(named.values()):
        holds = (F.ceil(place(q)) >= F.col("_before")) & (F.floor(place(q)) < F.col("_before") + F.col("_m"))
        wanted = wanted | ((F.col("_c") == columns.index(c)) & holds)
    ranges = ranges.where(wanted).select(F.col("_c").alias("_c2"), F.col("_k").alias("_k2"), F.col("_part").alias("_p2"), "_last", "_before")
    mine = (F.col("_c") == F.col("_c2")) & F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_part") == F.col("_p2"))
    upto = F.sum("_n").over(Window.partitionBy("_c", "_k", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    values = dealt.join(ranges, mine).withColumn("_to", F.col("_before") + upto).withColumn("_from", F.col("_to") - F.col("_n"))

    out = []
    for name, (c, q) in named.items():
        here = F.col("_c") == columns.index(c)
        at = lambda rank: F.max(F.when(here & (rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_v")))  # noqa: B023, E731
        low, high = at(F.floor(place(q))), at(F.ceil(place(q)))
        share = F.max(F.when(here, place(q) - F.floor(place(q))))
        out.append(F.when(low == high, low).otherwise((1 - share) * low + share * high).alias(name))
    return values.groupBy("_k").agg(*out)
