"""Places and running values over a global order, without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

_AGGREGATE = {"sum": F.sum, "max": F.max}
_TOGETHER = {"sum": lambda a, b: a + b, "max": F.greatest}


def ordered(df: DataFrame, order: Sequence[Column], place: str | None = "place", running: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Adds ``place`` (from 1) and, per (column, ``sum`` or ``max``, name) of ``running``,
    the value over all rows up to and with this one. ``order`` must leave no ties.

    Rows are dealt into ranges of the order and written; each range is windowed by
    itself, and what the ranges before it hold (one row per range) is added.
    """
    rows = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), *(_AGGREGATE[kind](c).alias(f"_{name}") for c, kind, name in running))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), *(_AGGREGATE[kind](f"_{name}").over(before).alias(f"_{name}") for _, kind, name in running))
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # one row per range
    out = rows.join(F.broadcast(starts), "_part")
    made = {name: F.coalesce(_TOGETHER[kind](F.col(f"_{name}"), _AGGREGATE[kind](c).over(upto)), _AGGREGATE[kind](c).over(upto)) for c, kind, name in running}
    if place:
        made[place] = F.col("_start") + F.row_number().over(inside)
    return out.withColumns(made).drop("_part", "_start", *(f"_{name}" for _, _, name in running))
