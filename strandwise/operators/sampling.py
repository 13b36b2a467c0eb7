"""Seeded sampling and allocation (section M). Nothing depends on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.hashing import fnv1a32, hash32
from strandwise.functions.ordered import ordered

from .predicates import in_range

CHUNK_SALT = 0x5BD1E995


def seeded_sample(df: DataFrame, a: str, b: str, n: int, seed: int, mode: str = "uniform", chunk: int = 64) -> DataFrame:
    """The n rows with the smallest (hash, a, b): a top-n, never a full sort. ``chunks``
    hashes whole chunks of ``b``. Adds how many rows were eligible and remain."""
    h = hash32(seed, F.col(a), F.col(b)) if mode == "uniform" else hash32(seed ^ CHUNK_SALT, F.col(a), F.floor(F.col(b) / chunk))
    rows = df.withColumn("h", h)
    eligible = rows.agg(F.count("*").alias("eligible"))
    top = rows.orderBy("h", a, b).limit(n)
    return top.join(eligible, F.lit(True)).withColumn("remaining", F.greatest(F.col("eligible") - n, F.lit(0)))


def allocate(groups: DataFrame, key: str, size: str, cap: int, seed: str, floor: int = 1) -> DataFrame:
    """``key, size, keep``: proportional shares of ``cap`` by largest remainder.

    The fewest smallest groups are dropped so that every share reaches the floor, never
    the last one; ties follow a seeded hash. Groups are ranked range by range, so their
    number may grow with the data.
    """
    rows = groups.select(F.col(key), F.col(size).cast("long").alias("size"), fnv1a32(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))).alias("_t"))
    rows = ordered(rows, [F.desc("size"), F.desc("_t"), F.desc(key)], "_r", [("size", "sum", "_s")])
    fits = (F.col("_r") == 1) | (F.col("_s") <= cap) | (F.col("size") * F.lit(float(cap)) / F.col("_s") >= max(1, floor))
    last = rows.agg(F.max(F.when(fits, F.col("_r"))).alias("_last"))
    rows = rows.join(last, F.lit(True))
    live = F.col("_r") <= F.col("_last")
    rest = rows.where(live).agg(F.sum("size").alias("_rest"))
    rows = rows.join(rest, F.lit(True))
    share = F.col("size") * F.lit(float(cap)) / F.col("_rest")
    rows = rows.withColumn("_q", F.when(live, share).otherwise(F.lit(-1.0))).withColumn("_f", F.floor("_q"))
    left = rows.where(live).agg((F.lit(cap) - F.coalesce(F.sum("_f"), F.lit(0))).alias("_left"))
    rows = rows.withColumn("_m", F.when(live, F.col("_q") - F.col("_f")).otherwise(-1.0))
    rows = ordered(rows, [F.desc("_m"), F.col("_t"), F.col(key)], "_turn").join(left, F.lit(True))
    keep = F.least(F.col("size"), F.col("_f") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0))
    return rows.select(key, "size", F.when(~live, 0).when(F.col("_rest") <= cap, F.col("size")).otherwise(keep).cast("long").alias("keep"))


def _stream(seed: int):
    """Seeded floats in [0, 1): the published 32-bit generator."""
    mask = 0xFFFFFFFF
    state = seed & mask
    while True:
        state = (state + 0x6D2B79F5) & mask
        t = state
        t = (t ^ (t >> 15)) * (t | 1) & mask
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & mask)) & mask
        yield ((t ^ (t >> 14)) & mask) / 4294967296


def positions_of(n: int, k: int, seed: int) -> list[int]:
    """k of n positions by selection sampling from the seeded stream, in order."""
    out: list[int] = []
    for i, u in zip(range(n), _stream(seed), strict=False):
        if len(out) == k:
            break
        if u * (n - i) < k - len(out):
            out.append(i)
    return out


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for byte in text.encode():
        h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
    return h


def select_positions(groups: DataFrame, key: str, n: str, k: str, seed: str) -> DataFrame:
    """``key, position``: k of n positions per group. The stream is sequential by
    definition, so each row (one group) is drawn on its own inside a task."""
    rows = groups.select(F.col(key).cast("string").alias("key"), F.col(n).cast("long").alias("n"), F.col(k).cast("long").alias("k"))

    def draw(batches):
        for batch in batches:
            drawn = [positions_of(n, k, fnv1a(f"{seed}|{key}")) for key, n, k in zip(batch["key"], batch["n"], batch["k"], strict=True)]
            yield pd.DataFrame({"key": batch["key"].to_numpy(), "positions": drawn})

    drawn = rows.mapInPandas(draw, "key string, positions array<long>")
    return drawn.select("key", F.explode("positions").alias("position"))


def downsample(df: DataFrame, key: str, order: Sequence[Column], cap: int, seed: int, floor: int = 1) -> DataFrame:
    """Rows kept by a proportional allocation; within a group those first in ``order``
    (a seeded hash, with ties broken)."""
    plan = allocate(df.groupBy(key).agg(F.count("*").alias("n")), key, "n", cap, str(seed), floor).select(key, "keep")
    place = Window.partitionBy(key).orderBy(*order)
    rows = df.join(plan, key).where("keep > 0").withColumn("_r", F.row_number().over(place))
    return rows.where(F.col("_r") <= F.col("keep")).drop("_r", "keep")


def downsample_positions(df: DataFrame, key: str, order: Sequence[Column], cap: int, seed: int, floor: int = 1) -> DataFrame:
    """Rows kept by a proportional allocation, of each group those at the positions that
    ``select_positions`` draws, with their ``position`` (from 0 in ``order``, without ties)."""
    plan = allocate(df.groupBy(key).agg(F.count("*").alias("n")), key, "n", cap, str(seed), floor).select(key, "size", "keep")
    kept = select_positions(plan.where("keep > 0"), key, "size", "keep", str(seed)).withColumnRenamed("key", "_key")
    placed = df.withColumn("position", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))
    same = (F.col(key).cast("string") == F.col("_key")) & (placed["position"] == kept["position"])
    return placed.join(kept, same, "left_semi")


def sample_prune(stats: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Groups whose ``<column>_min`` .. ``<column>_max`` can meet every range."""
    for c, (low, high) in ranges.items():
        if low is not None:
            stats = stats.where(in_range(f"{c}_max", low))
        if high is not None:
            stats = stats.where(in_range(f"{c}_min", None, high))
    return stats
