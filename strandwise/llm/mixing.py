"""Mixing sources to target weights by capped water-filling.

Every source asks for words in proportion to its weight; a source stops at ``cap`` times
its own size and what it leaves is shared again by weight. The end of that process has a
closed form: with sources in order of cap / weight there is one water level L, and each
source gets min(cap, L * weight). Sorting runs over one small row per source.

Within a source each document is taken floor(target / size) whole times, and a part of
the documents once more: those that come first in a seeded hash order until the rest of
the target is met. The order is cut into hash buckets first, so that even a source with a
third of all documents is never sorted by one task: bucket sums (one row per source and
bucket) give each bucket's start, and only rows of one bucket are ordered together.

Edge cases: a null text has size 0; a null source is a source of its own, after the
others; sources without words get target 0; repeated rows are separate documents; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, stage, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 17
#: Rows of one source that are ordered together are about its rows divided by this.
BUCKETS = 1024


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(place) - 1) % len(weights) + 1)
    capped = by_source.withColumn("weight", weight.cast("double")).withColumn("most", (cap * F.col("source_size")).cast("double"))
    order = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = capped.withColumn("level", level)
    # the first source whose cap is above its level sets the level for all after it
    settled = F.first(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return levels.select("source", "source_size", F.coalesce(F.least(F.col("most"), settled * F.col("weight")), F.col("most")).alias("target"))


def _hash(seed: int) -> Column:
    """Seeded order of documents, as hex digits: the same on every engine and in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, buckets: int = BUCKETS, also: Sequence[str] = ()
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``
    and the columns named by ``also``; ``copies`` is how often the mix repeats the
    document, ``taken`` its words in all."""
    sizes = stage(docs.select("doc_id", "source", *also, count_words(text_of()).alias("size")), "sizes")
    return mix_sizes(sizes, weights, share, cap, seed, buckets, also)


def mix_sizes(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, buckets: int = BUCKETS, also: Sequence[str] = ()
) -> DataFrame:
    targets = source_targets(sizes, weights, share, cap)
    key = ["source", "bucket"]
    dealt = sizes.withColumn("order", _hash(seed)).withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))
    sums = dealt.groupBy(key).agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*key, F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("start"))
    plan = starts.join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    plan = plan.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), "start", "source_size", "target")
    rows = dealt.join(plan, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows = rows.withColumn("copies", whole)
    part = F.col("target") - F.col("copies") * F.col("source_size")
    more = (F.col("start") + F.col("size") / 2.0 < part) & (F.col("size") > 0)
    rows = rows.withColumn("copies", F.col("copies") + more.cast("int"))
    return rows.select("doc_id", "source", *also, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
