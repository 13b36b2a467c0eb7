"""Sorts, limits, top-k and pages (section H), and set operations (section I)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_page(df: DataFrame, sorts: Mapping[str, Column], sort: str, ties: Sequence[str], page: int, size: int) -> DataFrame:
    """A page under a named sort, unknown last, ties by key."""
    return df.orderBy(sorts[sort], *ties).offset((page - 1) * size).limit(size)


def accession_number(column: str) -> Column:
    """The number inside an identifier."""
    return F.regexp_extract(F.col(column), "([0-9]+)$", 1).cast("long")


def accession_order(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(accession_number(column), column)


def rank_onehot(df: DataFrame, key: str, soft: Mapping[str, Mapping[str, float]], most: int) -> DataFrame:
    """Cosine of a weighted query against one-hot rows: attributes unknown on a row do not
    enter its norm; zero scores are left out; ties go to the smaller key."""
    dot, known = F.lit(0.0), F.lit(0)
    for attr, weights in soft.items():
        for value, w in weights.items():
            dot = dot + F.when(F.col(attr) == value, F.lit(float(w))).otherwise(0.0)
        known = known + F.when(F.col(attr).isNotNull(), 1).otherwise(0)
    size = sum(w * w for ws in soft.values() for w in ws.values()) ** 0.5
    score = F.round(F.when(known > 0, dot / (F.sqrt(known.cast("double")) * size)).otherwise(0.0), 6)
    return df.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(most)


def cursor_page(df: DataFrame, keys: Sequence[str], after: Sequence, n: int) -> DataFrame:
    """Rows strictly after a composite key, in its order."""
    later = None
    for i in range(len(keys) - 1, -1, -1):
        here = F.col(keys[i]) > after[i]
        later = here if later is None else here | ((F.col(keys[i]) == after[i]) & later)
    return df.where(later).orderBy(*keys).limit(n)


def rank_groups(df: DataFrame, key: str, weight: str, mode: str, n: int, order: Sequence | None = None, hashed: Column | None = None) -> DataFrame:
    """Groups by weight (``weight``), in a given order (``given``) or by a seeded hash
    (``hash``); the first n with their ``place``."""
    sums = df.groupBy(key).agg(F.sum(F.col(weight).cast("long")).alias("weight")).where("weight > 0")
    if mode == "weight":
        by = [F.desc("weight"), F.col(key)]
    elif mode == "given":
        listed = F.array_position(F.array(*map(F.lit, order or [])), F.col(key))
        sums = sums.where(F.col(key).isin(list(order or [])))
        by = [listed]
    else:
        by = [hashed, F.col(key)]
    top = sums.orderBy(*by).limit(n)  # n rows at most are numbered
    return top.select(key, "weight", F.row_number().over(Window.orderBy(*by)).alias("place"))


def top_studies(df: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """Largest groups by weight, and whether others were left out."""
    sums = df.groupBy(key).agg(F.sum(F.col(weight).cast("long")).alias("weight"))
    more = sums.agg((F.count("*") > n).alias("truncated"))
    return sums.orderBy(F.desc("weight"), key).limit(n).join(more, F.lit(True))


def hit_union(*hits: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, hits).distinct()


def merge_scores(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both hit lists as one row per id: best score of each side and number of matches."""
    left = a.select(key, F.col("score").alias("a_score"))
    right = b.select(key, F.col("score").alias("b_score"))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max("a_score").alias("a_score"), F.max("b_score").alias("b_score"), F.count("b_score").alias("matches"))


def mask_ops(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of AND, OR, AND NOT of two member sets: one full join of distinct ids."""
    key = a.columns[0]
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(F.col(b.columns[0]).alias(key)).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count("*").alias("either"), F.count_if(F.col("_b").isNull()).alias("only_a"))


def carry_dedupe(tiers: Sequence[DataFrame], key: str, order: Sequence[str], most: int) -> DataFrame:
    """Results of several tiers in their order, no repeats."""
    tagged = [df.select(key, *order, F.lit(i).alias("tier")) for i, df in enumerate(tiers)]
    best = reduce(DataFrame.unionByName, tagged).groupBy(key, *order).agg(F.min("tier").alias("tier"))
    return best.orderBy("tier", *order, key).limit(most)
