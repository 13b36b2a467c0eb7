"""Facets (section E): counts per value, each without its own filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.columns import yes

from .predicates import bin_label, bin_number


def facets(df: DataFrame, filters: Mapping[str, Column], fields: Sequence[str], parent: str | None = None) -> DataFrame:
    """``field, value, n``: counts per value of each field under all filters but the
    field's own, and the total under all (``field`` = ``total``).

    One scan: each row carries the names of the filters it fails. It counts for a field
    when it fails nothing, or only that field's filter. With ``parent`` distinct parents
    count instead of rows.
    """
    failed = F.filter(F.array(*(F.when(~yes(c), F.lit(name)) for name, c in filters.items())), lambda x: x.isNotNull()) if filters else F.array().cast("array<string>")
    keep = [*fields] + ([parent] if parent else [])
    rows = df.select(*(F.col(c) for c in keep), failed.alias("_failed")).where(F.size("_failed") <= 1)
    only = F.element_at(F.concat("_failed", F.array(F.lit(None).cast("string"))), 1)
    options = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(f).alias("own")) for f in fields]
    options.append(F.struct(F.lit("total").alias("field"), F.lit("").alias("value"), F.lit(None).cast("string").alias("own")))
    long = rows.select(*([parent] if parent else []), only.alias("_only"), F.explode(F.array(*options)).alias("o"))
    long = long.where(F.col("_only").isNull() | yes(F.col("_only") == F.col("o.own"))).where("o.value is not null")
    count = F.countDistinct(parent) if parent else F.count("*")
    return long.groupBy(F.col("o.field").alias("field"), F.col("o.value").alias("value")).agg(count.alias("n"))


def array_facet(df: DataFrame, parent: str, column: str, most: int) -> DataFrame:
    """Distinct parents per element of an array column, blank elements out, top n."""
    rows = df.select(parent, F.explode(column).alias("value")).where("trim(value) != ''")
    return rows.groupBy("value").agg(F.countDistinct(parent).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def threshold_facet(df: DataFrame, column: str, steps: Sequence[float]) -> DataFrame:
    """``bucket, n``: rows at or above the largest step that they reach; NULL below all."""
    bucket = F.lit(None).cast("double")
    for step in steps:
        bucket = F.when(F.col(column) >= step, F.lit(float(step))).otherwise(bucket)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def bin_facet(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Counts per bin in the bins' own order (``place`` from 0)."""
    rows = df.select(bin_number(column, edges).alias("place"), bin_label(column, edges).alias("bin")).where("place is not null")
    return rows.groupBy("place", "bin").agg(F.count("*").alias("n")).orderBy("place")


def facet_unknown(df: DataFrame, column: str) -> DataFrame:
    """``value, n, known, unknown``: counts per value beside known and unknown rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    sums = counts.agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("known"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
    return counts.where("value is not null").join(sums, F.lit(True))


def weighted_facets(df: DataFrame, fields: Sequence[str], weight: str, sample: str, most: int = 40) -> DataFrame:
    """``field, value, weight, samples``: unknown is a row of its own; top n per field."""
    long = df.select(sample, F.col(weight).cast("long").alias("_w"), *(F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias(f) for f in fields))
    long = long.unpivot([sample, "_w"], list(fields), "field", "value")
    counts = long.groupBy("field", "value").agg(F.sum("_w").alias("weight"), F.countDistinct(sample).alias("samples"))
    place = Window.partitionBy("field").orderBy(F.desc("weight"), "value")
    return counts.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= most).drop("_r")


def flag_facet(df: DataFrame, flags: Mapping[str, Column], weight: str) -> DataFrame:
    """One row per flag; rows with several flags count in each, without any as unknown."""
    found = F.filter(F.array(*(F.when(yes(c), F.lit(n)) for n, c in flags.items())), lambda x: x.isNotNull())
    names = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))
    return df.select(F.explode(names).alias("flag"), F.col(weight).cast("long").alias("_w")).groupBy("flag").agg(F.sum("_w").alias("weight"), F.count("*").alias("n"))


def contributing_terms(df: DataFrame, closure: DataFrame, term: str, wanted: Sequence[str], weight: str) -> DataFrame:
    """Terms at or below the wanted ones that really brought weight."""
    below = closure.where(F.col("ancestor").isin(list(wanted))).select(F.col("term").alias(term)).distinct()
    sums = df.groupBy(term).agg(F.sum(F.col(weight).cast("long")).alias("weight"))
    return sums.join(below, term, "left_semi").where("weight > 0").withColumnRenamed(term, "term")


def top_vocab(df: DataFrame, column: str, most: int) -> DataFrame:
    value = F.lower(F.trim(F.col(column)))
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).where("value is not null and value != ''")
    return counts.orderBy(F.desc("n"), "value").limit(most)
