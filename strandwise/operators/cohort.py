"""Cohorts and what-if (section F).

A clause is a name with a condition (``include``, ``require``) or its complement
(``exclude``); ``attr`` names the column it is about. A row that fails exactly one clause
is what dropping that clause gains, so one pass answers every what-if.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.columns import all_of, one_of


@dataclass(frozen=True)
class Clause:
    name: str
    kind: str
    attr: str
    values: tuple

    def passes(self) -> Column:
        hit = one_of(F.col(self.attr), self.values)
        if self.kind == "include":
            return hit
        if self.kind == "exclude":
            return ~hit
        if self.kind == "require":
            return F.col(self.attr).isNotNull()
        raise ValueError(self.kind)


def members(df: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    return df.where(all_of([c.passes() for c in clauses]))


def min_group_size(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` members."""
    if least <= 1:
        return df
    big = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(big, key, "left_semi")


def resolve_cohort(df: DataFrame, clauses: Sequence[Clause], study: str, weight: str, least: int = 1) -> DataFrame:
    """One row: members, studies and weight after all clauses and the group floor."""
    rows = min_group_size(members(df, clauses), study, least)
    return rows.agg(F.count("*").alias("samples"), F.countDistinct(study).alias("studies"), F.coalesce(F.sum(F.col(weight).cast("long")), F.lit(0)).alias("weight"))


def _failed(clauses: Sequence[Clause]) -> Column:
    return F.filter(F.array(*(F.when(~c.passes(), F.lit(c.name)) for c in clauses)), lambda x: x.isNotNull())


def what_if(df: DataFrame, clauses: Sequence[Clause], study: str, weight: str, least: int = 1) -> DataFrame:
    """``clause, samples, weight, gain``: totals without each clause, the group floor
    applied anew each time (``clause`` = ``(all)`` keeps every clause)."""
    names = ["(all)", *(c.name for c in clauses)]
    rows = df.select(study, F.col(weight).cast("long").alias("_w"), _failed(clauses).alias("_f")).where(F.size("_f") <= 1)
    # a full member counts for every clause, a near member for the one it fails
    counts = rows.groupBy(study, F.element_at(F.concat("_f", F.array(F.lit(None).cast("string"))), 1).alias("_one")).agg(F.count("*").alias("n"), F.sum("_w").alias("w"))
    used = F.when(F.col("_one").isNull(), F.array(*map(F.lit, names))).otherwise(F.array("_one"))
    per = counts.select(study, F.explode(used).alias("clause"), "n", "w").groupBy(study, "clause").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).where(F.col("n") >= least)
    found = per.groupBy("clause").agg(F.sum("n").alias("samples"), F.sum("w").alias("weight"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "clause string")
    all_ = every.join(found, "clause", "left").fillna(0, ["samples", "weight"])
    base = F.max(F.when(F.col("clause") == "(all)", F.col("samples"))).over(Window.partitionBy(F.lit(1)))
    return all_.select("clause", "samples", "weight", (F.col("samples") - base).alias("gain"))


def unknown_by_attr(df: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """``clause, unknown``: rows that pass everything else and have no fact for it."""
    rows = df.select(_failed(clauses).alias("_f"), *{c.attr for c in clauses}).where(F.size("_f") <= 1)
    aggs = []
    for c in clauses:
        others = F.size(F.array_remove("_f", F.lit(c.name))) == 0
        aggs.append(F.count_if(others & F.col(c.attr).isNull()).alias(c.name))
    one = rows.agg(*aggs)
    return one.unpivot([], [c.name for c in clauses], "clause", "unknown")


def ambiguities(df: DataFrame, attrs: Sequence[str], share: float = 0.05) -> DataFrame:
    """``attr, values``: attributes where two or more values hold the share each."""
    long = df.select(*(F.col(a).cast("string").alias(a) for a in attrs)).unpivot([], list(attrs), "attr", "value").where("value is not null")
    counts = long.groupBy("attr", "value").agg(F.count("*").alias("n"))
    part = F.col("n") / F.sum("n").over(Window.partitionBy("attr"))
    big = counts.withColumn("_s", part).where(F.col("_s") >= share)
    return big.groupBy("attr").agg(F.count("*").alias("values")).where(F.col("values") >= 2)


def unmatched_values(df: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """``clause, value``: asked values that the data never holds."""
    asked = [(c.name, c.attr, str(v)) for c in clauses for v in c.values]
    wanted = df.sparkSession.createDataFrame(asked, "clause string, attr string, value string")
    attrs = sorted({c.attr for c in clauses})
    held = df.select(*(F.col(a).cast("string").alias(a) for a in attrs)).unpivot([], attrs, "attr", "value").where("value is not null").distinct()
    return wanted.join(held, ["attr", "value"], "left_anti").select("clause", "value")


def relaxations(df: DataFrame, clauses: Sequence[Clause], weight: str) -> DataFrame:
    """``clause, alone, without``: weight that a clause matches alone, and weight of the
    query without it."""
    w = F.col(weight).cast("long")
    rows = df.select(w.alias("_w"), *(c.passes().alias(f"p_{i}") for i, c in enumerate(clauses)))
    failed = sum(((~F.col(f"p_{i}")).cast("int") for i in range(len(clauses))), F.lit(0))
    aggs = []
    for i in range(len(clauses)):
        p = F.col(f"p_{i}")
        aggs.append(F.coalesce(F.sum(F.when(p, F.col("_w"))), F.lit(0)).alias(f"alone_{i}"))
        aggs.append(F.coalesce(F.sum(F.when(failed - (~p).cast("int") == 0, F.col("_w"))), F.lit(0)).alias(f"without_{i}"))
    one = rows.agg(*aggs)
    out = F.array(*(F.struct(F.lit(c.name).alias("clause"), F.col(f"alone_{i}").alias("alone"), F.col(f"without_{i}").alias("without")) for i, c in enumerate(clauses)))
    return one.select(F.explode(out).alias("r")).select("r.*")


def suggestions(df: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """``action, clause, total``: results after dropping one filter at a time; where
    that never helps, after keeping only one."""
    one = df.select(*(c.passes().alias(f"p_{i}") for i, c in enumerate(clauses)))
    failed = sum(((~F.col(f"p_{i}")).cast("int") for i in range(len(clauses))), F.lit(0))
    drop = [F.count_if(failed - (~F.col(f"p_{i}")).cast("int") == 0).alias(f"d_{i}") for i in range(len(clauses))]
    keep = [F.count_if(F.col(f"p_{i}")).alias(f"k_{i}") for i in range(len(clauses))]
    sums = one.agg(*drop, *keep)
    helps = F.greatest(*(F.col(f"d_{i}") for i in range(len(clauses)))) > 0 if len(clauses) > 1 else F.col("d_0") > 0
    rows = F.array(
        *(F.struct(F.lit("drop").alias("action"), F.lit(c.name).alias("clause"), F.col(f"d_{i}").alias("total"), helps.alias("ok")) for i, c in enumerate(clauses)),
        *(F.struct(F.lit("keep").alias("action"), F.lit(c.name).alias("clause"), F.col(f"k_{i}").alias("total"), (~helps).alias("ok")) for i, c in enumerate(clauses)),
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*").where("ok and total > 0").select("action", "clause", "total").orderBy(F.desc("total"), "clause")
