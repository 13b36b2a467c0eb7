"""Index-like derived tables (section N)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.ordered import ordered
from strandwise.functions.staging import discard, stage

from .quantiles import quantiles


def encode(df: DataFrame, column: str) -> DataFrame:
    """Dictionary of a column, case folded: ``value, n, code`` by falling frequency, then
    label; code 0 is unknown."""
    value = F.lower(F.trim(F.col(column)))
    counts = df.select(F.nullif(value, F.lit("")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    known = ordered(counts.where("value is not null"), [F.desc("n"), F.col("value")], "code")
    return known.unionByName(counts.where("value is null").withColumn("code", F.lit(0)))


def cell_summary(rows: DataFrame, dims: Sequence[str], weight: str) -> DataFrame:
    return rows.groupBy(*dims).agg(F.sum(F.col(weight).cast("long")).alias("weight"), F.count("*").alias("n"))


def sample_stats(rows: DataFrame, key: str, metrics: Sequence[str], exact: bool = True) -> DataFrame:
    """Least, greatest, median and 0.9 quantile per key. Exact quantiles of a hot key are
    selected by rank over ranges; ``exact=False`` takes sketches of fixed size, without a
    look at sizes."""
    ends = [f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("min", F.min), ("max", F.max))]
    named = {f"{m}_{name}": (m, q) for m in metrics for name, q in (("q50", 0.5), ("q90", 0.9))}
    if exact:
        return quantiles(rows, key, named, ends)
    return rows.groupBy(key).agg(*ends, *(F.percentile_approx(m, F.lit(q)).alias(name) for name, (m, q) in named.items()))


def closure(edges: DataFrame, most: int = 60) -> DataFrame:
    """``term, ancestor, distance``: every pair with its shortest distance, selves
    included, from ``term, parent`` edges; a join per level until nothing is new, also
    where edges run in a circle. Ancestors more than ``most`` levels away are an error.
    Each level is written, so that no level is worked out twice."""
    nodes = edges.select(F.explode(F.array("term", "parent")).alias("term")).where("term is not null").distinct()
    step = stage(edges.select(F.col("term").alias("_via"), F.col("parent").alias("ancestor")).where("ancestor is not null").distinct(), "edges")
    found = front = stage(nodes.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("distance")), "closure")
    depth = 0
    while True:
        depth += 1
        up = front.select("term", F.col("ancestor").alias("_via")).join(step, "_via").select("term", "ancestor").distinct()
        front = stage(up.join(found.select("term", "ancestor"), ["term", "ancestor"], "left_anti").withColumn("distance", F.lit(depth)), "closure")
        if front.isEmpty():
            discard(step, front)
            return found
        if depth > most:
            raise ValueError(f"ancestors more than {most} levels away")
        found = found.unionByName(front)


def sample_facts(samples: DataFrame, facts: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Wide facts of served samples: best value per attribute, pivoted and joined."""
    order = Window.partitionBy(key, "attr").orderBy(F.desc("confidence"), "value")
    best = facts.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    wide = best.groupBy(key).pivot("attr", list(attrs)).agg(F.max("value"))
    return samples.join(wide, key, "left")


def manifest_rows(groups: DataFrame, members: DataFrame, excluded: DataFrame, key: str, member: str, size: str) -> DataFrame:
    """Download rows: members net of exclusions, bytes, and the format they allow."""
    kept = members.join(excluded.select(member), member, "left_anti")
    sums = kept.groupBy(key).agg(F.count("*").alias("n_samples"), F.sum(F.col(size).cast("long")).alias("bytes"))
    rows = groups.select(key).join(sums, key, "left").fillna(0, ["n_samples", "bytes"])
    form = F.when(F.col("n_samples") == 0, "none").when(F.col("n_samples") == 1, "single").otherwise("bundle")
    return rows.withColumn("format", form)
