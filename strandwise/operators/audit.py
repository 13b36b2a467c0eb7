"""Quality rules and audits (section L)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.columns import yes

# Fixed thresholds of the quality rules.
REMOVED_BELOW = {"mapping": 0.05, "genes": 10}
LOW_BELOW = {"genes": 30, "mapping": 0.2}
PLATE_CEILING, DROPLET_REVIEW, AMBIENT_FLOOR, IMPLAUSIBLE = 5_000, 20_000, 500, 200_000


def qc_tier(genes: Column, mapping: Column) -> Column:
    """2 removed, 1 low, 0 pass; what is not measured is never judged."""
    removed = (mapping < REMOVED_BELOW["mapping"]) & (genes < REMOVED_BELOW["genes"])
    low = yes(genes < LOW_BELOW["genes"]) | yes(mapping < LOW_BELOW["mapping"])
    return F.when(yes(removed), 2).when(low, 1).otherwise(0)


def qc_reasons(genes: Column, mapping: Column) -> Column:
    """The reasons behind a tier, comma-joined."""
    few = F.when(genes < LOW_BELOW["genes"], F.concat(F.lit("median "), F.round(genes).cast("long"), F.lit(" genes per cell (below 30)")))
    poor = F.when(mapping < LOW_BELOW["mapping"], F.concat(F.format_number(mapping * 100, 1), F.lit("% of reads mapped (below 20%)")))
    return F.concat_ws(", ", few, poor)


def count_verdict(protocol: Column, cells: Column, umis: Column, plate: Sequence[str], combinatorial: Sequence[str]) -> Column:
    """``ok``, ``suspect`` or ``unverified`` from the class of protocol and its limits."""
    is_plate, is_many = yes(protocol.isin(list(plate))), yes(protocol.isin(list(combinatorial)))
    return (
        F.when(cells.isNull(), "unverified")
        .when(~is_many & (cells > IMPLAUSIBLE), "suspect")
        .when(is_plate & (cells > PLATE_CEILING), "suspect")
        .when(~is_plate & ~is_many & (cells > DROPLET_REVIEW), F.when(umis.isNull(), "unverified").when(umis < AMBIENT_FLOOR, "suspect").otherwise("ok"))
        .otherwise("ok")
    )


def study_suspect(families: Column, cells: Column, n: Column, family: str = "plate", ceiling: int = PLATE_CEILING) -> Column:
    """Average per sample over the ceiling of a family."""
    return yes(F.array_contains(families, family) & (cells / F.nullif(n, F.lit(0)) > ceiling))


def usable(bytes_: Column, cells: Column, least: int) -> Column:
    return yes(bytes_ >= least) & yes(cells >= 1)


@dataclass(frozen=True)
class Check:
    """A named condition that no row of a table should meet."""

    name: str
    severity: int
    bad: Column


def run_checks(df: DataFrame, checks: Sequence[Check], reachable: Column | None = None) -> DataFrame:
    """``check, hits, reachable, rank_score, place``: all checks of a table in one pass;
    score = severity x log10(hits + 1)."""
    reach = reachable if reachable is not None else F.lit(True)
    aggs = [a for i, c in enumerate(checks) for a in (F.count_if(yes(c.bad)).alias(f"h_{i}"), F.count_if(yes(c.bad) & yes(reach)).alias(f"r_{i}"))]
    rows = F.array(*(F.struct(F.lit(c.name).alias("check"), F.col(f"h_{i}").alias("hits"), F.col(f"r_{i}").alias("reachable"), F.round(c.severity * F.log10(F.col(f"h_{i}") + 1), 4).alias("rank_score")) for i, c in enumerate(checks)))
    flat = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    # one row per check
    return flat.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank_score"), "check")))


def run_checks_each(df: DataFrame, checks: Sequence[Check], reachable: Column | None = None) -> DataFrame:
    """``run_checks`` with ``error``: a check that raises is reported, with null counts and
    in the last places, and the others go on. All checks share one pass; only where that
    raises, halves are tried until the checks at fault stand alone, so that f faults among n
    checks cost some f x log2(n) passes. One row per check comes to the driver."""

    def counts(part: Sequence[Check]) -> list[tuple]:
        try:
            return [(r["check"], r.hits, r.reachable, r.rank_score, None) for r in run_checks(df, part, reachable).collect()]
        except PySparkException as e:
            if len(part) == 1:
                return [(part[0].name, None, None, None, e.getCondition() or type(e).__name__)]
            half = len(part) // 2
            return counts(part[:half]) + counts(part[half:])

    found = df.sparkSession.createDataFrame(counts(list(checks)) if checks else [], "check string, hits long, reachable long, rank_score double, error string")
    # one row per check
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("rank_score"), "check")))


def examples(df: DataFrame, check: Check, key: str, n: int = 5) -> DataFrame:
    return df.where(check.bad).orderBy(key).select(F.lit(check.name).alias("check"), F.col(key).cast("string").alias("example")).limit(n)


def never_populated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``: numeric columns that are zero or NULL in every row."""
    one = df.agg(*(F.count_if(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0).alias(c) for c in columns))
    return one.unpivot([], list(columns), "column", "filled").where("filled = 0").select("column")


def case_variants(df: DataFrame, column: str) -> DataFrame:
    """``folded, spellings``: values that differ only by case or spaces around."""
    folded = F.lower(F.trim(F.col(column)))
    return df.groupBy(folded.alias("folded")).agg(F.countDistinct(column).alias("spellings")).where("spellings > 1")


def duplicate_text(df: DataFrame, text: str, entity: str) -> DataFrame:
    """``fingerprint, entities``: the same text in several entities."""
    rows = df.where(F.length(F.trim(F.col(text))) > 0)
    return rows.groupBy(F.md5(F.col(text).cast("binary")).alias("fingerprint")).agg(F.countDistinct(entity).alias("entities")).where("entities > 1")


def duplicate_fingerprint(df: DataFrame, columns: Sequence[str], entity: str) -> DataFrame:
    """Equal metrics in different entities."""
    known = df.dropna(subset=list(columns))
    return known.groupBy(*columns).agg(F.countDistinct(entity).alias("entities"), F.min(entity).alias("first_entity")).where("entities > 1")


def peer_outliers(df: DataFrame, key: str, column: str) -> DataFrame:
    from .windows import robust_z

    return robust_z(df, key, column).where("outlier")


def implausible_ratio(df: DataFrame, key: str, above: str, below: str, least: float, n: int) -> DataFrame:
    """Rows whose ratio of two columns is under a floor, smallest first."""
    ratio = F.try_divide(F.col(above), F.col(below))
    return df.select(key, F.round(ratio, 6).alias("ratio")).where(F.col("ratio") < least).orderBy("ratio", key).limit(n)
