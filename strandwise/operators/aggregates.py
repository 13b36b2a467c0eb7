"""Aggregations (section D): totals, roll-ups, shares, cards, coverage and comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.columns import money, yes
from strandwise.functions.ordered import ordered

from .quantiles import quantiles


def totals(df: DataFrame, weight: str, sample: str, study: str) -> DataFrame:
    """One row: weight, distinct samples and studies, rows."""
    return df.agg(F.coalesce(F.sum(F.col(weight).cast("long")), F.lit(0)).alias("weight"), F.countDistinct(sample).alias("samples"), F.countDistinct(study).alias("studies"), F.count("*").alias("n_rows"))


def grouped_count(df: DataFrame, by: Sequence[str], weight: str, most: int = 10_000, summary: DataFrame | None = None, where: Mapping[str, Sequence] | None = None, rows: Column | None = None) -> DataFrame:
    """Weighted counts by up to three keys, largest first; ``truncated`` says whether
    groups were left out. ``where`` (column -> accepted values) and ``rows`` (any condition)
    filter first.

    ``summary``, sums of ``weight`` over all rows of ``df`` by some columns, is used in place
    of rows where it can answer: it has every key and every column of ``where``, and no
    condition on single rows is asked.
    """
    if len(by) > 3:
        raise ValueError("at most three keys")
    where = dict(where or {})
    answers = summary is not None and rows is None and {*by, *where, weight} <= {*summary.columns}
    source = summary if answers else df if rows is None else df.where(rows)
    for c, values in where.items():
        source = source.where(F.col(c).isin(list(values)))
    counts = source.groupBy(*by).agg(F.sum(F.col(weight).cast("long")).alias("weight"))
    n = counts.agg(F.count("*").alias("_n")).select((F.col("_n") > most).alias("truncated"))
    top = counts.orderBy(F.desc("weight"), *by).limit(most)
    return top.join(n, F.lit(True))


def corpus_stats(df: DataFrame, status: str, weight: str, kind: str, done: str, failure: str, most: int = 40) -> DataFrame:
    """``metric, value``: conditional counts and averages, distinct kinds of done rows,
    and the most frequent failure kinds (as ``failure:<kind>``)."""
    one = df.agg(
        F.count("*").cast("double").alias("all"),
        F.count_if(F.col(status) == done).cast("double").alias("done"),
        F.avg(F.when(F.col(status) == done, F.col(weight))).alias("avg_done"),
        F.countDistinct(F.when(F.col(status) == done, F.col(kind))).cast("double").alias("kinds_done"),
    )
    flat = one.unpivot([], ["all", "done", "avg_done", "kinds_done"], "metric", "value")
    fails = df.where(F.col(status) == failure).groupBy(kind).agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), kind).limit(most)
    return flat.unionByName(fails.select(F.concat(F.lit("failure:"), kind).alias("metric"), "value"))


def accounting(df: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """One row: ``total``, one count per part and ``rest``; parts sum to the total, and
    no figure is below zero."""
    counts = df.agg(F.count("*").alias("total"), *(F.count_if(yes(c)).alias(name) for name, c in parts.items()))
    rest = F.greatest(F.col("total") - sum((F.col(n) for n in parts), F.lit(0)), F.lit(0))
    return counts.withColumn("rest", rest)


def clean_distinct(df: DataFrame, column: str, placeholders: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values, case folded, of two words at least, placeholders left out."""
    value = F.lower(F.trim(F.col(column)))
    ok = value.contains(" ") & ~value.isin([p.lower() for p in placeholders])
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(count(F.when(ok, value)).alias("n_distinct"))


def majority(df: DataFrame, key: str, column: str, out: str | None = None) -> DataFrame:
    """Most frequent value per key; ties go to the smaller value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("_n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_b"))
    return best.select(key, F.col("_b.v").alias(out or column))


def distinct_list(df: DataFrame, key: str, column: str, most: int) -> DataFrame:
    """The first ``most`` distinct non-empty values per key, in order. Values are made
    distinct before they are gathered."""
    value = F.nullif(F.col(column).cast("string"), F.lit(""))
    one = df.select(key, value.alias("_v")).where("_v is not null").distinct()
    place = Window.partitionBy(key).orderBy("_v")
    kept = one.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= most)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list("_v")).alias(column))


def study_rollup(samples: DataFrame, qc: DataFrame, key: str, sample: str, status: str, kind: str, weight: str, done: str, most: int = 20) -> DataFrame:
    """All roll-up columns of a study from its served samples. ``qc``: sample, tier."""
    rows = samples.join(qc.select(sample, "tier"), sample, "left")
    is_done = F.col(status) == done
    counts = rows.groupBy(key).agg(
        F.count("*").alias("n_total"),
        F.count_if(is_done).alias("n_done"),
        F.sum(F.when(is_done, F.col(weight).cast("long")).otherwise(0)).alias("weight"),
        F.count_if(yes(F.col("tier") == 0)).alias("n_usable"),
        F.count_if(yes(F.col("tier") >= 1)).alias("n_low"),
        F.sum(F.when(F.col("tier") >= 1, F.col(weight).cast("long")).otherwise(0)).alias("low_weight"),
    )
    kinds = distinct_list(rows, key, kind, most).select(key, F.array_join(kind, "|").alias("kinds"))
    return counts.join(majority(rows, key, kind, "main_kind"), key, "left").join(kinds, key, "left")


def rollup_drift(stored: DataFrame, fresh: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose stored roll-up differs from the detail, missing ones included."""
    a = stored.select(key, F.struct(*columns).alias("_a"))
    b = fresh.select(key, F.struct(*columns).alias("_b"))
    return a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def share_facts(counts: DataFrame, group: str, value: str, weight: str, least: int, share: float) -> DataFrame:
    """Values that hold at least a share of a large enough group, with the evidence."""
    sums = counts.groupBy(group, value).agg(F.sum(F.col(weight).cast("long")).alias("n"))
    return _shares(sums, sums.groupBy(group).agg(F.sum("n").alias("total")), group, value, least, share)


def _shares(sums: DataFrame, all_: DataFrame, group: str, value: str, least: int, share: float) -> DataFrame:
    part = F.col("n") / F.col("total")
    rows = sums.join(all_, group).where((F.col("total") >= least) & (part >= share))
    return rows.select(group, value, F.round(part, 4).alias("share"), F.concat(F.col("n"), F.lit(" of "), F.col("total")).alias("evidence"))


def share_facts_rolled(counts: DataFrame, closure: DataFrame, group: str, value: str, weight: str, least: int, share: float) -> DataFrame:
    """The same after each count is credited to every ancestor of its value."""
    base = counts.groupBy(group, value).agg(F.sum(F.col(weight).cast("long")).alias("n"))
    all_ = base.groupBy(group).agg(F.sum("n").alias("total"))
    up = base.join(closure.select(F.col("term").alias(value), "ancestor"), value).groupBy(group, F.col("ancestor").alias(value)).agg(F.sum("n").alias("n"))
    return _shares(up, all_, group, value, least, share)


def label_rollup(facts: DataFrame, study: str, attr: str, value: str, sample: str, confidence: str) -> DataFrame:
    return facts.groupBy(study, attr, value).agg(F.countDistinct(sample).alias("n_samples"), F.max(confidence).alias("best_confidence"))


def lineage_rollup(df: DataFrame, closure: DataFrame, term: str, weight: str, most: int = 60) -> DataFrame:
    """Weight per term at every level; summed per term before the closure is joined."""
    base = df.groupBy(F.col(term).alias("term")).agg(F.sum(F.col(weight).cast("long")).alias("w"))
    up = base.join(closure.select("term", "ancestor"), "term").groupBy(F.col("ancestor").alias("term")).agg(F.sum("w").alias("weight"))
    return up.orderBy(F.desc("weight"), "term").limit(most)


def expression_summary(triples: DataFrame, cells: DataFrame, cell: str, gene: str, value: str, group: str) -> DataFrame:
    """Per group and gene: cells, mean, mean per 10,000 of the cell's total and share of
    non-zero cells. Zeros count: denominators come from the cell table."""
    n_cells = cells.groupBy(group).agg(F.count("*").alias("n_cells"))
    per = triples.groupBy(cell, gene).agg(F.sum(money(value)).alias("v"))
    size = per.groupBy(cell).agg(F.sum("v").alias("total"))
    rows = per.join(size, cell).join(cells.select(cell, group), cell)
    rate = F.round(F.col("v").cast("double") * 10000 / F.col("total").cast("double"), 6).cast("decimal(28,6)")
    sums = rows.groupBy(group, gene).agg(F.sum("v").alias("s"), F.sum(rate).alias("r"), F.count_if(F.col("v") > 0).alias("nz"))
    out = sums.join(n_cells, group)
    return out.select(
        group, gene, "n_cells", F.round(F.col("s").cast("double") / F.col("n_cells"), 6).alias("mean"), F.round(F.col("r").cast("double") / F.col("n_cells"), 4).alias("per_10k"), F.round(F.col("nz") / F.col("n_cells"), 6).alias("nonzero")
    )


def sum_layers(a: DataFrame, b: DataFrame, gene: str, cell: str, value: str) -> DataFrame:
    both = a.select(gene, cell, value).unionByName(b.select(gene, cell, value))
    return both.groupBy(gene, cell).agg(F.sum(money(value)).cast("double").alias(value))


def tally(df: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Counts per key folding case: first spelling kept, largest first, ties by first
    appearance (``place`` from 1)."""
    folded = df.where(F.col(column).isNotNull()).groupBy(key, F.lower(F.trim(column)).alias("_f"))
    counts = folded.agg(F.count("*").alias("n"), F.min_by(column, order).alias("value"), F.min(order).alias("_o"))
    place = Window.partitionBy(key).orderBy(F.desc("n"), "_o")
    return counts.select(key, "value", "n", F.row_number().over(place).alias("place"))


def study_card(samples: DataFrame, key: str, sample: str, attrs: Sequence[str]) -> DataFrame:
    """``key, attr, value, n, axis``: tallies per attribute with a "not stated" group;
    an attribute is an axis when its study has at least two stated groups. One pass:
    attributes are unpivoted and grouped together."""
    long = samples.select(key, sample, *(F.col(a).cast("string").alias(a) for a in attrs)).unpivot([key, sample], list(attrs), "attr", "value")
    counts = long.groupBy(key, "attr", F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.lit("not stated")).alias("value")).agg(F.countDistinct(sample).alias("n"))
    stated = F.sum(F.when(F.col("value") != "not stated", 1).otherwise(0)).over(Window.partitionBy(key, "attr"))
    return counts.withColumn("axis", stated >= 2)


def span_in_common_unit(facts: DataFrame, key: str, number: str, unit: str, factors: Mapping[str, float]) -> DataFrame:
    """Smallest and largest number in the unit that most rows of the key use; other units
    are converted by their factor to a base unit."""
    main = majority(facts, key, unit, "common_unit")
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    rows = facts.join(main, key)
    value = F.col(number) * F.element_at(table, F.col(unit)) / F.element_at(table, F.col("common_unit"))
    return rows.groupBy(key, "common_unit").agg(F.round(F.min(value), 4).alias("low"), F.round(F.max(value), 4).alias("high"))


def conditions(pairs: DataFrame, study: str, sample: str, key: str, value: str, low: int = 2, high: int = 12) -> DataFrame:
    """``study, key, value, n``: keys that split a study into a few groups and are not
    identifiers (fewer groups than samples)."""
    counts = pairs.groupBy(study, key, value).agg(F.countDistinct(sample).alias("n"))
    stats = counts.groupBy(study, key).agg(F.count("*").alias("groups"), F.max("n").alias("largest"))
    good = stats.where(F.col("groups").between(low, high) & (F.col("largest") > 1)).select(study, key)
    return counts.join(good, [study, key], "left_semi")


def completeness(samples: DataFrame, study: str, status: str, reason: str, reasons: Mapping[str, str]) -> DataFrame:
    """Per study: processed, queued, failed, failures by plain reason, overall state."""
    table = F.create_map(*[F.lit(x) for pair in reasons.items() for x in pair])
    rows = samples.withColumn("_r", F.when(F.col(status) == "failed", F.coalesce(F.element_at(table, F.col(reason)), F.lit("other"))))
    names = sorted({*reasons.values(), "other"})
    counts = rows.groupBy(study).agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col(status) == s).alias(s) for s in ("processed", "queued", "failed")),
        *(F.count_if(F.col("_r") == n).alias(f"failed_{n}") for n in names),
    )
    state = F.when(F.col("processed") == F.col("total"), "complete").when(F.col("queued") > 0, "in progress").when(F.col("processed") > 0, "partial").otherwise("none")
    return counts.withColumn("state", state)


def layer_stats(files: DataFrame, study: str, name: str, layers: Mapping[str, str], human: Column) -> DataFrame:
    """``layer, n_studies, n_human``: studies that hold a file of each layer."""
    aggs = []
    for layer, text in layers.items():
        hit = F.col(name).contains(text)
        aggs += [F.countDistinct(F.when(hit, F.col(study))).alias(f"{layer}_all"), F.countDistinct(F.when(hit & human, F.col(study))).alias(f"{layer}_human")]
    one = files.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(x).alias("layer"), F.col(f"{x}_all").alias("n_studies"), F.col(f"{x}_human").alias("n_human")) for x in layers))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def coverage(df: DataFrame, fields: Sequence[str], weight: str) -> DataFrame:
    """``field, known, known_weight, share, weight_share``: one pass over the rows."""
    aggs = [F.count("*").alias("_n"), F.sum(F.col(weight).cast("long")).alias("_w")]
    for f in fields:
        aggs += [F.count(f).alias(f"{f}_n"), F.sum(F.when(F.col(f).isNotNull(), F.col(weight).cast("long")).otherwise(0)).alias(f"{f}_w")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_n").alias("known"), F.col(f"{f}_w").alias("known_weight")) for f in fields))
    flat = one.select("_n", "_w", F.explode(rows).alias("r")).select("_n", "_w", "r.*")
    return flat.select("field", "known", "known_weight", F.round(F.try_divide("known", "_n"), 4).alias("share"), F.round(F.try_divide("known_weight", "_w"), 4).alias("weight_share"))


def unseen_by_filter(df: DataFrame, fields: Sequence[str], weight: str) -> DataFrame:
    """``field, unseen, unseen_weight``: what a filter on the field cannot see."""
    one = df.agg(*(x for f in fields for x in (F.count_if(F.col(f).isNull()).alias(f"{f}_n"), F.sum(F.when(F.col(f).isNull(), F.col(weight).cast("long")).otherwise(0)).alias(f"{f}_w"))))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_n").alias("unseen"), F.col(f"{f}_w").alias("unseen_weight")) for f in fields))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def compare(df: DataFrame, key: str, ids: Sequence, fields: Sequence[str]) -> DataFrame:
    """2 to 8 entities side by side, only fields that differ: ``field`` and one column
    per id."""
    if not 2 <= len(ids) <= 8:
        raise ValueError("two to eight entities")
    long = df.where(F.col(key).isin(list(ids))).select(F.col(key).cast("string").alias("_id"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields))
    long = long.unpivot(["_id"], list(fields), "field", "value")
    wide = long.groupBy("field").pivot("_id", [str(i) for i in ids]).agg(F.max("value"))
    differs = F.size(F.array_distinct(F.array(*(F.coalesce(F.col(f"`{i}`"), F.lit("")) for i in ids)))) > 1
    return wide.where(differs)


def qc_medians(df: DataFrame, key: str, metrics: Sequence[str], floor: tuple[str, float], exact: bool = True) -> DataFrame:
    """Medians per key, and the rows under a floor. Exact medians of a hot key are selected
    by rank over ranges; ``exact=False`` takes sketches of fixed size, without a look at sizes."""
    under = F.count_if(F.col(floor[0]) < floor[1]).alias("n_under")
    if exact:
        return quantiles(df, key, {f"median_{m}": (m, 0.5) for m in metrics}, [under])
    return df.groupBy(key).agg(*(F.approx_percentile(m, F.lit(0.5)).alias(f"median_{m}") for m in metrics), under)


def status_rollup(metrics: DataFrame, capabilities: DataFrame, capability: str, passed: Column, gating: Column, measured: Column) -> DataFrame:
    """``capability, state``: fail if a gating metric fails, incomplete if one is not
    measured, pass if all pass, missing without gating metrics."""
    counts = metrics.where(gating).groupBy(capability).agg(F.count("*").alias("n"), F.count_if(yes(measured & ~passed)).alias("bad"), F.count_if(~yes(measured)).alias("open"))
    rows = capabilities.select(capability).distinct().join(counts, capability, "left")
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("bad") > 0, "fail").when(F.col("open") > 0, "incomplete").otherwise("pass")
    return rows.select(capability, state.alias("state"))


def dedupe_terms(facts: DataFrame, value: str, sample: str) -> DataFrame:
    return facts.groupBy(value).agg(F.countDistinct(sample).alias("n_samples"))


def matrix_bytes(entries: DataFrame, key: str, files: str, names: Sequence[str], least: int) -> DataFrame:
    """Bytes of the named files per sample (``files``: array of name, bytes), and whether
    they reach a floor."""
    rows = entries.select(key, F.explode_outer(files).alias("f"))
    sums = rows.groupBy(key).agg(F.sum(F.when(F.col("f.name").isin(list(names)), F.col("f.bytes")).otherwise(0)).alias("bytes"))
    return sums.withColumn("usable", F.col("bytes") >= least)


def pareto(df: DataFrame, key: str, quality: str, cost: str) -> DataFrame:
    """Points that no other beats on quality and cost; exact ties stay.

    Only the best quality of each cost can stay, so rows are reduced to one per cost;
    the best so far runs over ranges of costs.
    """
    best = df.groupBy(cost).agg(F.max(quality).alias("_q"))
    running = ordered(best, [F.col(cost)], None, [("_q", "max", "_b")])
    # the first cost that reaches a quality; costs that only equal it are beaten
    front = running.where("_q = _b").groupBy("_q").agg(F.min(cost).alias(cost))
    return df.join(front, cost).where(F.col(quality) == F.col("_q")).select(key, quality, cost)


def study_detail(study: DataFrame, samples: DataFrame, qc: DataFrame, key: str, sample: str) -> DataFrame:
    """One row per study: samples by tier, unusable ids and all sample ids, joined. A
    study's ids are one cell by definition, so they must fit in one row."""
    rows = samples.join(qc.select(sample, "tier"), sample, "left")
    counts = rows.groupBy(key).agg(
        F.count_if(F.col("tier") == 0).alias("n_pass"),
        F.count_if(F.col("tier") == 1).alias("n_low"),
        F.count_if(F.col("tier") == 2).alias("n_removed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("tier") == 2, F.col(sample)))).cast("array<string>"), "|").alias("unusable"),
        F.array_join(F.array_sort(F.collect_list(sample)).cast("array<string>"), "|").alias("samples"),
    )
    return study.join(counts, key, "left")
