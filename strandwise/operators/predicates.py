"""Filters and predicates (section B): columns in, columns or filtered rows out.

Unknown values never match an include and never block an exclude. Conditions on a plain
column have a form that reaches the scan, negated or not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.columns import all_of, any_of, col, known, known_equal, one_of, yes


def leaf(spec: Mapping[str, Any]) -> Column:
    """One leaf: ``{"field": f, "values": [...]}``, ``{"field": f, "min": a, "max": b}``
    or ``{"field": f, "is": True}``."""
    c = F.col(spec["field"])
    if "values" in spec:
        return one_of(c, spec["values"])
    if "is" in spec:
        return known_equal(c, spec["is"])
    return in_range(c, spec.get("min"), spec.get("max"))


def tree(spec: Mapping[str, Any]) -> Column:
    """Condition of a nested ``{"and": [...]}``, ``{"or": [...]}``, ``{"not": x}`` spec.

    NOT is the complement of the set, so rows unknown on a field match it. A flat dict
    of ``field: values`` (or ``not_field: values``) is an AND of leaves.
    """
    if "and" in spec:
        return all_of([tree(s) for s in spec["and"]])
    if "or" in spec:
        return any_of([tree(s) for s in spec["or"]])
    if "not" in spec:
        return ~tree(spec["not"])
    if "field" in spec:
        return leaf(spec)
    parts = []
    for field, values in spec.items():
        values = list(values) if isinstance(values, (list, tuple, set)) else [values]
        if field.startswith("not_"):
            parts.append(~one_of(F.col(field[4:]), values))
        else:
            parts.append(one_of(F.col(field), values))
    return all_of(parts)


def filter_tree(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    return df.where(tree(spec))


def match_any(c: str | Column, values: Sequence) -> Column:
    return yes(F.arrays_overlap(col(c), F.array(*map(F.lit, values))))


def match_all(c: str | Column, values: Sequence) -> Column:
    wanted = sorted(set(values))
    return yes(F.size(F.array_intersect(col(c), F.array(*map(F.lit, wanted)))) == len(wanted))


def in_range(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive, either end may be open; NULL never matches."""
    parts = [col(c).isNotNull()]
    if low is not None:
        parts.append(col(c) >= low)
    if high is not None:
        parts.append(col(c) <= high)
    return all_of(parts)  # known, as null fails the first part


def bin_number(c: str | Column, edges: Sequence[float]) -> Column:
    """Number of the half-open bin from 0; the last is open; below the first edge NULL."""
    out = F.lit(None).cast("int")
    for i, edge in enumerate(edges):
        out = F.when(col(c) >= edge, F.lit(i)).otherwise(out)
    return out


def bin_label(c: str | Column, edges: Sequence[float]) -> Column:
    names = [f"{a}-{b}" for a, b in zip(edges, edges[1:])] + [f"{edges[-1]}+"]
    number = bin_number(c, edges)
    return F.when(number.isNotNull(), F.element_at(F.array(*map(F.lit, names)), number + 1))


def binned_range(df: DataFrame, c: str, edges: Sequence[float], low: float, high: float) -> DataFrame:
    """Rows in the bins that [low, high] touches, with the bounds really covered
    (``covered_to`` is NULL where the last, open bin takes part)."""
    first = max((i for i, e in enumerate(edges) if e <= low), default=0)
    last = max((i for i, e in enumerate(edges) if e <= high), default=-1)
    upper = edges[last + 1] if last + 1 < len(edges) else None
    inside = in_range(c, edges[first]) if first <= last else F.lit(False)
    if upper is not None:
        inside = inside & (F.col(c) < upper)
    return df.where(inside).select("*", F.lit(edges[first]).alias("covered_from"), F.lit(upper).alias("covered_to"))


def flags_any(c: str | Column, wanted: Sequence[str], bits: Mapping[str, int]) -> Column:
    """Any wanted bit of a flag set; ``unknown`` matches rows without a bit."""
    mask = sum(bits[w] for w in wanted if w != "unknown")
    hit = col(c).bitwiseAND(F.lit(mask)) != 0
    return yes(hit | (F.coalesce(col(c), F.lit(0)) == 0)) if "unknown" in wanted else yes(hit)


_COMPARE = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def clause(field: str, op: str, value: Any) -> Column:
    """A numeric or text comparison; text ignores case."""
    c = F.col(field)
    if op == "in":
        return yes(F.lower(c).isin([str(v).lower() for v in value]))
    if op == "not_in":
        return ~yes(F.lower(c).isin([str(v).lower() for v in value]))
    if op == "contains":
        return yes(F.lower(c).contains(str(value).lower()))
    if isinstance(value, str):
        same = yes(F.lower(c) == value.lower())
        return same if op == "==" else ~same
    return known(c, _COMPARE[op](c, value))


def row_filter(
    df: DataFrame,
    totals: tuple[str, str],
    features: tuple[str, str],
    min_total: float | None = None,
    max_total: float | None = None,
    min_features: float | None = None,
    where: Sequence[tuple[str, str, Any]] = (),
) -> DataFrame:
    """Rows whose sum of two columns and maximum of two others are in range, and which
    meet up to six more clauses."""
    if len(where) > 6:
        raise ValueError("at most six clauses")
    total = F.coalesce(F.col(totals[0]), F.lit(0)) + F.coalesce(F.col(totals[1]), F.lit(0))
    most = F.greatest(F.col(features[0]), F.col(features[1]))
    parts = [in_range(total, min_total, max_total)] if min_total is not None or max_total is not None else []
    if min_features is not None:
        parts.append(in_range(most, min_features))
    return df.where(all_of(parts + [clause(*w) for w in where]))


def source_tier(source: Column, confidence: Column, cut: float = 0.8) -> Column:
    """Tier of a fact: catalogued, derived by the pipeline, or predicted in two bands."""
    return (
        F.when(source == "geo", F.lit("geo"))
        .when(source == "pipeline", F.lit("pipeline"))
        .when((source == "model") & (confidence >= cut), F.lit("model_high"))
        .when(source == "model", F.lit("model_low"))
    )


def source_gate(facts: DataFrame, sources: Sequence[str], source: str = "source", confidence: str = "confidence") -> DataFrame:
    """Facts of the allowed sources; ``model>=x`` asks for predictions from confidence x."""
    parts = []
    for s in sources:
        if s.startswith("model>="):
            parts.append((F.col(source) == "model") & (F.col(confidence) >= float(s[7:])))
        else:
            parts.append(F.col(source) == s)
    return facts.where(any_of(parts))


def downloadable(has_file: Column, n_done: Column, mismatch: Column, withheld: Column, least: int = 1) -> Column:
    return yes(has_file) & (F.coalesce(n_done, F.lit(0)) >= least) & ~yes(mismatch) & ~yes(withheld)


def text_accessions(df: DataFrame, key: str, text: str, prefixes: Sequence[str], digits: int = 1) -> DataFrame:
    """Distinct identifiers (prefix and digits, a word of their own, in either case) that
    a text mentions: ``key, accession`` in capitals."""
    pattern = f"(?i)(?<![A-Za-z0-9_])((?:{'|'.join(prefixes)})[0-9]{{{digits},}})(?![A-Za-z0-9_])"
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1))
    return df.select(key, F.explode(F.array_distinct(F.transform(found, F.upper))).alias("accession")).distinct()


def min_weight(df: DataFrame, c: str, least: float) -> DataFrame:
    return df.where(F.col(c) >= least)


def quantised(c: str | Column, scale: float) -> Column:
    """Value at 8-bit resolution: 0..254, NULL where missing."""
    return F.when(col(c).isNotNull(), F.floor(F.least(F.greatest(col(c) / scale, F.lit(0.0)), F.lit(1.0)) * 254 + 0.5))


def quantised_range(c: str | Column, low: float, high: float, scale: float) -> Column:
    """Range at the stored resolution: ends are quantised like the values."""
    first, last = (int(min(max(x / scale, 0.0), 1.0) * 254 + 0.5) for x in (low, high))
    # a step more at either end, in plain values, for the scan
    near = in_range(c, (first - 1) / 254 * scale if first > 0 else None, (last + 1) / 254 * scale if last < 254 else None)
    return near & quantised(c, scale).between(first, last)


def like_bucket(c: str | Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """First bucket whose LIKE pattern matches."""
    out = None
    for pattern, bucket in rules:
        out = F.when(col(c).like(pattern), F.lit(bucket)) if out is None else out.when(col(c).like(pattern), F.lit(bucket))
    return out.otherwise(F.lit(other))


def closed_vocab(c: str | Column, allowed: Sequence[str]) -> Column:
    return F.when(col(c).isin(list(allowed)), col(c))


def search_filters(groups: DataFrame, members: DataFrame, key: str, spec: Mapping[str, Any]) -> DataFrame:
    """Groups (with array columns) that meet a whole search spec.

    ``any``: {array column: values}; ``ranges``: {column: (low, high)}; ``equals``;
    ``member``: a tree that at least ``member_least`` rows of the group meet.
    """
    conditions = [match_any(c, v) for c, v in spec.get("any", {}).items()]
    conditions += [in_range(c, *v) for c, v in spec.get("ranges", {}).items()]
    conditions += [known_equal(F.col(c), v) for c, v in spec.get("equals", {}).items()]
    out = groups.where(all_of(conditions))
    if "member" in spec:
        hit = members.where(tree(spec["member"])).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= spec.get("member_least", 1))
        out = out.join(hit.select(key), key, "left_semi")
    return out


def sample_filters(samples: DataFrame, bad: DataFrame, key: str, spec: Mapping[str, Any], statuses: Sequence[str], with_low: bool = False) -> DataFrame:
    """Samples that meet a tree; quality tier 2 is never listed, tier 1 only on request,
    statuses are the approved ones unless the spec names others. ``bad``: key, tier."""
    hidden = bad.where(F.col("tier") >= (2 if with_low else 1)).select(key)
    allowed = one_of(F.col("status"), spec.get("statuses", statuses))
    return samples.where(allowed).where(tree(spec.get("where", {}))).join(hidden, key, "left_anti")


def list_filter(df: DataFrame, equals: Mapping[str, Any], bounds: Mapping[str, tuple], sort: str, allowed: Sequence[str], ties: Sequence[str], default: str) -> DataFrame:
    """Equality filters and bounds, ordered by a validated column, largest first."""
    by = sort if sort in allowed else default
    conditions = [known_equal(F.col(c), v) for c, v in equals.items()] + [in_range(c, *v) for c, v in bounds.items()]
    return df.where(all_of(conditions)).orderBy(F.col(by).desc_nulls_last(), *ties)
