"""Joins (section C). No side is broadcast by hint: Spark broadcasts what its own size
check allows and shuffles otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.ordered import ordered
from strandwise.functions.staging import stage

from strandwise.functions.columns import yes


def weighted_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Facts with the attributes of their served sample; other facts go."""
    return fact.join(dim, F.col(fact_key) == F.col(dim_key))


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def served(df: DataFrame, excluded: DataFrame, withheld: DataFrame, key: str, group: str) -> DataFrame:
    """Without excluded rows and without rows of withheld groups."""
    return df.join(excluded.select(key), key, "left_anti").join(withheld.select(group), group, "left_anti")


def descendant_join(facts: DataFrame, closure: DataFrame, term: str, wanted: Sequence[str], exact: bool = False) -> DataFrame:
    """Facts whose term is a wanted one or, unless ``exact``, below one.
    ``closure``: term, ancestor (self included)."""
    if exact:
        return facts.where(F.col(term).isin(list(wanted)))
    below = closure.where(F.col("ancestor").isin(list(wanted))).select(F.col("term").alias(term)).distinct()
    return facts.join(below, term, "left_semi")


def singulars(value: Column) -> Column:
    """The value and its plain English singular forms."""
    return F.array_distinct(
        F.filter(
            F.array(
                value,
                F.when(value.endswith("ies"), F.regexp_replace(value, "ies$", "y")),
                F.when(value.endswith("es"), F.regexp_replace(value, "es$", "")),
                F.when(value.endswith("s") & ~value.endswith("ss"), F.regexp_replace(value, "s$", "")),
            ),
            lambda x: x.isNotNull(),
        )
    )


def resolve_labels(values: DataFrame, labels: DataFrame, value: str = "value") -> DataFrame:
    """``value, term_id, tier`` by the best tier that knows the value: id, alias, label,
    synonym; then the same for singular forms. ``labels``: name, term_id, tier (0..3)."""
    asked = values.select(value).distinct().select(value, F.posexplode(singulars(F.lower(F.trim(F.col(value))))).alias("form", "name"))
    known = labels.select(F.lower("name").alias("name"), "term_id", "tier")
    found = asked.join(known, "name").withColumn("rank", F.struct((F.col("form") > 0).cast("int").alias("late"), "tier", "form", "term_id"))
    best = found.groupBy(value).agg(F.min("rank").alias("rank"))
    return values.select(value).distinct().join(best, value, "left").select(value, F.col("rank.term_id").alias("term_id"), F.col("rank.tier").alias("tier"))


def unique_tier_lookup(values: DataFrame, labels: DataFrame, value: str = "value") -> DataFrame:
    """``value, term_id, tier``: the only term at the best tier; several stay unmapped."""
    hits = values.select(value).distinct().join(labels.withColumnRenamed("name", value), value).select(value, "term_id", "tier").distinct()
    at = Window.partitionBy(value)
    best = hits.withColumn("best", F.min("tier").over(at)).where("tier = best")
    one = best.groupBy(value, "tier").agg(F.count("*").alias("n"), F.min("term_id").alias("term_id")).where("n = 1")
    return one.select(value, "term_id", "tier")


def narrowest_interval(points: DataFrame, intervals: DataFrame, key: str, point: str) -> DataFrame:
    """Each point with the narrowest interval [low, high) that holds it (``high`` NULL is
    open); ties go to the smaller id. Any number of points and of overlapping intervals.

    The intervals' ends cut the axis into pieces, numbered in order. An interval covers a
    run of pieces, which is the union of at most two aligned runs of each power-of-two
    length; each aligned run keeps its narrowest interval only, so a piece finds its best
    one among the few aligned runs that hold it, by equal keys. Points find the last piece
    that starts at or before them by a running maximum over the joint order; only pieces
    that hold points are looked up.
    """
    ends = intervals.select(F.col("low").cast("double").alias("x")).union(intervals.select(F.col("high").cast("double").alias("x"))).where("x is not null").distinct()
    places = stage(ordered(ends, [F.col("x")], "r").withColumn("r", F.col("r").cast("long") - 1), "pieces")
    n = places.count()
    levels = F.sequence(F.lit(0), F.lit(max(1, n).bit_length()))
    at = lambda c, name: places.select(F.col("x").alias(c), F.col("r").alias(name))
    spans = intervals.select("id", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    spans = spans.join(at("low", "a"), "low").join(at("high", "b"), "high", "left").withColumn("b", F.when(F.col("high").isNull(), F.lit(n)).otherwise(F.col("b"))).where("a < b")
    width = F.coalesce(F.col("high") - F.col("low"), F.lit(float("inf")))

    def cover(s: Column, level: Column) -> Column:
        """The aligned runs at both ends of what is still uncovered, then half of it."""
        odd_a, odd_b, some = s["a"] % 2 == 1, s["b"] % 2 == 1, s["a"] < s["b"]
        run = lambda i: F.array(F.struct(level.alias("level"), i.alias("i")))
        none = F.array().cast("array<struct<level:int,i:bigint>>")
        runs = F.concat(s["runs"], F.when(some & odd_a, run(s["a"])).otherwise(none), F.when(some & odd_b & (s["b"] - 1 >= s["a"] + odd_a.cast("int")), run(s["b"] - 1)).otherwise(none))
        up = F.shiftright(s["a"] + odd_a.cast("int"), 1)
        return F.struct(up.alias("a"), F.greatest(F.shiftright(s["b"], 1), up).alias("b"), runs.alias("runs"))

    begin = F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.array().cast("array<struct<level:int,i:bigint>>").alias("runs"))
    runs = spans.select("id", width.alias("w"), F.explode(F.aggregate(levels, begin, cover)["runs"]).alias("run")).select("id", "w", "run.*")
    best = runs.groupBy("level", "i").agg(F.min(F.struct("w", "id")).alias("best"))

    joint = points.select(F.col(key), F.col(point), F.col(point).cast("double").alias("_at"), F.lit(1).alias("_point"), F.lit(None).cast("long").alias("_piece"))
    kinds = {f.name: f.dataType for f in joint.schema.fields}
    joint = joint.unionByName(places.select(F.lit(None).cast(kinds[key]).alias(key), F.lit(None).cast(kinds[point]).alias(point), F.col("x").alias("_at"), F.lit(0).alias("_point"), F.col("r").alias("_piece")))
    found = stage(ordered(joint, [F.col("_at").asc_nulls_first(), F.col("_point"), F.col(key)], None, [("_piece", "max", "_last")]).where("_point = 1").select(key, point, "_last"), "found")
    # of the pieces, only those that hold points are looked up
    held = found.select(F.col("_last").alias("r")).where("r is not null").distinct()
    holding = held.select("r", F.explode(levels).alias("level")).select("r", "level", F.expr("shiftright(r, level)").alias("i"))
    pieces = holding.join(best, ["level", "i"], "left").groupBy("r").agg(F.min("best").alias("best")).select("r", F.col("best.id").alias("interval_id"))
    return found.join(pieces, F.col("_last") == F.col("r"), "left").select(key, point, "interval_id")


def first_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]], column: str, out: str) -> DataFrame:
    """First rule that matches, in order: (``exact`` or ``contains``, text, result).

    Rules are data of the program, so they become one ``when`` chain and no join.
    """
    c = F.lower(F.trim(F.col(column)))
    chain = None
    for kind, text, result in rules:
        hit = c == text.lower() if kind == "exact" else c.contains(text.lower())
        chain = F.when(hit, F.lit(result)) if chain is None else chain.when(hit, F.lit(result))
    return df.withColumn(out, chain if chain is not None else F.lit(None).cast("string"))


def fallback_join(df: DataFrame, facts: DataFrame, key: str, column: str) -> DataFrame:
    """Own value where it is not blank, else the most confident fact (``key, value,
    confidence``; ties to the smaller value)."""
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), "value")
    best = facts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, F.col("value").alias("_v"))
    return df.join(best, key, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("_v"))).drop("_v")


def related(df: DataFrame, key: str, wanted, tiers: Sequence[tuple[str, Column]], size: str, most: int = 8) -> DataFrame:
    """Rows that share a tier's key with one row: earlier tiers first, then larger rows;
    no repeats; NULL keys (placeholders) never match."""
    out = None
    for rank, (_, value) in enumerate(tiers):
        rows = df.select(F.col(key), F.col(size), value.alias("_k")).where("_k is not null")
        own = rows.where(F.col(key) == wanted).select("_k")
        hit = rows.where(F.col(key) != wanted).join(own, "_k", "left_semi").select(key, size, F.lit(rank).alias("tier"))
        out = hit if out is None else out.unionByName(hit)
    best = out.groupBy(key, size).agg(F.min("tier").alias("tier"))
    return best.orderBy("tier", F.desc(size), key).limit(most)


def matched_controls(df: DataFrame, key: str, wanted, same: Sequence[str], labels: str, neutral: Sequence[str], points: Sequence[tuple[str, int]], most: int = 10) -> DataFrame:
    """Rows with the same ``same`` columns whose labels are all neutral, scored by the
    further columns they share."""
    one = df.where(F.col(key) == wanted).select(*[F.col(c).alias(f"_{c}") for c in [*same, *[p for p, _ in points]]])
    keys = [F.col(c) == F.col(f"_{c}") for c in same]
    score = sum((F.when(yes(F.col(c) == F.col(f"_{c}")), n).otherwise(0) for c, n in points), F.lit(0))
    rows = df.where(F.col(key) != wanted).where(F.forall(labels, lambda x: x.isin(list(neutral))))
    return rows.join(one, keys).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(most)


def ratio_mismatch(a: DataFrame, b: DataFrame, key: str, left: str, right: str, factor: float) -> DataFrame:
    """Rows of both sides whose values differ by more than a factor."""
    both = a.select(key, left).join(b.select(key, right), key)
    return both.where((F.col(left) > factor * F.col(right)) | (F.col(right) > factor * F.col(left)))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """``side, key``: child keys without a parent, and parents without children."""
    kids = child.select(F.col(child_key).alias("key")).distinct()
    folks = parent.select(F.col(parent_key).alias("key")).distinct()
    lone = kids.join(folks, "key", "left_anti").select(F.lit("child").alias("side"), "key")
    return lone.unionByName(folks.join(kids, "key", "left_anti").select(F.lit("parent").alias("side"), "key"))


def gene_space_map(a: DataFrame, b: DataFrame, key: str, position: str, least: float = 0.5) -> DataFrame:
    """Position in ``b`` of each key of ``a``; no rows when under ``least`` is shared."""
    both = a.select(key, F.col(position).alias("from_position")).join(b.select(key, F.col(position).alias("to_position")), key, "left")
    share = both.agg((F.count("to_position") / F.count("*")).alias("share"))
    return both.join(share, F.col("share") >= least).drop("share")


def match_names(wanted: DataFrame, table: DataFrame, name: str, id_: str, symbol: str) -> DataFrame:
    """``name, match, tier``: exact id, exact symbol, id ignoring case, symbol ignoring
    case; NULL where nothing matches. Ties go to the smaller id."""
    tiers = [(F.col(id_), F.col(name)), (F.col(symbol), F.col(name)), (F.lower(id_), F.lower(name)), (F.lower(symbol), F.lower(name))]
    asked = wanted.select(name).distinct()
    hits = None
    for tier, (known, ask) in enumerate(tiers):
        side = table.select(known.alias("_k"), F.col(id_).alias("_id")).groupBy("_k").agg(F.min("_id").alias("_id"))
        hit = asked.withColumn("_k", ask).join(side, "_k").select(name, F.lit(tier).alias("tier"), F.col("_id").alias("match"))
        hits = hit if hits is None else hits.unionByName(hit)
    best = hits.groupBy(name).agg(F.min(F.struct("tier", "match")).alias("b"))
    return asked.join(best, name, "left").select(name, F.col("b.match").alias("match"), F.col("b.tier").alias("tier"))


def override_labels(fact: DataFrame, lines: DataFrame, key: str, label: str) -> DataFrame:
    """Listed samples take their own label in place of the called one."""
    own = lines.select(key, F.col("label").alias("_own"))
    return fact.join(own, key, "left").withColumn(label, F.coalesce("_own", label)).drop("_own")


def override_closure(closure: DataFrame, lines: DataFrame, parent: str) -> DataFrame:
    """The closure with the lines' labels below ``parent``."""
    names = lines.select(F.col("label").alias("term")).distinct()
    new = names.select("term", F.explode(F.array(F.col("term"), F.lit(parent))).alias("ancestor"))
    return closure.select("term", "ancestor").unionByName(new).distinct()
