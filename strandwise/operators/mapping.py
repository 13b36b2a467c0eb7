"""Values to ontology terms, also through rewritten forms of them (K10).

A value's forms are made once per distinct (attribute, value): leading and trailing words
are taken off until nothing changes, three times at most; the value and what is left are
then put in the singular and, for cell types, freed of markers and of where in the blood
they were. All forms are looked up in one join; per value the first form decides that has
a curated alias or one term alone at its best tier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import lexicons as L
from strandwise.operators.facts import norm_label

CELL_TYPE = "cell_type_sorted"
STRIPS = 3


def _squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def stripped(name: Column) -> Column:
    """Without one leading word of a list, and one trailing."""
    lead = F.regexp_replace(name, rf"^(?:{'|'.join(L.LEADING_WORDS)})\s+", "")
    return _squeezed(F.regexp_replace(lead, rf"\s+(?:{'|'.join(L.TRAILING_WORDS)})$", ""))


def _edits(w: Column) -> tuple[list[Column], list[Column]]:
    """Forms of a name of any kind, and further ones of a cell type."""
    replaced = lambda rules: [F.regexp_replace(w, a, b) for a, b in rules]
    nothing = F.lit("")
    drop, alpha, positive = replaced(L.CELL_FORMS)
    unblood = F.regexp_replace(w, rf"^(?:{'|'.join(L.BLOOD_WORDS)})\s+([a-z])", "$1")
    single = reduce(lambda x, rule: F.regexp_replace(x, *rule), L.PLURALS[:2], unblood)
    unmarked = F.regexp_replace(w, rf"^(?:(?:{'|'.join(L.CELL_MARKERS)})\s+(?:(?:{'|'.join(L.MARKER_LEVELS)})\s+)?)+", "")
    a_type = (unmarked != w) & unmarked.rlike(r"^[a-z]{3,}|^[a-z] cells?$")
    cells = [
        drop, F.when(~w.rlike(r"\bcells?$"), F.concat(w, F.lit(" cell"))).otherwise(nothing), alpha, positive,
        F.when(unblood != w, unblood).otherwise(nothing), F.when(unblood != w, single).otherwise(nothing),
        F.when(a_type, unmarked).otherwise(nothing), F.when(a_type, F.regexp_replace(unmarked, *L.PLURALS[0])).otherwise(nothing),
    ]
    return replaced(L.PLURALS), cells


def name_forms(values: DataFrame, attr: str = "attr", value: str = "value") -> DataFrame:
    """``attr, value, base, form`` (0: the normalised value itself) ``, name``, in the order
    in which forms are tried."""
    rows = values.select(attr, value).distinct().withColumn("base", norm_label(F.col(value))).where("base <> ''")
    for i in range(STRIPS):
        rows = rows.withColumn(f"_s{i}", stripped(F.col(f"_s{i - 1}") if i else F.col("base")))
    last = f"_s{STRIPS - 1}"
    plain, cells = F.array(), F.array()
    made = [F.col("base"), *(F.col(f"_s{i}") for i in range(STRIPS))]
    for w in ("base", last):
        plain, cells = _edits(F.col(w))
        made += [*plain, *(F.when(F.col(attr) == CELL_TYPE, c).otherwise(F.lit("")) for c in cells)]
    names = F.filter(F.array_distinct(F.transform(F.array(*made), _squeezed)), lambda x: x != "")
    return rows.select(attr, value, "base", F.posexplode(names).alias("form", "name"))


def map_values(values: DataFrame, labels: DataFrame, aliases: DataFrame, general: list[str] = (), attr: str = "attr", value: str = "value") -> DataFrame:
    """``attr, value, term_id, method, confidence, name`` of every distinct value.

    ``labels``: ``name`` (normalised), ``term_id``, ``tier`` (0 label, 1 exact synonym, 2
    other synonym). ``aliases``: ``attr, name, term_id, confidence``, chosen by hand, tried
    before labels. A name that several terms share at its best tier names none; the value
    itself being so, or too general, or a short loose synonym, stays unmapped, whatever its
    other forms give. A null attribute or value maps to nothing. An id written in a value (``CL:0000084``) wins, where it is known.
    """
    asked = values.select(attr, value).distinct()
    forms = name_forms(asked, attr, value)
    best = labels.groupBy("name").agg(F.min("tier").alias("tier"))
    one = labels.join(best, ["name", "tier"]).groupBy("name", "tier").agg(F.min("term_id").alias("label_id"), F.countDistinct("term_id").alias("terms"))
    chosen = aliases.groupBy(F.col("attr").alias(attr), "name").agg(F.min(F.struct("term_id", "confidence")).alias("alias"))
    rows = forms.join(one, "name", "left").join(chosen, [attr, "name"], "left")

    first, tier, alone = F.col("form") == 0, F.col("tier"), F.col("terms") == 1
    of_tier = lambda i: reduce(lambda out, t: F.when(tier == t[0], t[1][i]).otherwise(out), enumerate(L.LABEL_TIERS), F.lit(None))
    usable = alone & ~F.col("label_id").isin(list(general)) if general else alone
    long = F.length(F.regexp_replace("name", " ", "")) >= of_tier(2)
    sure = F.coalesce("alias.confidence", F.lit(0.9))
    organoid = F.col("base").rlike(r"\borganoids?\b")
    result = (
        F.when(F.col("alias").isNotNull(), F.struct("form", F.col("alias.term_id").alias("term_id"), F.lit("curated").alias("method"), F.when(first, sure).otherwise(F.least(sure, F.lit(0.85))).alias("confidence"), "name"))
        .when(first & usable & long, F.struct("form", F.col("label_id").alias("term_id"), of_tier(0).alias("method"), of_tier(1).alias("confidence"), "name"))
        # the value itself is known, but names nothing alone: no form of it is tried
        .when(first & tier.isNotNull(), F.struct("form", F.lit(None).cast("string").alias("term_id"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("confidence"), "name"))
        .when(~first & usable & (tier < 2), F.struct("form", F.col("label_id").alias("term_id"), F.lit("variant").alias("method"), F.when(organoid, 0.7).when(tier == 0, 0.85).otherwise(0.8).alias("confidence"), "name"))
    )
    won = rows.withColumn("r", result).where("r is not null").groupBy(attr, value).agg(F.min("r").alias("r"))

    written = F.regexp_extract(F.col(value), r"\b([A-Za-z]+[:_]\d{5,})\b", 1)
    ids = asked.withColumn("id", F.upper(F.regexp_replace(written, "_", ":"))).where("id <> ''")
    ids = ids.join(labels.select(F.col("term_id").alias("known")).distinct(), F.col("id") == F.upper("known")).select(attr, value, "known")
    out = asked.join(won, [attr, value], "left").join(ids, [attr, value], "left")
    by_id = F.col("known").isNotNull()
    return out.select(
        attr, value, F.coalesce("known", "r.term_id").alias("term_id"), F.when(by_id, "id").otherwise(F.col("r.method")).alias("method"),
        F.when(by_id, 0.99).otherwise(F.col("r.confidence")).alias("confidence"), F.when(~by_id & F.col("r.term_id").isNotNull(), F.col("r.name")).alias("name"),
    )
