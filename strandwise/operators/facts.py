"""Text to facts (section K): key/value text to normalised attributes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import lexicons as L
from strandwise.functions.columns import fixed_list, fixed_map, lookup, once, yes
from strandwise.functions.staging import stage

from .joins import singulars, unique_tier_lookup

#: Where nothing bounds a position from above.
_LAST = 2**31 - 1


def norm_key(c: Column) -> Column:
    """Lower case, ``._-`` as spaces, no colon at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[_.-]+", " "), r"\s+", " "), ":$", ""))


def clean(c: Column) -> Column:
    """White space folded, no full stop at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), r"\.$", "")


def parse_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, position, attr, value, evidence`` of ``k: v ;; k: v`` text, else of single
    semicolons before what looks like a key, or of a JSON object."""
    raw = F.trim(F.coalesce(F.col(text), F.lit("")))
    parts = F.when(raw.contains(";;"), F.split(raw, ";;")).otherwise(F.split(raw, r";\s*(?=[A-Za-z][^;:]{0,59}:\s)"))
    listed = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.rlike("^[^:]+:"))
    plain = F.transform(listed, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(p, "^[^:]*:", "")), r"\s+", " ").alias("v"), p.alias("e")))
    entries = F.filter(F.map_entries(F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull())
    object_ = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), F.trim(e["value"]).alias("v"), F.concat(e["key"], F.lit(": "), F.trim(e["value"])).alias("e")))
    pairs = F.when(raw.startswith("{"), object_).otherwise(plain)
    rows = df.select(key, F.posexplode(pairs).alias("position", "p"))
    return rows.select(key, "position", norm_key(F.col("p.k")).alias("attr"), F.col("p.v").alias("value"), F.col("p.e").alias("evidence")).where("attr != ''")


def _by_spelling(table: Mapping[str, Sequence[str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, spellings in table.items():
        for s in spellings:
            out.setdefault(s, name)
    return out


def _of(value: Column, table: Mapping[str, str]) -> Column:
    """A value's entry in a fixed table, else NULL."""
    return F.element_at(fixed_map(table), value)


def unit_from_key(key: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in L.KEY_UNITS.items():
        out = F.when(key.rlike(rf"\b({pattern})\b"), name).otherwise(out)
    return out


def _amount(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _time(norm: Column, num: Column, unit: Column, confidence: Column) -> Column:
    return F.struct(norm.alias("norm"), num.cast("double").alias("num"), unit.cast("string").alias("unit"), confidence.cast("double").alias("confidence"))


def _form(s: Column, form: Mapping, of_key: Column, human: Column) -> Column:
    """What a value of one form says (see ``AGE_FORMS``)."""
    amount = lambda group: _amount(s, form["pattern"], group)
    num = F.lit(0.0)
    for group, over in form["amounts"]:
        num = num + amount(group).cast("double") / over
    units = [F.lit(form.get("unit")).cast("string")]
    if "unit_group" in form:
        units.append(_of(amount(form["unit_group"]), L.UNITS))
    if form.get("unit_of_key"):
        units.append(of_key)
    units.append(F.lit(form.get("unit_else")).cast("string"))
    unit = F.coalesce(*units)
    sure = F.when(unit.isNotNull(), form["sure"])
    if "human" in form:
        told = form["human"]
        assumed = yes(human) & (num <= told["most"])
        sure = sure.when(assumed, told["sure"])
        unit = F.coalesce(unit, F.when(assumed, told["unit"]))
    norm = F.concat(*(amount(int(part)) if part.isdigit() else F.lit(part) for part in re.split(r"[{}]", form["norm"]) if part))
    if "unit" not in form and form["amounts"]:
        # one of a unit is named in the singular: "1 day", "6 days"; a range never is
        single = len(form["amounts"]) == 1
        named = F.when(num == 1, F.regexp_replace(unit, "s$", "")).otherwise(unit) if single else unit
        norm = F.coalesce(F.concat(norm, F.lit(" "), named), norm)
    out = _time(norm, F.round(num, 2) if len(form["amounts"]) > 1 else num, unit, sure.otherwise(form.get("bare")))
    if "rising" in form:
        low, high = (amount(group).cast("double") for group in form["rising"])
        out = F.when(high >= low, out)
    return out


def _first_form(s: Column, forms: Sequence[Mapping], of_key: Column, human: Column) -> Column:
    out = F.when(s.rlike(forms[0]["pattern"]), _form(s, forms[0], of_key, human))
    for form in forms[1:]:
        out = out.when(s.rlike(form["pattern"]), _form(s, form, of_key, human))
    return out


def _trimmed(text: Column, trims: Sequence[tuple[str, str]]) -> Column:
    for pattern, put in trims:
        text = F.trim(F.regexp_replace(text, pattern, put))
    return text


def parse_age(value: Column, key: Column, human: Column) -> Column:
    """Struct of ``norm, num, unit, confidence``: single ages, ranges (midpoint), years
    and months, embryonic (E) and postnatal (P) days; the unit comes from the value or
    the key; a bare number of a human is years. NULL where no age is read."""
    s = F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")
    s = _trimmed(F.when(s.endswith("y.o."), s).otherwise(F.regexp_replace(s, r"\.$", "")), L.AGE_TRIMS)
    return once(s, lambda s: once(unit_from_key(key), lambda of_key: _first_form(s, L.AGE_FORMS, of_key, human)))


def parse_timepoint(value: Column, key: Column) -> Column:
    """Struct of ``norm, num, unit, confidence``: "day 6", "24 hours", "baseline", a bare
    number with the key's unit."""
    return once(F.lower(clean(value)), lambda s: once(unit_from_key(key), lambda of_key: _first_form(s, L.TIMEPOINT_FORMS, of_key, F.lit(False))))


def to_years(num: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, per in L.PER_YEAR.items():
        out = F.when(unit == name, num / per).otherwise(out)
    return out


def life_stage(years: Column) -> Column:
    return F.when(years < 18, "pediatric").when(years >= 65, "aged").when(years.isNotNull(), "adult")


# ---------------------------------------------------------------- closed lexicons


def missing(value: Column) -> Column:
    return F.array_contains(fixed_list(L.MISSING), F.lower(clean(value)))


def _placed(value: Column, norm: Column, kept: Column | None = None) -> Column:
    """Struct of ``norm, placed``; what no list knows keeps its text, or ``kept``."""
    found = once(norm, lambda n: F.struct(F.coalesce(n, clean(value) if kept is None else kept).alias("norm"), n.isNotNull().alias("placed")))
    return F.when(value.isNotNull() & ~missing(value), found)


def norm_sex(value: Column) -> Column:
    """``male``, ``female`` or ``mixed``; other words have no form."""
    return _placed(value, _of(F.lower(clean(value)), _by_spelling(L.SEX)), F.lit(None).cast("string"))


def norm_treatment(value: Column) -> Column:
    """Struct of ``norm, placed, status``: untreated, a vehicle by its name, or treated."""
    forms = {s: ("none", "untreated") for s in L.UNTREATED} | {s: (s.upper() if s in ("pbs", "dmso") else s, "vehicle") for s in L.VEHICLE}
    s = F.lower(clean(value))
    found = _placed(value, _of(s, {k: norm for k, (norm, _) in forms.items()}))
    status = F.coalesce(_of(s, {k: status for k, (_, status) in forms.items()}), F.lit("treated"))
    return once(found, lambda f: F.when(f.isNotNull(), F.struct(f["norm"].alias("norm"), f["placed"].alias("placed"), status.alias("status"))))


def norm_ancestry(value: Column) -> Column:
    return _placed(value, _of(F.lower(clean(value)), _by_spelling(L.ANCESTRY)))


def norm_disease(value: Column, key: Column | None = None) -> Column:
    """A listed disease or ``healthy``: by its name, by an answer under a key that asks
    for an infection, or by a checklist whose answers are all negative."""
    return _placed(value, once(F.lower(clean(value)), lambda s: _disease_name(s, key)))


def _disease_name(s: Column, key: Column | None) -> Column:
    asked = yes(key.contains(L.ANSWER_KEY)) if key is not None else F.lit(False)
    answer = F.lit(None).cast("string")
    for name, pattern in reversed(L.ANSWERS.items()):
        answer = F.when(s.rlike(pattern), name).otherwise(answer)
    checks = F.filter(F.split(s, r"\s*;\s*"), lambda x: x != "")
    negative = (F.size(checks) > 1) & F.forall(checks, lambda x: x.rlike(L.NEGATIVE_ANSWER))
    names = _by_spelling(L.DISEASES)
    listed = F.coalesce(_of(s, names), _of(F.regexp_replace(s, r"\s*\([^)]*\)$", ""), names))
    return F.coalesce(F.when(asked, answer), F.when(F.array_contains(fixed_list(L.HEALTHY), s) | negative, "healthy"), listed)


def norm_sample_type(value: Column, key: Column | None = None) -> Column:
    """A coarse kind of material; NULL for a mere tumour flag."""
    s = F.lower(clean(value))
    line = yes(key.contains("cell line")) if key is not None else F.lit(False)
    norm = F.coalesce(F.when(line, "cell line"), _of(s, _by_spelling(L.TYPE_WORDS)))
    return F.when(line | ~s.rlike(L.TUMOR_FLAG), _placed(value, norm))


_TISSUE_LABELS = {t: _by_spelling(L.TISSUE_LABELS).get(t, t) for t in L.TISSUES}


def norm_tissue(value: Column) -> Column:
    """A listed tissue by its label, whatever species, "tissue" or plural is added."""
    k = F.regexp_replace(F.regexp_replace(F.lower(clean(value)), "[()]", " "), r"\s+", " ")
    k = _trimmed(k, [(pattern, "") for pattern in L.TISSUE_TRIMS])
    forms = once(k, lambda k: F.flatten(F.transform(F.array(k, F.regexp_replace(k, L.TISSUE_ENDINGS, "")), lambda f: F.array(f, F.regexp_replace(f, "s$", "")))))
    return F.get(F.filter(F.transform(forms, lambda f: _of(f, _TISSUE_LABELS)), lambda x: x.isNotNull()), F.lit(0))


def tissue_in_text(text: Column) -> Column:
    """The one listed tissue that free text names, else NULL. Names inside longer names
    that are found too are the same tissue; short names and "tumor" are left out."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(clean(text)), "[^a-z0-9 ]+", " "), r"\s+", " "), F.lit(" "))
    names = sorted((n for n in L.TISSUES if len(n) >= 4 and n not in ("tumor", "tumour")), key=len, reverse=True)
    space = F.lit(" ")
    hits = once(t, lambda t: F.filter(fixed_list(names), lambda x: t.contains(F.concat(space, x, space)) | t.contains(F.concat(space, x, F.lit("s ")))))
    labels = F.array_distinct(F.transform(hits, lambda x: _of(x, _TISSUE_LABELS)))
    whole = once(labels, lambda found: F.filter(found, lambda a: ~F.exists(found, lambda b: (b != a) & b.contains(a))))
    return once(whole, lambda kept: F.when(F.size(kept) == 1, kept[0]))


def norm_cell_type(value: Column) -> Column:
    return _placed(value, _of(F.lower(clean(value)), _by_spelling(L.CELL_TYPES)))


# ---------------------------------------------------------------- extraction

_EXTRA = "struct<attr:string,norm:string,confidence:double>"
_FACT = f"struct<attr:string,norm:string,num:double,unit:string,confidence:double,placed:boolean,extra:array<{_EXTRA}>>"


def _extra(attr: str, norm: Column, confidence: Column) -> Column:
    return F.struct(F.lit(attr).alias("attr"), norm.alias("norm"), confidence.cast("double").alias("confidence"))


def _fact(attr: str, norm: Column, confidence: Column, placed: Column | None = None, num: Column | None = None, unit: Column | None = None, extra: Column | None = None) -> Column:
    return F.struct(
        F.lit(attr).alias("attr"),
        norm.cast("string").alias("norm"),
        (F.lit(None) if num is None else num).cast("double").alias("num"),
        (F.lit(None) if unit is None else unit).cast("string").alias("unit"),
        confidence.cast("double").alias("confidence"),
        (F.lit(True) if placed is None else placed).alias("placed"),
        (F.array() if extra is None else extra).cast(f"array<{_EXTRA}>").alias("extra"),
    )


def _sure(placed: Column, yes_: float = 0.95, no: float = 0.7) -> Column:
    return F.when(placed, yes_).otherwise(no)


def _read(human: Column) -> tuple[Column, Column]:
    """Facts that a pair states, and the attribute that it names without a usable value."""
    value, key, s, rule = F.col("_v"), F.col("attr"), F.col("_s"), F.col("_rule")
    none, loose = F.array().cast(f"array<{_FACT}>"), F.lit(None).cast("string")
    gone, tumor = F.col("_gone"), s.rlike(L.TUMOR_FLAG)
    known, named = F.col("_tissue"), F.col("_named")
    flag = lambda norm, sure: F.array(_fact("disease_state", F.lit(norm), F.lit(sure)))

    normal = s.rlike(L.NORMAL_FLAG) & (key == "tissue type")
    no_tissue = gone | F.array_contains(fixed_list((*L.HEALTHY, *L.UNTREATED)), s)
    code = (key == "region") & known.isNull() & named.isNull()
    tissue = F.when(tumor, flag("case", 0.95)).when(normal, flag("control", 0.95)).when(no_tissue | code, none)
    tissue = tissue.otherwise(F.array(_fact("tissue", F.coalesce(known, value), _sure(known.isNotNull()), known.isNotNull())))
    tissue_loose = F.when(~tumor & ~normal & ~no_tissue & code, "tissue")

    line = key.contains("cell line")
    no_line = known.isNotNull() | named.isNotNull() | s.rlike(L.NO_LINE_VALUES)
    kind = F.col("_kind")
    of_type = F.when(gone, none).when(line & no_line, none).when(line, F.array(_fact("sample_type", F.lit("cell line"), F.lit(0.95))))
    of_type = of_type.when(kind.isNull(), flag("case", 0.9)).otherwise(F.array(_fact("sample_type", kind["norm"], _sure(kind["placed"]), kind["placed"])))
    type_loose = F.when(~gone & line & no_line, "sample_type")

    vague = s.rlike(L.VAGUE_CELLS)
    simple = lambda attr, x: F.when(x.isNull(), none).otherwise(F.array(_fact(attr, x["norm"], _sure(x["placed"]), x["placed"])))
    cell = F.when(vague, none).otherwise(simple("cell_type_sorted", F.col("_cell")))

    d = F.col("_disease")
    state = _extra("disease_state", F.when(d["norm"] == "healthy", "control").otherwise("case"), _sure(d["placed"], 0.9, 0.6))
    disease = F.when(d.isNull(), none).otherwise(F.array(_fact("disease", d["norm"], _sure(d["placed"]), d["placed"], extra=F.array(state))))

    t = F.col("_treatment")
    status = _extra("treatment_status", t["status"], _sure(t["placed"]))
    treatment = F.when(t.isNull(), none).otherwise(F.array(_fact("treatment", t["norm"], _sure(t["placed"]), t["placed"], extra=F.array(status))))

    at = F.col("_at")
    timepoint = F.when(at.isNull(), none).otherwise(F.array(_fact("timepoint", at["norm"], at["confidence"], num=at["num"], unit=at["unit"])))

    wild = s.rlike(L.WILD_TYPE)
    genotype = F.when(gone, none).otherwise(F.array(_fact("genotype", F.when(wild, "wild type").otherwise(value), F.lit(0.95))))

    a = F.col("_age")
    years = F.when(human, to_years(a["num"], a["unit"]))
    stage = F.when(a["unit"] == "E-days", F.array(_extra("life_stage", F.lit("embryonic"), F.lit(0.9))))
    stage = stage.when(years.isNotNull(), F.array(_extra("life_stage", life_stage(years), F.least(a["confidence"], F.lit(0.8)))))
    age = F.when(a.isNull(), none).otherwise(F.array(_fact("age", a["norm"], a["confidence"], num=a["num"], unit=a["unit"], extra=F.coalesce(stage, F.array().cast(f"array<{_EXTRA}>")))))

    listed = F.col("_stage")
    day = _amount(s, L.EMBRYONIC_DAY, 1)
    both = F.array(_fact("age", F.concat(F.lit("E"), day), F.lit(0.95), num=day, unit=F.lit("E-days")), _fact("life_stage", F.lit("embryonic"), F.lit(0.9)))
    life = F.when(gone, none).when(listed.isNotNull(), F.array(_fact("life_stage", listed, F.lit(0.95)))).when(s.rlike(L.EMBRYONIC_DAY), both).otherwise(none)

    x = F.col("_sex")
    sex = F.when(x.isNull() | x["norm"].isNull(), none).otherwise(F.array(_fact("sex", x["norm"], F.lit(0.95))))
    ancestry = simple("ancestry", F.col("_ancestry"))
    donor = F.when(gone, none).otherwise(F.array(_fact("donor", value, F.lit(0.95))))

    facts = {
        "tissue": tissue, "sample_type": of_type, "cell_type_sorted": cell, "disease": disease, "treatment": treatment, "timepoint": timepoint,
        "genotype": genotype, "age": age, "life_stage": life, "sex": sex, "ancestry": ancestry, "donor": donor,
    }
    open_ = {
        "tissue": tissue_loose, "sample_type": type_loose, "timepoint": F.when(at.isNull() & ~gone, "timepoint"), "age": F.when(a.isNull() & ~gone, "age"),
        "life_stage": F.when(~gone & listed.isNull() & ~s.rlike(L.EMBRYONIC_DAY), "life_stage"), "sex": F.when(x["norm"].isNull() & ~gone, "sex"),
    }
    out, left = none, loose
    for attr in reversed(list(L.ATTRIBUTE_KEYS)):
        out = F.when(rule == attr, facts[attr]).otherwise(out)
        left = F.when(rule == attr, open_.get(attr, loose)).otherwise(left)
    # a sentence in a label field is not a label
    long = F.length(value) > F.coalesce(_of(rule, {k: str(n) for k, n in L.LONGEST_LABEL.items()}).cast("int"), F.lit(L.LONGEST_VALUE))
    usable = rule.isNotNull() & (value != "") & (F.length(value) <= L.LONGEST_VALUE)
    return F.when(usable & ~long, out).otherwise(none), F.when(usable & long & ~gone, rule).when(usable & ~long, left)


def _rule() -> Column:
    """The attribute that a pair's key names."""
    order = list(L.ATTRIBUTE_KEYS)
    plain = {k: attr for attr in reversed(order) for k in L.ATTRIBUTE_KEYS[attr] if re.fullmatch("[a-z0-9 /]+", k)}
    named = lambda key: _of(key, plain)
    shaped = {attr: [k for k in L.ATTRIBUTE_KEYS[attr] if not re.fullmatch("[a-z0-9 /]+", k)] for attr in order}

    def rule(key: Column) -> Column:
        # an attribute that comes earlier wins, by name or by pattern
        out = named(key)
        for attr in reversed([a for a in order if shaped[a]]):
            before = order[: order.index(attr)]
            out = F.when(key.rlike("^(" + "|".join(shaped[attr]) + ")$") & ~yes(named(key).isin(before) if before else F.lit(False)), attr).otherwise(out)
        return out

    return once(F.col("attr"), rule)


def _informs() -> Column:
    return (F.col("_v") != "") & ~F.array_contains(fixed_list(L.NOISE_KEYS), F.col("attr"))


def read_pairs(pairs: DataFrame, key: str, human: Column | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Everything that the rules read from pairs, one row each: ``key, outcome, attr,
    pair_key, value_raw, value_norm, value_num, unit, confidence, evidence``.

    ``outcome`` is ``fact`` (the first pair that fills an attribute wins; 0.95 where a
    closed list or a pattern places the value, else 0.7), ``unplaced`` (an attribute is
    named, but its value is in no list) or ``unmapped`` (a key that no rule reads).
    ``human`` says which pairs are of human donors. ``sources`` (``key, source``): text
    that may name the tissue where no pair does.

    Values repeat heavily, so the rules read each distinct (key, value) once and are joined
    back. Rows are dealt by sample once; the two steps after it keep that partitioning.
    """
    told = pairs.withColumn("_human", yes(human) if human is not None else F.lit(False)).select(key, "position", "attr", "value", "evidence", "_human")
    told = stage(told, "pairs")  # read twice: for its distinct values, and to join them back
    rows = told.select("attr", "value", "_human").distinct().withColumn("_rule", _rule()).withColumn("_v", clean(F.col("value"))).withColumn("_s", F.lower("_v"))
    of_tissue = F.col("_rule").isin("tissue", "sample_type")
    rows = rows.withColumn("_tissue", F.when(of_tissue, norm_tissue(F.col("_v")))).withColumn("_named", F.when(of_tissue & F.col("_tissue").isNull(), tissue_in_text(F.col("_v"))))
    human = F.col("_human")
    value, key_ = F.col("_v"), F.col("attr")
    forms = {
        "_age": ("age", parse_age(F.col("value"), key_, human)), "_at": ("timepoint", parse_timepoint(value, key_)), "_kind": ("sample_type", norm_sample_type(value)),
        "_cell": ("cell_type_sorted", norm_cell_type(value)), "_disease": ("disease", norm_disease(value, key_)), "_treatment": ("treatment", norm_treatment(value)),
        "_stage": ("life_stage", _of(F.col("_s"), _by_spelling(L.LIFE_STAGES))), "_sex": ("sex", norm_sex(value)), "_ancestry": ("ancestry", norm_ancestry(value)),
    }
    rows = rows.withColumns({name: F.when(F.col("_rule") == attr, form) for name, (attr, form) in forms.items()} | {"_gone": missing(value)})
    facts, loose = _read(human)
    rows = rows.withColumn("_facts", facts).withColumn("_loose", loose)
    # written once: facts, open values and open keys are all taken from it
    # (a filter here would be pushed below, with all these expressions in it)
    read = stage(rows.select(F.col("attr").alias("pair_key"), F.col("value").alias("_value"), F.col("_human").alias("_is_human"), F.col("_v").alias("value_raw"), "_facts", "_loose", F.when(F.col("_rule").isNull() & _informs(), True).alias("_open")), "read")
    same = F.col("attr").eqNullSafe(F.col("pair_key")) & F.col("value").eqNullSafe(F.col("_value")) & (F.col("_human") == F.col("_is_human"))
    # what says nothing goes before the join
    speaks = (F.size("_facts") > 0) | F.col("_loose").isNotNull() | F.col("_open").isNotNull()
    rows = told.join(read.where(speaks), same).select(key, "position", "pair_key", "value_raw", "evidence", "_facts", "_loose", "_open")

    empty = F.lit(None)
    item = lambda outcome, attr, norm=empty, num=empty, unit=empty, confidence=empty: F.struct(
        F.lit(outcome).alias("outcome"), attr.cast("string").alias("attr"), "pair_key", "value_raw", norm.cast("string").alias("value_norm"),
        num.cast("double").alias("value_num"), unit.cast("string").alias("unit"), confidence.cast("double").alias("confidence"), "evidence",
    )
    other = F.array_compact(F.array(F.when(F.col("_loose").isNotNull(), item("unplaced", F.col("_loose"))), F.when(F.col("_open"), item("unmapped", empty))))
    aside = rows.select(key, F.explode(other).alias("r")).select(key, "r.*")

    columns = ["position", "pair_key", "value_raw", "evidence"]
    mains = rows.select(key, *columns, F.explode("_facts").alias("f"))
    if sources is not None:
        text = clean(F.col("source"))
        more = sources.select(key, F.lit(_LAST).alias("position"), F.lit("source").alias("pair_key"), text.alias("value_raw"), text.alias("evidence")).where(F.length("value_raw") <= 60)
        named = more.withColumn("_t", tissue_in_text(F.col("value_raw"))).where("_t is not null")
        mains = mains.unionByName(named.select(key, *columns, _fact("tissue", F.col("_t"), F.lit(0.8)).alias("f")))
    first = lambda df: df.groupBy(key, "attr").agg(F.min_by(F.struct(*columns, "f"), "position").alias("w")).select(key, "w.*")
    won = first(mains.repartition(key).withColumn("attr", F.col("f.attr")))
    # what follows from a fact counts only where that fact is the first of its attribute
    whole = F.transform(F.col("f.extra"), lambda e: F.struct(e["attr"].alias("attr"), e["norm"].alias("norm"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("unit"), e["confidence"].alias("confidence"), F.lit(True).alias("placed")))
    own = F.struct(*(F.col(f"f.{c}").alias(c) for c in ("attr", "norm", "num", "unit", "confidence", "placed")))
    won = first(won.select(key, *columns, F.explode(F.concat(F.array(own), whole)).alias("f")).withColumn("attr", F.col("f.attr")))
    kept = F.array_compact(
        F.array(
            item("fact", F.col("f.attr"), F.col("f.norm"), F.col("f.num"), F.col("f.unit"), F.col("f.confidence")),
            F.when(~F.col("f.placed"), item("unplaced", F.col("f.attr"))),
        )
    )
    return won.select(key, F.explode(kept).alias("r")).select(key, "r.*").unionByName(aside)


def extract_attrs(pairs: DataFrame, key: str, human: Column | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The facts of ``read_pairs``: one row per sample and attribute."""
    return read_pairs(pairs, key, human, sources).where("outcome = 'fact'").drop("outcome", "pair_key")


def unplaced_values(pairs: DataFrame, key: str, human: Column | None = None) -> DataFrame:
    """``key, attr, pair_key, value_raw, evidence`` of values that no list places."""
    return read_pairs(pairs, key, human).where("outcome = 'unplaced'").select(key, "attr", "pair_key", "value_raw", "evidence")


def unmapped_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """``key, pair_key, value_raw, evidence`` of keys that no rule reads."""
    rows = pairs.withColumn("_v", clean(F.col("value"))).where(_rule().isNull() & _informs())
    return rows.select(key, F.col("attr").alias("pair_key"), F.col("_v").alias("value_raw"), "evidence")


# ---------------------------------------------------------------- sample types

def tumor_type(value: Column) -> Column:
    """Kind of tumour sample that a whole value names; never one before metastasis."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"\s+", " "), "_+", " ")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(L.TUMOR_TYPES):
        out = F.when(s.rlike(f"^({pattern})$"), name).otherwise(out)
    return F.when(~s.rlike(L.NOT_METASTATIC), out)


def classify_sample_type(pairs: DataFrame, key: str, lines: DataFrame | None = None) -> DataFrame:
    """``key, tissue_type, sample_kind, tumor_sample_type, cell_line, evidence``, NULL
    where a sample's own pairs say nothing.

    Precedence: organoid, xenograft, a line grown in an animal, a known line, cells
    derived from stem cells, the words "cell line", a primary culture, a named tissue
    (only where nothing speaks of culture). ``lines``: ``name, accession, category`` of
    known cell lines, names in lower case without "cells". The text of a source field is
    a pair with the key ``source``.
    """
    v, k = F.col("value"), F.col("attr")
    typed = F.array_contains(fixed_list(L.TYPE_KEYS), k)
    # the pairs are written, so that they are made once; each distinct one is read once, and
    # written, so that no test is drawn below the join
    told = stage(pairs.where("value != ''").select(key, "position", "attr", "value", "evidence"), "told")
    rows = told.select("attr", "value").distinct()
    line_field = (k.isin(*L.LINE_KEYS) & ~F.trim(v).rlike(L.STRAIN)) | (typed & v.rlike(L.LINE))
    if lines is None:
        rows = rows.withColumn("accession", F.lit(None).cast("string")).withColumn("category", F.lit(None).cast("string"))
    else:
        asked = F.when(line_field, F.regexp_replace(F.lower(F.trim(v)), " cells?$", ""))
        rows = rows.join(lines.select(F.col("name").alias("_name"), "accession", "category"), asked == F.col("_name"), "left")
    organ_field = k.isin("tissue", "organ", "source")
    tests = {
        "organoid": typed & v.rlike(L.ORGANOID),
        "organoid_field": k.rlike(L.ORGANOID_KEY) & ~v.rlike(L.NO_ORGANOID),
        "xenograft": v.rlike(L.XENOGRAFT),
        "stem": typed & v.rlike(L.STEM) & (v.rlike(L.DERIVED) | k.isin("cell line", "cell type")),
        "culture": typed & v.rlike(L.CULTURE),
        "line_word": typed & v.rlike(L.LINE) & ~v.rlike(L.NO_LINE),
        "line": F.col("accession").isNotNull(),
        "stem_line": F.col("category").rlike(L.STEM_CATEGORY),
        "in_vivo": k.isin(*L.IN_VIVO_KEYS) & v.rlike(L.IN_VIVO) & ~v.rlike(L.IN_VITRO) & ~v.rlike(L.LINE),
        "culture_word": v.rlike(L.CULTURE_WORD),
        "tissue": organ_field & F.coalesce(F.when(organ_field, norm_tissue(v)), F.when(organ_field, tissue_in_text(v))).isNotNull(),
    }
    tumor = F.when(F.array_contains(fixed_list(L.TUMOR_KEYS), k), tumor_type(v))
    read = stage(rows.select(k.alias("_attr"), v.alias("_value"), "accession", tumor.alias("_tumor"), *(yes(test).alias(f"_{name}") for name, test in tests.items())), "typed")
    rows = told.join(read, k.eqNullSafe(F.col("_attr")) & (v == F.col("_value")))
    first = [F.min(F.when(F.col(f"_{name}"), F.struct("position", "evidence", "accession"))).alias(name) for name in tests]
    found = rows.groupBy(key).agg(*first, F.min(F.when(F.col("_tumor").isNotNull(), F.struct("position", F.col("_tumor").alias("type")))).alias("tumor"))
    has = {name: F.col(name).isNotNull() for name in tests}
    organoid = has["organoid"] | has["organoid_field"]
    in_vivo = (has["line"] | has["line_word"]) & has["in_vivo"]
    by_tissue = has["tissue"] & ~has["culture_word"]
    kinds = [
        (organoid, "organoid", F.coalesce("organoid.evidence", "organoid_field.evidence")),
        (has["xenograft"], "tissue", F.col("xenograft.evidence")),
        (in_vivo, "tissue", F.col("in_vivo.evidence")),
        (has["line"], "cell line", F.col("line.evidence")),
        (has["stem"], "cell line", F.col("stem.evidence")),
        (has["line_word"], "cell line", F.col("line_word.evidence")),
        (has["culture"], "primary cell culture", F.col("culture.evidence")),
        (by_tissue, "tissue", F.col("tissue.evidence")),
    ]
    value, evidence = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, name, text in reversed(kinds):
        value, evidence = F.when(test, name).otherwise(value), F.when(test, text).otherwise(evidence)
    kind = F.when(has["xenograft"], "xenograft").when(organoid, "organoid").when(in_vivo, F.lit(None)).when(has["stem_line"] | has["stem"], "stem_cell")
    kind = kind.when(has["line"] | has["line_word"], "cell_line").when(value.isin("tissue", "primary cell culture"), "primary")
    tumor_kind = F.when(~yes(value == "cell line"), F.col("tumor.type"))
    return found.select(key, value.alias("tissue_type"), kind.alias("sample_kind"), tumor_kind.alias("tumor_sample_type"), F.col("line.accession").alias("cell_line"), evidence.alias("evidence"))


def disease_of(attr: Column, value: Column, human: Column) -> Column:
    """Struct of ``kind, text, confidence``: ``healthy`` or ``disease`` as a pair states
    it, without words for persons and severity; NULL where the key names neither. A bare
    "control" is healthy only for a human under a disease key."""
    by_key, generic = attr.isin(*L.DISEASE_KEYS), attr.isin(*L.GENERIC_KEYS)
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"\s+", " "), r"\s*\.$", "")
    text = _trimmed(v, [(pattern, "") for pattern in L.DISEASE_TRIMS])
    out = lambda kind, words, sure: F.struct(F.lit(kind).alias("kind"), words.alias("text"), sure.cast("double").alias("confidence"))
    nothing = (v == "") | v.rlike(L.NO_DISEASE_VALUES)
    bare = v.rlike(L.BARE_CONTROL)
    return (
        F.when(~(by_key | generic) | nothing, F.lit(None))
        .when(v.rlike(L.HEALTHY_PHRASE), out("healthy", v, F.lit(0.95)))
        .when(bare & by_key & yes(human), out("healthy", v, F.lit(0.85)))
        .when(~bare, out("disease", text, F.when(by_key, 0.9).otherwise(0.85)))
    )


def disease_candidate(pairs: DataFrame, key: str, human: Column | None = None) -> DataFrame:
    """``key, kind, disease, confidence``: what the first disease key, else the first
    generic one, says."""
    found = disease_of(F.col("attr"), F.col("value"), human if human is not None else F.lit(False))
    rows = pairs.withColumn("_d", found).where("_d is not null")
    rank = F.struct((~F.col("attr").isin(*L.DISEASE_KEYS)).alias("late"), "position")
    first = rows.groupBy(key).agg(F.min_by("_d", rank).alias("d"))
    return first.select(key, "d.kind", F.col("d.text").alias("disease"), "d.confidence")


def evidence_holds(evidence: Column, text: Column) -> Column:
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return yes(fold(text).contains(fold(evidence)))


def map_to_ontology(values: DataFrame, labels: DataFrame, value: str, general: Sequence[str] = ()) -> DataFrame:
    """``value, term_id, method, confidence``: by id, alias, label or synonym of the value
    itself, then of its variants; ambiguous or too general values stay unmapped."""
    asked = values.select(value).distinct()
    forms = asked.select(value, F.posexplode(singulars(F.lower(F.trim(F.col(value))))).alias("form", "name"))
    hits = unique_tier_lookup(forms.select("name"), labels, "name")
    found = forms.join(hits, "name").where(~F.col("term_id").isin(list(general)) if general else F.lit(True))
    best = found.groupBy(value).agg(F.min(F.struct("form", "tier", "term_id")).alias("b"))
    names = F.array(*map(F.lit, ["id", "alias", "label", "synonym"]))
    method = F.concat(F.element_at(names, F.col("b.tier") + 1), F.when(F.col("b.form") > 0, "+variant").otherwise(""))
    confidence = F.when(F.col("b.form") > 0, 0.8).otherwise(F.when(F.col("b.tier") <= 2, 1.0).otherwise(0.9))
    return asked.join(best, value, "left").select(value, F.col("b.term_id").alias("term_id"), F.when(F.col("b.term_id").isNotNull(), method).alias("method"), F.when(F.col("b.term_id").isNotNull(), confidence).alias("confidence"))


def age_to_stage(num: Column, unit: Column, stages: Sequence[tuple[str, float, float | None]]) -> Column:
    """Narrowest stage [low, high) in days that holds an age; ties to the first."""
    days = to_years(num, unit) * 365.25
    ordered = sorted(enumerate(stages), key=lambda x: ((x[1][2] or float("inf")) - x[1][1], x[0]))
    out = F.lit(None).cast("string")
    for _, (name, low, high) in reversed(ordered):
        inside = (days >= low) & (days < high if high is not None else F.lit(True))
        out = F.when(inside, name).otherwise(out)
    return out


def review_queue(values: DataFrame, mapped: DataFrame, decisions: DataFrame, value: str, sample: str) -> DataFrame:
    """``value, n_samples``: still unmapped after the mapper and reviewed decisions."""
    done = mapped.where("term_id is not null").select(value).unionByName(decisions.select(value))
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(sample).alias("n_samples"))
    return counts.join(done.distinct(), value, "left_anti")


def backfill_groups(df: DataFrame, column: str, sources: Sequence[Column], rules: Sequence[tuple[str, str]], placeholder: str | None = None) -> DataFrame:
    """Fills unknown groups from the first source that a rule (substring, group) places;
    a placeholder group counts as unknown when named."""

    def placed(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for text, group in reversed(rules):
            out = F.when(F.lower(c).contains(text), group).otherwise(out)
        return out

    own = F.nullif(F.col(column), F.lit(placeholder)) if placeholder is not None else F.col(column)
    return df.withColumn(column, F.coalesce(own, *(placed(c) for c in sources), F.col(column)))


def norm_organism(value: Column, species: Mapping[str, str]) -> Column:
    """First listed part that names a known species, else the first part."""
    parts = F.transform(F.split(value, r"\s*[;,|]\s*"), lambda p: F.trim(p))
    known = F.filter(F.transform(parts, lambda p: lookup(F.lower(p), dict(species))), lambda x: x.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.get(parts, F.lit(0)))


def build_species(build: Column) -> Column:
    """Species that a reference build's name covers, as an array."""
    human = F.when(build.rlike("(?i)grch|hg[0-9]|human"), F.lit("human"))
    mouse = F.when(build.rlike("(?i)grcm|mm[0-9]|mouse"), F.lit("mouse"))
    return F.filter(F.array(human, mouse), lambda x: x.isNotNull())


def reference_mismatch(species: Column, build: Column) -> Column:
    """Whether the build does not cover the species; only when both are known."""
    covered = build_species(F.coalesce(build, F.lit("")))
    return F.coalesce(species.isNotNull() & (F.size(covered) > 0) & ~F.array_contains(covered, species), F.lit(False))


ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def norm_label(value: Column) -> Column:
    """Accents, case, quotes and punctuation folded."""
    plain = F.translate(F.lower(value), *ACCENTS)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "['’`]", ""), "[^a-z0-9+]+", " "))


def canonical_id(value: Column, prefixes: Sequence[str]) -> Column:
    """``PREFIX:digits`` from underscore, URL or lower-case forms."""
    pattern = r"(?i)(?:^|[/#])(" + "|".join(prefixes) + r")[:_]([0-9]+)$"
    prefix = F.upper(F.regexp_extract(F.trim(value), pattern, 1))
    return F.when(prefix != "", F.concat(prefix, F.lit(":"), F.regexp_extract(F.trim(value), pattern, 2)))


def platform_label(protocol: Column, assay: Column, modality: Column) -> Column:
    p = F.lower(F.coalesce(protocol, F.lit("")))
    version = F.regexp_extract(p, "v([23])", 1)
    versioned = F.concat(assay, F.when(version != "", F.concat(F.lit(" v"), version)).otherwise(""))
    base = F.when(assay.isin("10x 3'", "10x 5'"), versioned).when(assay == "10x (version unconfirmed)", "10x").when(assay == "10x Multiome / ATAC", "10x Multiome")
    base = base.when(assay == "Spatial", F.when(p.contains("visium"), "Visium spatial").otherwise("spatial")).otherwise(assay)
    suffix = F.when(modality.isin("snRNA", "scRNA"), F.concat(F.lit(" "), modality, F.lit("-seq"))).otherwise("")
    return F.when(assay.isNotNull() & ~assay.isin("", "Unknown", "Not single-cell RNA"), F.concat(base, suffix))


def cells_label(n: Column) -> Column:
    """Two significant digits with k or M; NULL for nothing."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(n.cast("double"))) - 1)
    r = F.round(n / size) * size
    short = lambda x: F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")
    big = F.when(r >= 1e6, F.concat(short(r / 1e6), F.lit("M"))).when(r >= 1e5, F.concat(F.format_string("%.0f", r / 1e3), F.lit("k"))).otherwise(F.concat(short(r / 1e3), F.lit("k")))
    return F.when(n <= 0, F.lit(None)).when(n < 1000, n.cast("long").cast("string")).when(n >= 1000, big)


def normalise_modality(modality: Column, assay: Column) -> Column:
    """Aliases folded; a modality that contradicts its assay is repaired."""
    alias = lookup(F.lower(F.trim(modality)), {"scrna": "scRNA", "scrna-seq": "scRNA", "single cell": "scRNA", "snrna": "snRNA", "snrna-seq": "snRNA", "single nucleus": "snRNA", "spatial": "Spatial"}, modality)
    return F.when(yes(assay == "Spatial"), "Spatial").when(yes(alias == "Spatial") & assay.isNotNull() & (assay != "Spatial"), F.lit(None)).otherwise(alias)


def json_list(value: Column) -> Column:
    """JSON array text as a list; other text split on commas and semicolons."""
    s = F.trim(F.coalesce(value, F.lit("")))
    plain = F.filter(F.transform(F.split(s, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(s.startswith("["), F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))).otherwise(plain)


def lateral_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per element of a JSON array; a row with NULL for an empty one."""
    return df.select(key, F.explode_outer(json_list(F.col(column))).alias("element"))


def zero_as_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in columns})


def first_member(files: DataFrame, key: str, name: str, registry: Mapping[str, Sequence[str]], human: Column, human_only: Sequence[str]) -> DataFrame:
    """``key, modality, file``: the first listed file of each modality that a sample has."""
    options = []
    for modality, names in registry.items():
        place = F.array_position(F.array(*map(F.lit, names)), F.col(name))
        gate = human if modality in human_only else F.lit(True)
        options.append(F.struct(F.lit(modality).alias("modality"), F.when(gate & (place > 0), place).alias("place")))
    rows = files.select(key, name, F.explode(F.array(*options)).alias("o")).where("o.place is not null")
    return rows.groupBy(key, F.col("o.modality").alias("modality")).agg(F.min_by(name, "o.place").alias("file"))


