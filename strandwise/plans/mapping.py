"""Queries of the ontology mapper with rewritten forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.functions import lexicons as L
from strandwise.operators import mapping as M

from .registry import query

LABELS = [
    ("ring", "UB:1", 0), ("widget", "UB:2", 0), ("bolt", "UB:3", 0), ("bolt", "UB:4", 0), ("gear", "UB:5", 1), ("gizmo", "UB:6", 2), ("gizmo", "UB:7", 2), ("lever", "CL:00008", 2),
    ("small ring", "UB:9", 1), ("ring cell", "CL:00010", 0), ("widget cell", "CL:00011", 1), ("cd4 positive alpha beta t cell", "CL:00012", 0), ("t cell", "CL:00013", 0),
    ("gear cell", "CL:00014", 0), ("red gear", "UB:15", 2), ("thing", "UB:16", 0), ("blue bolt", "UB:17", 1), ("plate", "UB:18", 2),
]
ALIASES = [("tissue", "hot ring", "UB:20", 0.92), ("cell_type_sorted", "bolt", "CL:00021", None)]
GENERAL = ["UB:16", "UB:2"]
#: How values are dressed, by part number; {} is the part's name, or its last word.
SHAPES = [
    "{}", "Human {} tissues", "primary human whole {}s", "{} cells", "CD4 T cells from {}", "blood {}s", "CD3 positive {} cell", "fresh {} organoids", "cd8 live t cells",
    "CL_00008 {}", "frozen {} samples of mouse", "thing", "lever", "the {}", "{} biopsy",
]


def _values_sql() -> str:
    word = "CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END"
    shape = " ".join(f"WHEN {i} THEN replace('{s}', '{{}}', {word})" for i, s in enumerate(SHAPES))
    return f"SELECT DISTINCT CASE WHEN p_partkey % 4 < 2 THEN 'tissue' ELSE 'cell_type_sorted' END AS attr, CASE p_partkey % {len(SHAPES)} {shape} END AS value FROM part"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}" for x in r) + ")" for r in rows)


def _sql() -> str:
    lead, trail = "|".join(L.LEADING_WORDS), "|".join(L.TRAILING_WORDS)
    strip = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace({c}, '^(?:{lead})\s+', ''), '\s+(?:{trail})$', ''), '\s+', ' ', 'g'))"
    markers = rf"^(?:(?:{'|'.join(L.CELL_MARKERS)})\s+(?:(?:{'|'.join(L.MARKER_LEVELS)})\s+)?)+"
    blood = rf"^(?:{'|'.join(L.BLOOD_WORDS)})\s+([a-z])"
    single = r"regexp_replace({}, '\bcells\b', 'cell', 'g')"
    plural = r"regexp_replace({}, '(\w{{3,}}[^s])s$', '\1')"
    forms = []
    for w in ("base", "s3"):
        unblood, unmarked = rf"regexp_replace({w}, '{blood}', '\1')", f"regexp_replace({w}, '{markers}', '')"
        cells = [
            rf"regexp_replace({w}, '\bcells?\b$', '')", rf"CASE WHEN NOT regexp_matches({w}, '\bcells?$') THEN {w} || ' cell' END",
            rf"regexp_replace({w}, '\b(cd4|cd8) t cells?\b', '\1 positive alpha beta t cell', 'g')", rf"regexp_replace({w}, '\b(cd\d+[a-z]?)\b', '\1 positive', 'g')",
            f"CASE WHEN {unblood} <> {w} THEN {unblood} END", f"CASE WHEN {unblood} <> {w} THEN {plural.format(single.format(unblood))} END",
        ]
        typed = f"{unmarked} <> {w} AND regexp_matches({unmarked}, '^[a-z]{{3,}}|^[a-z] cells?$')"
        cells += [f"CASE WHEN {typed} THEN {unmarked} END", f"CASE WHEN {typed} THEN {single.format(unmarked)} END"]
        plain = [single.format(w), plural.format(w), rf"regexp_replace({w}, '(\w{{3,}})ies$', '\1y')"]
        forms += [*plain, *(f"CASE WHEN attr = 'cell_type_sorted' THEN {c} END" for c in cells)]
    return rf"""
WITH v AS ({_values_sql()}), labels (name, term_id, tier) AS (VALUES {_rows(LABELS)}), aliases (attr, name, term_id, confidence) AS (VALUES {_rows(ALIASES)}),
b0 AS (SELECT attr, value, trim(regexp_replace(regexp_replace(lower(value), '[''’`]', '', 'g'), '[^a-z0-9+]+', ' ', 'g')) AS base FROM v),
b1 AS (SELECT *, {strip('base')} AS s1 FROM b0), b2 AS (SELECT *, {strip('s1')} AS s2 FROM b1), b3 AS (SELECT *, {strip('s2')} AS s3 FROM b2),
f AS (SELECT attr, value, base, unnest(names) AS name, unnest(range(len(names))) AS form FROM (SELECT *, [base, s1, s2, s3, {', '.join(forms)}] AS names FROM b3)),
g AS (SELECT attr, value, base, trim(regexp_replace(name, '\s+', ' ', 'g')) AS name, form FROM f),
h AS (SELECT attr, value, base, name, min(form) AS form FROM g WHERE name <> '' GROUP BY ALL),
one AS (SELECT name, tier, min(term_id) AS label_id, count(DISTINCT term_id) AS terms FROM labels l WHERE tier = (SELECT min(tier) FROM labels m WHERE m.name = l.name) GROUP BY name, tier),
r AS (SELECT h.*, CASE WHEN a.term_id IS NOT NULL THEN {{'t': a.term_id, 'm': 'curated', 'c': CASE WHEN form = 0 THEN coalesce(confidence, 0.9) ELSE least(coalesce(confidence, 0.9), 0.85) END::double}}
  WHEN form = 0 AND terms = 1 AND label_id NOT IN ('UB:16', 'UB:2') AND (tier < 2 OR length(replace(h.name, ' ', '')) >= 6) THEN {{'t': label_id, 'm': ['label', 'exact_synonym', 'synonym'][tier + 1], 'c': [0.95, 0.9, 0.75][tier + 1]::double}}
  WHEN form = 0 AND tier IS NOT NULL THEN {{'t': NULL, 'm': NULL, 'c': NULL}}
  WHEN form > 0 AND terms = 1 AND tier < 2 AND label_id NOT IN ('UB:16', 'UB:2') THEN {{'t': label_id, 'm': 'variant', 'c': CASE WHEN regexp_matches(base, '\borganoids?\b') THEN 0.7 WHEN tier = 0 THEN 0.85 ELSE 0.8 END::double}} END AS r
  FROM h LEFT JOIN one ON one.name = h.name LEFT JOIN aliases a ON a.attr = h.attr AND a.name = h.name),
w AS (SELECT *, row_number() OVER (PARTITION BY attr, value ORDER BY form) AS k FROM r WHERE r IS NOT NULL),
ids AS (SELECT attr, value, upper(replace(regexp_extract(value, '\b([A-Za-z]+[:_]\d{{5,}})\b', 1), '_', ':')) AS id FROM v)
SELECT v.attr, v.value, coalesce(known.id, r.t) AS term_id, CASE WHEN known.id IS NOT NULL THEN 'id' ELSE r.m END AS method,
  CASE WHEN known.id IS NOT NULL THEN 0.99 ELSE r.c END::double AS confidence, CASE WHEN known.id IS NULL AND r.t IS NOT NULL THEN w.name END AS name
FROM v LEFT JOIN w ON w.attr = v.attr AND w.value = v.value AND k = 1
LEFT JOIN ids known ON known.attr = v.attr AND known.value = v.value AND known.id IN (SELECT term_id FROM labels)"""


@query("map_values", _sql())
def _(t):
    word = F.when(F.col("p_partkey") % 2 == 0, F.element_at(F.split("p_name", " "), 2)).otherwise(F.col("p_name"))
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("p_partkey") % len(SHAPES) + 1).cast("int"))
    values = t.part.select(F.when(F.col("p_partkey") % 4 < 2, "tissue").otherwise(M.CELL_TYPE).alias("attr"), F.replace(shape, F.lit("{}"), word).alias("value"))
    labels = t.spark.createDataFrame(LABELS, "name string, term_id string, tier int")
    aliases = t.spark.createDataFrame(ALIASES, "attr string, name string, term_id string, confidence double")
    return M.map_values(values, labels, aliases, GENERAL)
