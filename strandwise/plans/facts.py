"""Queries of section K over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import facts as K

from .joins import NAMES
from .registry import Tables, query



def pair_text(t: Tables):
    text = F.concat(F.lit("Priority: "), "o_orderpriority", F.lit(" ;; Status: "), "o_orderstatus", F.lit(" ;; donor_age: "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" years"))
    return t.orders.select("o_orderkey", text.alias("pairs"))


_PAIRS = """(SELECT o_orderkey, unnest([0, 1, 2]) AS position, unnest(['priority', 'status', 'donor age']) AS attr, unnest([o_orderpriority, o_orderstatus, (o_orderkey % 90) || ' years']) AS value,
  unnest(['Priority: ' || o_orderpriority, 'Status: ' || o_orderstatus, 'donor_age: ' || (o_orderkey % 90) || ' years']) AS evidence FROM orders)"""


@query("parse_pairs", f"SELECT * FROM {_PAIRS}")
def _(t):
    return K.parse_pairs(pair_text(t), "o_orderkey", "pairs")


# What a sample says, by its key: pairs of text and what the rules make of it. The
# expected forms are written out here, not taken from the library's lists.
_SAYS = {
    "tissue": ["tissue: Lung", "tissue: whole blood", "organ: Kidney cortex tissue", "tissue: fossil", "tissue type: adjacent normal", "region: R1"],
    "disease": ["disease state: Healthy donor", "diagnosis: T2D", "disease: Gout", "disease: DM: no; HTN: no", "covid status: negative", "disease: n/a", "disease state: COVID-19 (severe)"],
    "treatment": ["treatment: untreated", "agent: PBS", "drug: 10 nM Drug", "treatment: sham", "treatment: saline"],
    "sex": ["Sex: M", "gender: woman", "sex: both", "sex: hermaphrodite"],
    "ancestry": ["race: European", "ethnicity: Han Chinese", "ancestry: Martian"],
}
_READS = {
    "tissue": [("tissue", "lung", 0.95), ("tissue", "blood", 0.95), ("tissue", "kidney cortex", 0.95), ("tissue", "fossil", 0.7), ("disease_state", "control", 0.95), None],
    "disease": [("disease", "healthy", 0.95), ("disease", "type 2 diabetes", 0.95), ("disease", "Gout", 0.7), ("disease", "healthy", 0.95), ("disease", "healthy", 0.95), None, ("disease", "covid-19", 0.95)],
    "treatment": [("treatment", "none", 0.95), ("treatment", "PBS", 0.95), ("treatment", "10 nM Drug", 0.7), ("treatment", "sham", 0.95), ("treatment", "saline", 0.95)],
    "sex": [("sex", "male", 0.95), ("sex", "female", 0.95), ("sex", "mixed", 0.95), None],
    "ancestry": [("ancestry", "white", 0.95), ("ancestry", "asian", 0.95), ("ancestry", "Martian", 0.7)],
}
_STATUS = ["untreated", "vehicle", "treated", "vehicle", "vehicle"]


def stated(t: Tables):
    """Orders as samples, each with a pair of every group and two that no rule reads."""
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % len(texts) + 1).cast("int"))
    text = F.concat_ws(" ;; ", *(pick(texts) for texts in _SAYS.values()), F.lit("smoker: yes"), F.lit("batch: 7"), F.lit("sex: F"))
    return K.parse_pairs(t.orders.select("o_orderkey", text.alias("pairs")), "o_orderkey", "pairs")


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _stated_sql() -> str:
    """Facts as SQL: one branch per group; a second statement of sex counts where the
    first has no form, and the state of a disease where no tissue told it before."""
    parts = []
    for group, texts in _SAYS.items():
        n, reads = len(texts), _READS[group]
        value = _sql_list([x.split(": ", 1)[1] for x in texts])
        at = f"[o_orderkey % {n} + 1]"
        parts.append(
            f"SELECT o_orderkey, {_sql_list([r and r[0] for r in reads])}{at} AS attr, {value}{at} AS value_raw, {_sql_list([r and r[1] for r in reads])}{at} AS value_norm, "
            f"({_sql_list([r and r[2] for r in reads])}{at})::double AS confidence, {_sql_list(texts)}{at} AS evidence FROM orders"
        )
    d = _SAYS["disease"]
    value, text = _sql_list([x.split(": ", 1)[1] for x in d]), _sql_list(d)
    states = _sql_list([None if r is None else "control" if r[1] == "healthy" else "case" for r in _READS["disease"]])
    sure = _sql_list([None if r is None else 0.9 if r[2] > 0.9 else 0.6 for r in _READS["disease"]])
    at = f"[o_orderkey % {len(d)} + 1]"
    parts.append(f"SELECT o_orderkey, CASE WHEN {states}{at} IS NOT NULL THEN 'disease_state' END, {value}{at}, {states}{at}, ({sure}{at})::double, {text}{at} FROM orders WHERE o_orderkey % 6 <> 4")
    t = _SAYS["treatment"]
    at = f"[o_orderkey % {len(t)} + 1]"
    parts.append(f"SELECT o_orderkey, 'treatment_status', {_sql_list([x.split(': ', 1)[1] for x in t])}{at}, {_sql_list(_STATUS)}{at}, CASE WHEN o_orderkey % 5 = 2 THEN 0.7 ELSE 0.95 END::double, {_sql_list(t)}{at} FROM orders")
    parts.append("SELECT o_orderkey, 'sex', 'F', 'female', 0.95::double, 'sex: F' FROM orders WHERE o_orderkey % 4 = 3")
    return "SELECT o_orderkey, attr, value_raw, value_norm, confidence, evidence FROM (" + " UNION ALL ".join(parts) + ") WHERE attr IS NOT NULL"


@query("extract_attrs", _stated_sql())
def _(t):
    return K.extract_attrs(stated(t), "o_orderkey").select("o_orderkey", "attr", "value_raw", "value_norm", "confidence", "evidence")


@query("unplaced_values", """
SELECT o_orderkey, 'tissue' AS attr, 'tissue' AS pair_key, 'fossil' AS value_raw, 'tissue: fossil' AS evidence FROM orders WHERE o_orderkey % 6 = 3
UNION ALL SELECT o_orderkey, 'tissue', 'region', 'R1', 'region: R1' FROM orders WHERE o_orderkey % 6 = 5
UNION ALL SELECT o_orderkey, 'disease', 'disease', 'Gout', 'disease: Gout' FROM orders WHERE o_orderkey % 7 = 2
UNION ALL SELECT o_orderkey, 'treatment', 'drug', '10 nM Drug', 'drug: 10 nM Drug' FROM orders WHERE o_orderkey % 5 = 2
UNION ALL SELECT o_orderkey, 'sex', 'sex', 'hermaphrodite', 'sex: hermaphrodite' FROM orders WHERE o_orderkey % 4 = 3
UNION ALL SELECT o_orderkey, 'ancestry', 'ancestry', 'Martian', 'ancestry: Martian' FROM orders WHERE o_orderkey % 3 = 2""")
def _(t):
    return K.unplaced_values(stated(t), "o_orderkey")


@query("unmapped_pairs", "SELECT o_orderkey, 'smoker' AS pair_key, 'yes' AS value_raw, 'smoker: yes' AS evidence FROM orders")
def _(t):
    return K.unmapped_pairs(stated(t), "o_orderkey")


_FORMS = ["{n} years", "{n}-99 weeks", "E{n}", "P{n}", "{n}", "{n} years 6 months", "about {n} mo", "x{n}"]


def _age_text():
    n = F.col("p_size").cast("string")
    spelled = (F.concat(F.lit(f.split("{n}")[0]), n, F.lit(f.split("{n}")[1])) for f in _FORMS)
    return F.element_at(F.array(*spelled), (F.col("p_partkey") % 8 + 1).cast("int"))


def ages(t: Tables):
    return t.part.select("p_partkey", K.parse_age(_age_text(), F.lit("age"), F.col("p_brand") == "Brand#1").alias("a"))


_AGES = """(SELECT p_partkey, CASE p_partkey % 8 WHEN 7 THEN NULL WHEN 1 THEN round((p_size + 99) / 2.0::double, 2) WHEN 5 THEN round(p_size + 0.5::double, 2) ELSE p_size::double END AS num,
  CASE p_partkey % 8 WHEN 0 THEN 'years' WHEN 1 THEN 'weeks' WHEN 2 THEN 'E-days' WHEN 3 THEN 'postnatal days' WHEN 4 THEN CASE WHEN p_brand = 'Brand#1' THEN 'years' END WHEN 5 THEN 'years' WHEN 6 THEN 'months' END AS unit,
  CASE p_partkey % 8 WHEN 7 THEN NULL WHEN 4 THEN CASE WHEN p_brand = 'Brand#1' THEN 0.75::double ELSE 0.7 END ELSE 0.95 END AS confidence FROM part)"""


@query("parse_age", f"SELECT p_partkey, num, unit, confidence FROM {_AGES}")
def _(t):
    return ages(t).select("p_partkey", "a.num", "a.unit", "a.confidence")


@query("parse_timepoint", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 0 WHEN 3 THEN p_size END::double AS num, CASE p_partkey % 5 WHEN 0 THEN 'days' WHEN 1 THEN 'hours' WHEN 3 THEN 'weeks' END AS unit,
  CASE p_partkey % 5 WHEN 1 THEN 0.9 WHEN 4 THEN NULL ELSE 0.95 END::double AS confidence FROM part""")
def _(t):
    n = F.col("p_size").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("Day "), n), F.concat(F.lit("after "), n, F.lit(" hrs")), F.lit("baseline"), n, F.lit("later")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", K.parse_timepoint(text, F.lit("time in weeks")).alias("a")).select("p_partkey", "a.num", "a.unit", "a.confidence")


@query("to_years", f"""
WITH y AS (SELECT p_partkey, CASE unit WHEN 'years' THEN num WHEN 'months' THEN num / 12 WHEN 'weeks' THEN num / 52.18::double END AS y FROM {_AGES})
SELECT p_partkey, round(y, 6) AS years, CASE WHEN y < 18 THEN 'pediatric' WHEN y >= 65 THEN 'aged' WHEN y IS NOT NULL THEN 'adult' END AS stage FROM y""")
def _(t):
    years = K.to_years(F.col("a.num"), F.col("a.unit"))
    return ages(t).select("p_partkey", F.round(years, 6).alias("years"), K.life_stage(years).alias("stage"))


def _lexicon(name, norm, values):
    """Query and SQL of one list over spellings picked by a part's key; the expected forms
    are written out beside them."""
    asked = [v for v, _, _ in values]
    at = f"[p_partkey % {len(values)} + 1]"
    flags = ", ".join("NULL" if p is None else str(p).lower() for _, _, p in values)

    @query(f"norm_{name}", f"SELECT p_partkey, {_sql_list([n for _, n, _ in values])}{at} AS norm, [{flags}]{at} AS placed FROM part")
    def _(t):
        text = F.element_at(F.array(*map(F.lit, asked)), (F.col("p_partkey") % len(values) + 1).cast("int"))
        return t.part.select("p_partkey", norm(text).alias("x")).select("p_partkey", "x.norm", "x.placed")


_lexicon("sex", K.norm_sex, [(" Female ", "female", True), ("xy", "male", True), ("N/A", None, None), ("both", "mixed", True), ("♀", "female", True), ("male, female", "mixed", True), ("Hermaphrodite", None, False)])
_lexicon("treatment", K.norm_treatment, [("DMSO", "DMSO", True), ("untreated", "none", True), ("10 nM  Drug", "10 nM Drug", False), ("Sham", "sham", True), ("saline", "saline", True), ("placebo.", "placebo", True), ("naïve", "none", True), ("Mock-infected", "mock-infected", True)])
_lexicon("ancestry", K.norm_ancestry, [("White", "white", True), ("European", "white", True), ("Korean", "asian", True), ("Han Chinese", "asian", True), ("African American", "black or african american", True), ("unknown", None, None), ("Latino", "hispanic or latino", True), ("Inuit", "Inuit", False)])
_lexicon("disease", K.norm_disease, [("DM: no; HTN: none", "healthy", True), ("COVID-19", "covid-19", True), ("Gout", "Gout", False), ("Control", "healthy", True), ("Alzheimers disease (AD)", "alzheimer's disease", True), ("SLE", "systemic lupus erythematosus", True), ("PDAC", "pancreatic cancer", True), ("not reported", None, None), ("DM: no; HTN: yes", "DM: no; HTN: yes", False)])
_lexicon("sample_type", K.norm_sample_type, [("Biopsy", "primary tissue", True), ("organoids", "organoid", True), ("swab", "swab", False), ("patient-derived xenograft", "pdx", True), ("Tumour", None, None), ("iPSC-derived", "ipsc derived", True)])


_TYPED = [
    # pairs, tissue type, kind, tumour sample type, line
    ("tissue: Lung;; age: 55", "tissue", "primary", None, None),
    ("cell line: K562;; tissue: bone marrow", "cell line", "cell_line", None, "CVCL_0004"),
    ("cell line: H9;; cell type: neurons", "cell line", "stem_cell", None, "CVCL_9773"),
    ("cell line: H9;; tissue: cerebral organoid", "organoid", "organoid", None, "CVCL_9773"),
    ("tissue: tumor;; cell line: K562;; cell type: CD45+", "tissue", None, "tumor", "CVCL_0004"),
    ("cell line: K562;; cell type: leukemia tumor cell line", "cell line", "cell_line", None, "CVCL_0004"),
    ("tissue: esophagus;; cell line: H9;; organoid: HEO", "organoid", "organoid", None, "CVCL_9773"),
    ("cell line: C57BL/6;; tissue: spleen", "tissue", "primary", None, None),
    ("tissue: tumor;; group: O-PDX", "tissue", "xenograft", "tumor", None),
    ("cell type: cultured fibroblasts;; tissue: skin", "primary cell culture", "primary", None, None),
    ("tissue: lung;; treatment: culture medium", None, None, None, None),
    ("tissue: liver;; tissue type: adjacent normal tissue", "tissue", "primary", "adjacent normal", None),
    ("tissue: liver;; tissue type: metastasis", "tissue", "primary", "metastatic", None),
    ("tissue: liver;; tissue type: pre-metastatic liver", "tissue", "primary", None, None),
    ("organism: Homo sapiens;; time: 6h", None, None, None, None),
    ("cell type: iPSC-derived neurons", "cell line", "stem_cell", None, None),
]
_LINES = [("k562", "CVCL_0004", "Cancer cell line"), ("h9", "CVCL_9773", "Embryonic stem cell"), ("c57bl/6", "CVCL_C0MU", "Transformed cell line")]


def typed_pairs(t: Tables):
    text = F.element_at(F.array(*(F.lit(p) for p, *_ in _TYPED)), (F.col("o_orderkey") % len(_TYPED) + 1).cast("int"))
    return K.parse_pairs(t.orders.select("o_orderkey", text.alias("pairs")), "o_orderkey", "pairs")


@query("classify_sample_type", "SELECT o_orderkey, " + ", ".join(f"{_sql_list([row[i] for row in _TYPED])}[o_orderkey % {len(_TYPED)} + 1] AS {name}" for i, name in ((1, "tissue_type"), (2, "sample_kind"), (3, "tumor_sample_type"), (4, "cell_line"))) + " FROM orders")
def _(t):
    lines = t.spark.createDataFrame(_LINES, "name string, accession string, category string")
    return K.classify_sample_type(typed_pairs(t), "o_orderkey", lines).drop("evidence")


_ILL = [
    ("disease state: Healthy donor", "healthy", "healthy donor", 0.95),
    ("group: healthy controls", "healthy", "healthy controls", 0.95),
    ("disease state: control", "healthy", "control", 0.85),
    ("group: control", None, None, None),
    ("subject status: Parkinson's disease (PD) patient", "disease", "parkinson's disease", 0.9),
    ("disease state: severe COVID-19", "disease", "covid-19", 0.9),
    ("group: late;; diagnosis: asthma patients", "disease", "asthma", 0.9),
    ("treatment: cisplatin", None, None, None),
]


@query("disease_candidate", "SELECT * FROM (SELECT o_orderkey, " + ", ".join(f"{_sql_list([row[i] for row in _ILL])}[o_orderkey % {len(_ILL)} + 1]{cast} AS {name}" for i, name, cast in ((1, "kind", ""), (2, "disease", ""), (3, "confidence", "::double"))) + " FROM orders) WHERE kind IS NOT NULL")
def _(t):
    text = F.element_at(F.array(*(F.lit(p) for p, *_ in _ILL)), (F.col("o_orderkey") % len(_ILL) + 1).cast("int"))
    pairs = K.parse_pairs(t.orders.select("o_orderkey", text.alias("pairs")), "o_orderkey", "pairs")
    return K.disease_candidate(pairs, "o_orderkey", F.lit(True))


@query("evidence_holds", r"SELECT doc_id, contains(trim(regexp_replace(text, '\s+', ' ', 'g')), 'the the') AS holds FROM documents")
def _(t):
    return t.documents.select("doc_id", K.evidence_holds(F.lit("the \n the"), F.col("text")).alias("holds"))


def part_words(t: Tables):
    return t.part.select("p_partkey", F.concat(F.element_at(F.split("p_name", " "), 2), F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("value"))


_WORDS = "(SELECT DISTINCT split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS value FROM part)"
_NAMES = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in NAMES) + ") l(name, term_id, tier)"
_MAPPED = f"""m AS (SELECT value, name, term_id, tier, form FROM (SELECT value, value AS name, 0 AS form FROM {_WORDS} UNION ALL SELECT value, regexp_replace(value, 'es$', ''), 2 FROM {_WORDS} WHERE value LIKE '%es' UNION ALL SELECT value, regexp_replace(value, 's$', ''), 3 FROM {_WORDS} WHERE value LIKE '%s' AND value NOT LIKE '%ss') JOIN {_NAMES} USING (name)),
b AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY form > 0, tier) AS r FROM m)"""


def mapped(t: Tables):
    labels = t.spark.createDataFrame(NAMES, "name string, term_id string, tier int")
    return K.map_to_ontology(part_words(t), labels, "value")


@query("map_to_ontology", f"""
WITH {_MAPPED} SELECT w.value, b.term_id, CASE WHEN b.term_id IS NOT NULL THEN ['id', 'alias', 'label', 'synonym'][tier + 1] || CASE WHEN form > 0 THEN '+variant' ELSE '' END END AS method, CASE WHEN b.term_id IS NULL THEN NULL WHEN form > 0 THEN 0.8 WHEN tier <= 2 THEN 1.0 ELSE 0.9 END::double AS confidence
FROM {_WORDS} w LEFT JOIN b ON w.value = b.value AND r = 1""")
def _(t):
    return mapped(t)


@query("review_queue", f"""
WITH {_MAPPED} SELECT value, count(DISTINCT p_partkey) AS n_samples FROM (SELECT p_partkey, split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS value FROM part)
WHERE value NOT IN (SELECT value FROM b) AND value <> 'lever' GROUP BY 1""")
def _(t):
    return K.review_queue(part_words(t), mapped(t), t.spark.createDataFrame([("lever",)], "value string"), "value", "p_partkey")


STAGES = [("any", 0.0, None), ("infant", 0.0, 730.5), ("child", 730.5, 6574.5), ("adult", 6574.5, None), ("young", 6574.5, 10957.5)]


@query("age_to_stage", f"""
WITH y AS (SELECT p_partkey, CASE unit WHEN 'years' THEN num WHEN 'months' THEN num / 12 WHEN 'weeks' THEN num / 52.18::double END * 365.25 AS d FROM {_AGES})
SELECT p_partkey, CASE WHEN d < 730.5 THEN 'infant' WHEN d < 6574.5 THEN 'child' WHEN d < 10957.5 THEN 'young' WHEN d IS NOT NULL THEN 'any' END AS stage FROM y""")
def _(t):
    return ages(t).select("p_partkey", K.age_to_stage(F.col("a.num"), F.col("a.unit"), STAGES).alias("stage"))


@query("backfill_groups", """
SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN 'Other' END, 'Other'), CASE WHEN p_name LIKE '%bolt%' THEN 'fastener' WHEN p_name LIKE '%red%' THEN 'red' END, CASE WHEN p_brand LIKE '%#1%' THEN 'brand one' END, CASE WHEN p_partkey % 3 = 1 THEN 'Other' END) AS grp FROM part""")
def _(t):
    rows = t.part.withColumn("grp", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, "Other"))
    rules = [("bolt", "fastener"), ("red", "red"), ("brand#1", "brand one")]
    return K.backfill_groups(rows, "grp", [F.col("p_name"), F.col("p_brand")], rules, "Other").select("p_partkey", "grp")


_ORG = {"homo sapiens": "human", "mus musculus": "mouse"}


@query("norm_organism", "SELECT o_orderkey, ['human', 'mouse', 'Danio rerio'][o_orderkey % 3 + 1] AS organism FROM orders")
def _(t):
    text = F.element_at(F.array(*map(F.lit, ["Virus; Homo sapiens", "Mus musculus,Homo sapiens", "Danio rerio | X"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t.orders.select("o_orderkey", K.norm_organism(text, _ORG).alias("organism"))


@query("build_species", "SELECT o_orderkey, ['human', 'mouse', 'human|mouse', ''][o_orderkey % 4 + 1] AS species FROM orders")
def _(t):
    build = F.element_at(F.array(*map(F.lit, ["GRCh38", "mm10", "GRCh38_and_mm10", "danRer11"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", F.array_join(K.build_species(build), "|").alias("species"))


@query("norm_label", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(split_part(text, chr(10), 1)), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[''’`]', '', 'g'), '[^a-z0-9+]+', ' ', 'g')) AS label FROM documents""")
def _(t):
    return t.documents.select("doc_id", K.norm_label(F.split("text", "\n", 2)[0]).alias("label"))


@query("canonical_id", "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 'UBERON:' || lpad(p_partkey::varchar, 7, '0') END AS id FROM part")
def _(t):
    n = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    text = F.element_at(F.array(F.concat(F.lit("UBERON_"), n), F.concat(F.lit("http://x.org/obo/UBERON_"), n), F.concat(F.lit(" uberon:"), n), F.concat(F.lit("lung "), n)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", K.canonical_id(text, ["UBERON", "CL"]).alias("id"))


@query("platform_label", "SELECT o_orderkey, ['10x 3'' v3 snRNA-seq', 'Visium spatial', NULL, 'Smart-seq2 scRNA-seq'][o_orderkey % 4 + 1] AS label FROM orders")
def _(t):
    k = (F.col("o_orderkey") % 4 + 1).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), k)
    label = K.platform_label(pick("10x_v3", "Visium HD", "x", "ss2"), pick("10x 3'", "Spatial", "Unknown", "Smart-seq2"), pick("snRNA", "other", "scRNA", "scRNA"))
    return t.orders.select("o_orderkey", label.alias("label"))


@query("cells_label", "SELECT o_orderkey, [NULL, '812', '1.2k', '46k', '250k', '3.5M', '12M'][o_orderkey % 7 + 1] AS label FROM orders")
def _(t):
    n = F.element_at(F.array(*map(F.lit, [0, 812, 1234, 46499, 251999, 3456789, 12345678])), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return t.orders.select("o_orderkey", K.cells_label(n).alias("label"))


@query("normalise_modality", "SELECT o_orderkey, ['scRNA', 'snRNA', 'Spatial', NULL, 'odd'][o_orderkey % 5 + 1] AS modality FROM orders")
def _(t):
    k = (F.col("o_orderkey") % 5 + 1).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), k)
    return t.orders.select("o_orderkey", K.normalise_modality(pick("scRNA-seq", "Single Nucleus", "scRNA", "spatial", "odd"), pick("10x", "10x", "Spatial", "10x", "10x")).alias("modality"))


@query("json_list", "SELECT event_id, [json_extract_string(props, '$.k') || '|b', json_extract_string(props, '$.k') || '|c', ''][event_id % 3 + 1] AS items FROM events")
def _(t):
    k = F.get_json_object("props", "$.k")
    text = F.element_at(F.array(F.concat(F.lit('["'), k, F.lit('", "b"]')), F.concat(k, F.lit(" ; c,")), F.lit(" ")), (F.col("event_id") % 3 + 1).cast("int"))
    return t.events.select("event_id", F.array_join(K.json_list(text), "|").alias("items"))


@query("lateral_json", "SELECT event_id, unnest([json_extract_string(props, '$.k'), event_type]) AS element FROM events")
def _(t):
    text = F.concat(F.lit('["'), F.get_json_object("props", "$.k"), F.lit('","'), "event_type", F.lit('"]'))
    return K.lateral_json(t.events.select("event_id", text.alias("j")), "event_id", "j")


@query("zero_as_missing", "SELECT l_orderkey, nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount FROM lineitem")
def _(t):
    return K.zero_as_missing(t.lineitem.select("l_orderkey", "l_tax", "l_discount"), ["l_tax", "l_discount"])


@query("first_member", """
WITH f AS (SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey),
o AS (SELECT l_suppkey, m.modality, p_type, place FROM f JOIN (VALUES ('small', 'SMALL', 1), ('small', 'MEDIUM', 2), ('big', 'LARGE', 1), ('big', 'PROMO', 2)) m(modality, file, place) ON file = p_type WHERE modality = 'small' OR l_suppkey % 2 = 0)
SELECT l_suppkey, modality, arg_min(p_type, place) AS file FROM o GROUP BY ALL""")
def _(t):
    files = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", "p_type").distinct()
    return K.first_member(files, "l_suppkey", "p_type", {"small": ["SMALL", "MEDIUM"], "big": ["LARGE", "PROMO"]}, F.col("l_suppkey") % 2 == 0, ["big"])
