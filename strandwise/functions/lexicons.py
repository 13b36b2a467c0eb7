"""Closed lists of the fact rules, plain: what is spelled how.

All of this is data whose values are fixed by the catalogue's conventions; the code that
uses it is in ``strandwise.operators.facts`` and ``strandwise.operators.text``.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values: missing and healthy

MISSING = (
    "", "n/a", "na", "null", "unknown", "not applicable", "not available", "not determined", "-", "--", "nan", "?",
    "not specified", "unspecified", "not reported",
)

HEALTHY = (
    "healthy", "healthy control", "healthy controls", "healthy donor", "healthy donors", "healthy volunteer", "normal",
    "control", "controls", "non-diseased", "nondiseased", "no disease", "none", "not diseased", "unaffected", "ctrl", "hc",
    "normal control", "health", "healthy individual", "healthy adult",
)

# ---------------------------------------------------------------- fixed values: sex, treatment, ancestry

SEX = {
    "male": ("m", "male", "man", "men", "boy", "♂", "xy", "male (xy)", "males"),
    "female": ("f", "female", "woman", "women", "girl", "♀", "xx", "female (xx)", "females"),
    "mixed": ("mixed", "both", "male and female", "female and male", "male/female", "female/male", "pooled", "mixed sex", "male, female", "female, male"),
}

UNTREATED = (
    "none", "untreated", "no treatment", "no", "naive", "naïve", "unstimulated", "baseline", "not treated", "nil", "n/a none",
    "control untreated", "no drug", "non-treated", "nontreated", "untreated control",
)

VEHICLE = (
    "vehicle", "pbs", "dmso", "saline", "mock", "sham", "vehicle control", "water", "placebo", "mock infected",
    "mock-infected", "mock treated", "control vehicle", "veh", "nacl",
)

ANCESTRY = {
    "white": ("white", "caucasian", "european", "european american", "non-hispanic white"),
    "black or african american": ("black", "african american", "african", "black or african american"),
    "asian": ("asian", "east asian", "chinese", "han chinese", "japanese", "korean", "south asian"),
    "hispanic or latino": ("hispanic", "latino", "hispanic or latino", "hispanic/latino"),
}

# ---------------------------------------------------------------- fixed values: diseases

DISEASES = {
    "alzheimer's disease": ("alzheimer's disease", "alzheimer disease", "alzheimers disease", "alzheimer's"),
    "parkinson's disease": ("parkinson's disease", "parkinson disease", "parkinsons disease", "idiopathic parkinson's disease (ipd)", "idiopathic parkinson's disease"),
    "covid-19": ("covid-19", "covid19", "covid", "sars-cov-2", "sars-cov-2 infection", "covid-19 patient"),
    "type 2 diabetes": ("type 2 diabetes", "t2d", "t2dm", "type ii diabetes", "type 2 diabetes mellitus"),
    "type 1 diabetes": ("type 1 diabetes", "t1d", "t1dm", "type i diabetes"),
    "obesity": ("obesity",),
    "crohn's disease": ("crohn's disease", "crohn disease", "crohns disease"),
    "ulcerative colitis": ("ulcerative colitis",),
    "inflammatory bowel disease": ("inflammatory bowel disease", "ibd"),
    "rheumatoid arthritis": ("rheumatoid arthritis",),
    "systemic lupus erythematosus": ("systemic lupus erythematosus", "sle", "lupus"),
    "multiple sclerosis": ("multiple sclerosis",),
    "asthma": ("asthma",),
    "copd": ("copd", "chronic obstructive pulmonary disease"),
    "idiopathic pulmonary fibrosis": ("idiopathic pulmonary fibrosis", "ipf", "pulmonary fibrosis"),
    "cystic fibrosis": ("cystic fibrosis",),
    "psoriasis": ("psoriasis",),
    "atopic dermatitis": ("atopic dermatitis", "eczema"),
    "sepsis": ("sepsis",),
    "tuberculosis": ("tuberculosis",),
    "hiv": ("hiv", "hiv infection", "hiv-1 infection"),
    "influenza": ("influenza", "influenza infection"),
    "breast cancer": ("breast cancer",),
    "lung cancer": ("lung cancer",),
    "colorectal cancer": ("colorectal cancer", "colon cancer"),
    "pancreatic cancer": ("pancreatic cancer", "pdac"),
    "prostate cancer": ("prostate cancer",),
    "ovarian cancer": ("ovarian cancer",),
    "liver cancer": ("liver cancer", "hepatocellular carcinoma", "hcc"),
    "glioblastoma": ("glioblastoma", "gbm"),
    "melanoma": ("melanoma",),
    "leukemia": ("leukemia", "leukaemia"),
    "lymphoma": ("lymphoma",),
    "cancer": ("cancer", "tumor", "tumour"),
}

# ---------------------------------------------------------------- fixed values: tissues and cell types

TISSUES = (
    "blood", "peripheral blood", "whole blood", "pbmc", "pbmcs", "peripheral blood mononuclear cells", "peripheral blood mononuclear cell", "pb",
    "bone marrow", "bm", "bone marrow aspirate",
    "cord blood", "umbilical cord blood",
    "spleen",
    "thymus",
    "lymph node", "lymph nodes", "peripheral lymph nodes", "lymphnode", "mesenteric lymph node", "inguinal lymph node", "draining lymph node",
    "tonsil",
    "brain", "whole brain", "cerebrum",
    "cortex", "cerebral cortex", "neocortex", "prefrontal cortex", "frontal cortex", "visual cortex", "motor cortex",
    "hippocampus",
    "cerebellum",
    "hypothalamus",
    "striatum", "dorsal striatum",
    "thalamus",
    "midbrain",
    "spinal cord",
    "retina",
    "eye", "cornea", "choroid",
    "heart", "cardiac", "left ventricle", "heart left ventricle", "right ventricle", "left atrium", "right atrium", "ventricle", "atrium",
    "aorta",
    "artery", "arteries",
    "vein",
    "lung", "lungs", "lung parenchyma", "trachea", "airway", "bronchus", "bronchoalveolar lavage", "bal", "bronchoalveolar lavage fluid", "balf",
    "nasal epithelium", "nasal mucosa",
    "liver",
    "pancreas",
    "pancreatic islet", "islet", "islets", "pancreatic islets",
    "kidney", "kidney cortex", "renal cortex", "renal medulla", "kidney medulla",
    "bladder",
    "stomach",
    "small intestine", "ileum", "jejunum", "duodenum",
    "large intestine", "colon", "rectum", "cecum", "caecum", "sigmoid colon",
    "intestine", "gut",
    "esophagus", "oesophagus",
    "skin", "epidermis", "dermis",
    "scalp",
    "adipose", "adipose tissue", "fat", "white adipose tissue", "subcutaneous adipose tissue", "visceral adipose tissue", "brown adipose tissue", "omentum", "epididymal fat", "perigonadal adipose tissue",
    "skeletal muscle", "muscle", "quadriceps", "tibialis anterior", "gastrocnemius", "soleus", "diaphragm",
    "bone", "femur", "tibia", "cartilage", "synovium", "synovial tissue", "joint",
    "tooth", "dental pulp", "gingiva", "oral mucosa", "tongue", "salivary gland",
    "breast", "mammary gland", "mammary fat pad",
    "prostate",
    "testis", "testes", "testicle",
    "ovary", "ovaries",
    "uterus", "endometrium", "myometrium", "cervix", "vagina", "fallopian tube",
    "placenta", "decidua", "chorionic villi",
    "embryo", "whole embryo",
    "yolk sac",
    "thyroid",
    "adrenal gland", "adrenal", "adrenal cortex",
    "pituitary", "pituitary gland",
    "inner ear", "cochlea", "utricle",
    "fetal liver", "fetal kidney", "fetal lung", "fetal brain", "fetal heart",
    "tumor", "tumour",
)

#: Spellings that become one label; other tissues keep their own.
TISSUE_LABELS = {
    "pbmc": ("pbmcs", "peripheral blood mononuclear cells", "peripheral blood mononuclear cell"),
    "esophagus": ("oesophagus",),
    "testis": ("testes", "testicle"),
    "ovary": ("ovaries",),
    "artery": ("arteries",),
    "lung": ("lungs",),
    "tumor": ("tumour",),
    "lymph node": ("lymph nodes", "lymphnode"),
    "pancreatic islet": ("islets", "islet", "pancreatic islets"),
}

CELL_TYPES = {
    "t cell": ("t cell", "t cells", "t lymphocyte", "t lymphocytes", "t-cell", "t-cells"),
    "cd4 t cell": ("cd4 t cell", "cd4+ t cell", "cd4+ t cells", "cd4 t cells", "cd4+ t-cells", "cd4+ t lymphocytes", "cd4 t"),
    "cd8 t cell": ("cd8 t cell", "cd8+ t cell", "cd8+ t cells", "cd8 t cells", "cd8+ t-cells", "cd8 t"),
    "regulatory t cell": ("regulatory t cell", "treg", "tregs", "regulatory t cells"),
    "b cell": ("b cell", "b cells", "b lymphocyte", "b lymphocytes", "b-cell", "b-cells"),
    "plasma cell": ("plasma cell", "plasma cells"),
    "nk cell": ("nk cell", "nk cells", "natural killer cell", "natural killer cells"),
    "monocyte": ("monocyte", "monocytes", "cd14+ monocytes"),
    "macrophage": ("macrophage", "macrophages", "alveolar macrophage", "alveolar macrophages"),
    "neutrophil": ("neutrophil", "neutrophils"),
    "dendritic cell": ("dendritic cell", "dendritic cells", "dc", "dcs"),
    "mast cell": ("mast cell", "mast cells"),
    "eosinophil": ("eosinophil", "eosinophils"),
    "microglia": ("microglia",),
    "astrocyte": ("astrocyte", "astrocytes"),
    "oligodendrocyte": ("oligodendrocyte", "oligodendrocytes"),
    "neuron": ("neuron", "neurons"),
    "fibroblast": ("fibroblast", "fibroblasts"),
    "endothelial cell": ("endothelial cell", "endothelial cells"),
    "epithelial cell": ("epithelial cell", "epithelial cells", "epithelia cell", "epithelia cells"),
    "hepatocyte": ("hepatocyte", "hepatocytes"),
    "adipocyte": ("adipocyte", "adipocytes"),
    "cardiomyocyte": ("cardiomyocyte", "cardiomyocytes"),
    "hematopoietic stem cell": ("hematopoietic stem cell", "hematopoietic stem cells", "hsc", "hscs", "hspc", "hspcs", "cd34+ cells", "cd34+"),
    "immune cell": ("immune cell", "immune cells", "cd45+ cells", "cd45+", "leukocytes", "leukocyte"),
    "pbmc": ("pbmc", "pbmcs", "peripheral blood mononuclear cells"),
    "nuclei": ("nuclei", "all nuclei", "single nuclei"),
}

# ---------------------------------------------------------------- fixed values: units and life stages

UNITS = {
    "y": "years", "yr": "years", "yrs": "years", "year": "years", "years": "years", "yo": "years", "y.o.": "years", "years old": "years", "year old": "years",
    "mo": "months", "mos": "months", "month": "months", "months": "months", "m": "months",
    "w": "weeks", "wk": "weeks", "wks": "weeks", "week": "weeks", "weeks": "weeks",
    "d": "days", "day": "days", "days": "days", "dpi": "days", "div": "days", "dpt": "days",
    "h": "hours", "hr": "hours", "hrs": "hours", "hour": "hours", "hours": "hours", "hpi": "hours",
    "min": "minutes", "mins": "minutes", "minute": "minutes", "minutes": "minutes",
    "pcw": "pcw", "gw": "pcw",
}

LIFE_STAGES = {
    "embryonic": ("embryonic", "embryo"),
    "fetal": ("fetal", "foetal"),
    "neonatal": ("neonatal", "newborn", "neonate"),
    "pediatric": ("pediatric", "paediatric", "child", "juvenile", "infant"),
    "adult": ("adult",),
    "aged": ("aged", "elderly"),
}

# ---------------------------------------------------------------- fixed values: ages and times

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
UNIT = "(" + "|".join(u.replace(".", r"\.") for u in sorted(UNITS, key=len, reverse=True)) + ")"
PER_YEAR = {"years": 1.0, "months": 12.0, "weeks": 52.18, "days": 365.25}

#: Words of a key that give the unit of its values; of several the last counts.
KEY_UNITS = {
    "hours": "hours?|hrs?|hpi",
    "days": "days?|div|dpi|dpt",
    "weeks": "weeks?",
    "months": "months?",
    "years": "years?|yrs?",
}

#: What is dropped around an age, in this order: pattern and what takes its place.
AGE_TRIMS = (
    (r"\s*\(.*?\)\s*", " "),
    (r"^(post ?natal|approximately|approx\.?|about|around|~)\s*", ""),
    (r"[-\s]*old$", ""),
    (rf"^{NUMBER}-(?=[a-z])", "$1 "),
)

# Forms of a value, the first that matches counts: ``norm`` names groups of the pattern,
# ``amounts`` are groups with their divisors, added up; the unit is fixed (``unit``), read
# from a group, or the key's. ``sure`` is the confidence with a unit, ``bare`` without.
EMBRYONIC_DAY = rf"^e\s*{NUMBER}$"
AGE_FORMS = (
    {"pattern": rf"^{NUMBER}\s*(?:yrs?|years?)\s*{NUMBER}\s*(?:mos?|months?)$", "norm": "{1} years {2} months", "amounts": ((1, 1), (2, 12)), "unit": "years", "sure": 0.95},
    {"pattern": EMBRYONIC_DAY, "norm": "E{1}", "amounts": ((1, 1),), "unit": "E-days", "sure": 0.95},
    {"pattern": rf"^p\s*{NUMBER}$", "norm": "P{1}", "amounts": ((1, 1),), "unit": "postnatal days", "sure": 0.95},
    {"pattern": rf"^{NUMBER}\s*(?:-|–|to)\s*{NUMBER}[\s-]*{UNIT}?$", "norm": "{1}-{2}", "amounts": ((1, 2), (2, 2)), "rising": (1, 2), "unit_group": 3, "unit_of_key": True, "sure": 0.95, "bare": 0.7},
    {"pattern": rf"^{NUMBER}\s*{UNIT}?$", "norm": "{1}", "amounts": ((1, 1),), "unit_group": 2, "unit_of_key": True, "sure": 0.95, "bare": 0.7, "human": {"most": 110, "unit": "years", "sure": 0.75}},
)
TIMEPOINT_FORMS = (
    {"pattern": "^(baseline|pre-?treatment|pre|before treatment|t0)$", "norm": "baseline", "amounts": (), "sure": 0.95, "bare": 0.95},
    {"pattern": rf"^(day|d|week|wk|w|hour|hr|h|month|div)\s*{NUMBER}$", "norm": "{2}", "amounts": ((2, 1),), "unit_group": 1, "unit_else": "days", "sure": 0.95},
    {"pattern": rf"(?:^|[^a-z0-9.]){NUMBER}\s*{UNIT}(?![a-z])", "norm": "{1}", "amounts": ((1, 1),), "unit_group": 2, "sure": 0.9},
    {"pattern": rf"^{NUMBER}$", "norm": "{1}", "amounts": ((1, 1),), "unit_of_key": True, "sure": 0.95, "bare": 0.7},
)

# ---------------------------------------------------------------- fixed values: answers and flags

#: Under a key with the word, these answers name a disease.
ANSWER_KEY = "covid"
ANSWERS = {
    "covid-19": "^(positive|pos|infected|covid|covid 19|case|patient|severe|moderate|mild|critical)",
    "healthy": "^(negative|neg|control|healthy|uninfected|non covid|noncovid)",
}
NEGATIVE_ANSWER = "^[a-z0-9 /-]{1,30}:\\s*(no|none|negative)$"
TUMOR_FLAG = "^(tumou?r|cancer|malignant)$"
NORMAL_FLAG = "^(normal|adjacent normal|normal adjacent|non-?tumou?r|benign)$"
NO_LINE_VALUES = "^(primary|none|no|not applicable|n/a|-)"
VAGUE_CELLS = "^(all( cells| nuclei)?|various|mixed( population)?|live( cells?)?|single cell suspension|single cells?|cells?|total( cells)?|whole|unsorted|unfractionated|bulk)$"
WILD_TYPE = r"^(wild[ -]?type|wt|wildtype|\+/\+|wt/wt|control wt|wild type control)$"

#: What is dropped around the name of a tissue, in this order.
TISSUE_TRIMS = (
    "^(human|mouse|murine|rat|mus musculus|homo sapiens|whole|fresh|frozen) ",
    "^(human|mouse|murine|rat) ",
)
TISSUE_ENDINGS = " (tissue|tissues|sample|samples)$"

#: Health in words.
HEALTHY_PHRASE = (
    "^(healthy|healthy (control|controls|donor|donors|volunteer|volunteers|individual|individuals|subject|subjects|adult|adults|human donor|control subject|participant)|"
    "normal (donor|donors|control|controls|individual|subject|volunteer)|non[- ]?diseased|no disease|unaffected|healthy non[- ].*disease)$"
)
NO_DISEASE_VALUES = "^(n/?a|na|none|unknown|not applicable|not available|-|nan)$"
BARE_CONTROL = "^(control|controls|ctrl|normal|hc|nc)$"
#: What is dropped around the name of a disease, in this order.
DISEASE_TRIMS = (
    "^(patients? with|individuals? with|donors? with|subjects? with|diagnosed with) +",
    " +(patients?|donors?|subjects?|cases?|individuals?|positive)$",
    r"^(severe|mild|moderate|critical|acute|active|established|newly diagnosed) +(?=covid|sepsis|tb\b)",
    r"\s*\(([^)]*)\)\s*$",
)

# ---------------------------------------------------------------- fixed values: keys

#: Keys that name an attribute (patterns for whole keys), in order of precedence.
ATTRIBUTE_KEYS = {
    "tissue": (
        "tissue", "tissue type", "tissue source", "tissue origin", "tissue region", "tissue sampled", "source tissue", "sample tissue", "organ", "organ type", "tissue organ",
        "tissue/cell source", "tissue/cell type", "anatomical site", "anatomic site", "anatomical region", "body site", "biopsy site", "brain region", "tissue site", "region",
    ),
    "sample_type": ("sample type", "biomaterial type", "material type", "cell line", "cell lines", "cell line name", "cell line source", "cell type line"),
    "cell_type_sorted": (
        "cell type", "celltype", "cell types", "cell population", "sorted population", "sorted cell type", "sort", "cell/nuclei type", "cell nuclei type", "cell subtype", "cell lineage",
        "cell type sorted", "facs population", "facs gate", "sorted by", "cell fraction", "cell subset",
    ),
    "disease": (
        "disease", "disease state", "disease status", "disease type", "diagnosis", "clinical diagnosis", "health state", "health status", "covid status", "covid 19 status", "covid19 status",
        "clinical status", "pathology", "disease condition", "disease group status",
    ),
    "treatment": (
        "treatment", "treatments", "treated with", "agent", "stimulation", "stimulus", "stimulated with", "stimulation condition", "drug", "drug treatment", "compound", "perturbation",
        "infection", "infection status", "exposure", "diet", "intervention", "treatment group", "treatment condition", "vaccine", "vaccination", "inhibitor", "medication", "therapy",
    ),
    "timepoint": (
        "time", "time point", "timepoint", "time points", "timepoints", "days of differentiation", "day of differentiation", "induction day", "treatment duration", "treatment time",
        "duration of treatment", "div", "dpi", "hpi", "dpt", "day", "days", "hours", "hour", "time after .*", "time post .*", "days post .*", "hours post .*", "days after .*", "hours after .*",
        "days in vitro", "differentiation day", "differentiation time", "time of collection", "collection time", "time since .*", "stage day",
    ),
    "genotype": (
        "genotype", "genotype/variation", "strain", "mouse strain", "strain background", "genetic background", "background", "mutation", "genetic modification", "transgene", "knockout",
        "variation", "genotype/strain", "strain/genotype",
    ),
    "age": (
        "age", "age at death", "age of human", "age at sampling", "age at collection", "donor age", "age years", "age yrs", "age in years", r"age \(.*\)", "age at surgery", "age at biopsy",
        "age weeks", "age days", "age months", "mouse age", "age of mice", "age of donor",
    ),
    "life_stage": ("developmental stage", "dev stage", "life stage", "developmental age", "stage of development", "embryonic stage", "gestational age", "fetal age"),
    "sex": ("sex", "gender", "sex of donor", "donor sex", "sex of origin", r"sex \(.*\)", r"gender \(.*\)", "sex gender", "biological sex", "donor gender", "patient sex", "patient gender"),
    "ancestry": (
        "race", "ethnicity", "ancestry", "ethnic group", "race/ethnicity", "donor ethnicity", "self reported ethnicity", "ethnic background", "donor race", "patient race", "self reported race",
    ),
    "donor": (
        "donor", "donor id", "donor name", "donor number", "subject", "subject id", "subject name", "patient", "patient id", "patient number", "patient name", "individual", "individual id",
        "participant", "participant id", "animal id", "animal", "mouse id", "mouse", "case id", "specimen donor",
    ),
}

#: Keys that never carry biology.
NOISE_KEYS = (
    "batch", "lane", "barcode", "10x barcode", "library", "library type", "library id", "sample", "sample id", "sample name", "name", "id", "index", "run", "well", "hto", "tag", "link", "lab",
    "source", "description", "assay", "genome build", "cells loaded", "pooled", "experiment", "replicate", "rep", "plate", "chip", "channel", "sequencing batch", "molecule subtype",
    "subcellular fraction term name", "biosample encode accession", "processing batch", "collection date", "colon operation date", "cdna", "chemistry", "platform", "instrument", "contact",
    "submitter",
)

#: Longest value that still is a label.
LONGEST_LABEL = {"tissue": 48, "cell_type_sorted": 48, "disease": 48, "treatment": 48, "genotype": 60, "ancestry": 40, "sample_type": 48}
LONGEST_VALUE = 120

# ---------------------------------------------------------------- fixed values: sample types

LINE_KEYS = ("cell line", "cell line name", "cellline", "cell lines", "parental cell line", "cell line background")
TYPE_KEYS = (
    "source", "tissue", "tissue type", "sample type", "cell type", "cell line", "sample source", "biomaterial", "specimen", "specimen type",
    "material", "model", "culture", "culture type", "sample", "origin", "organ", "biosample type", "sample origin", "growth protocol",
)
TUMOR_KEYS = (
    "source", "tissue", "tissue type", "sample type", "condition", "group", "disease state", "sample", "site", "specimen type", "tumor type", "tumour type", "sample site", "tissue status",
    "tumor status", "tumour status", "sample status", "lesion", "pathology", "tissue origin", "tissue source",
)
IN_VIVO_KEYS = ("tissue", "source", "cell type", "treatment", "sample type", "tissue type", "in vitro or in vivo", "model", "condition", "group")

TYPE_WORDS = {
    "primary tissue": ("tissue", "primary tissue", "primary", "biopsy", "primary cells", "primary cell"),
    "cell line": ("cell line", "immortalized cell line"),
    "organoid": ("organoid", "organoids"),
    "pdx": ("pdx", "patient derived xenograft", "patient-derived xenograft"),
    "ipsc derived": ("ipsc", "ipsc derived", "ipsc-derived", "ipsc derived cells"),
}

# Patterns of kinds of samples.
ORGANOID = r"(?i)\b(organoids?|assembloids?|gastruloids?|embryoid bod(?:y|ies)|tumou?roids?|enteroids?|colonoids?|blastoids?)\b"
XENOGRAFT = r"(?i)\b(xenografts?|pdx|cdx|o-pdx|pdox|patient[- ]derived xenografts?)\b"
STEM = r"(?i)\b(h?ipscs?|i ?ps cells?|h?escs?|h?pscs?|pluripotent|embryonic stem)\b"
DERIVED = r"(?i)\b(derived|differentiated|differentiation)\b"
CULTURE = (
    r"(?i)\b(primary (?:cell )?cultures?|cultured primary|primary cultured|in vitro cultured|ex vivo cultured|"
    r"cultured (?:cells|fibroblasts|keratinocytes|hepatocytes|myoblasts|astrocytes|neurons|chondrocytes|osteoblasts|t cells|macrophages|monocytes))\b"
)
LINE = r"(?i)\bcell ?lines?\b"
NO_LINE = r"(?i)\bprimary\b|\bnot? (a )?cell line\b|\bnon[- ]cell line\b"
STRAIN = (
    r"(?i)^(c57 ?bl[/ ]?6\w*|c57bl\w*|b6\w*|balb[/ ]?c\w*|129\S*|fvb\S*|dba\S*|cd-?1|nod\S*|nsg\S*|nu/nu|nude|c3h\S*|swiss\S*|sprague[- ]dawley|wistar\S*|"
    r"wild[- ]?type|wt|wt/wt|\+/\+|mixed background)$"
)
IN_VIVO = r"(?i)\b(tumou?rs?|xenografts?|allografts?|injected|implanted|transplanted|engrafted|orthotopic|subcutaneous(?:ly)?|in vivo|tumou?r[- ]bearing)\b"
CULTURE_WORD = r"(?i)\bcultur(e|ed|es|ing)\b|\bin vitro\b|\bdifferentiat"
TUMOR_TYPES = (
    (
        "adjacent normal",
        r"adjacent|adjacent normal|normal adjacent|adjacent normal tissue|normal adjacent tissue|adjacent non[- ]?tumou?r|adjacent non[- ]?tumou?r tissue|adjacent tissue|"
        r"para[- ]?tumou?r|para[- ]?tumou?r tissue|para[- ]?cancerous( tissue)?|peritumou?ral( tissue)?|non[- ]?tumou?r adjacent tissue|tumou?r[- ]adjacent normal( tissue)?|"
        r"normal tissue adjacent to (the )?tumou?r|adjacent normal mucosa|matched normal adjacent tissue",
    ),
    ("metastatic", r"metastas[ie]s|metastatic|metastatic (tumou?r|tissue|lesion|sample|site)|(lymph node|liver|brain|bone|lung|peritoneal|omental) metastas[ie]s|metastatic (lymph node|liver|brain|bone|lung)"),
    ("recurrent tumor", r"recurren(t|ce)|recurrent tumou?r|relapsed? tumou?r"),
    ("primary tumor", r"primary tumou?r( tissue| sample)?"),
    ("tumor", r"tumou?rs?|tumou?r tissue|tumou?r sample|tumou?r core|cancer tissue|cancerous tissue|malignant tissue|tumou?r region|tumou?r fraction"),
)
ORGANOID_KEY = "^organoids?( type| line| model)?$"
NO_ORGANOID = "(?i)^(no|none|n/?a|false|0)$"
STEM_CATEGORY = "(?i)stem cell"
IN_VITRO = r"(?i)\bin vitro\b"
NOT_METASTATIC = r"\b(pre|non)[- ]?metasta"

DISEASE_KEYS = (
    "disease", "disease state", "disease status", "diagnosis", "clinical diagnosis", "health state", "health status", "disease type",
    "pathology", "disease condition", "clinical status", "patient status", "donor status", "subject status", "subject group",
    "disease group", "covid status", "covid 19 status", "infection status", "infection", "clinical condition", "primary diagnosis",
    "patient diagnosis", "donor diagnosis", "histological diagnosis", "pathological diagnosis", "cancer type", "tumor type", "tumour type",
)
GENERIC_KEYS = ("condition", "group", "phenotype", "status", "cohort", "patient group", "sample group", "subject", "donor", "individual", "patient", "category", "class")

# ---------------------------------------------------------------- fixed values: words of text search

STOPWORDS = (
    "a", "an", "the", "of", "in", "on", "at", "for", "to", "from", "with", "and", "or", "by", "is", "are", "was", "were", "be", "as", "that", "this", "these", "those", "into", "its",
    "their", "using", "via", "vs", "versus", "about", "over", "under", "after", "before", "during", "between", "within", "without", "show", "find", "me", "all",
    "any", "some", "studies", "study", "datasets", "dataset", "data",
)

SYNONYMS = {
    "aging": ("aging", "ageing", "aged", "old", "age", "elderly"),
    "ageing": ("aging", "ageing", "aged", "old", "age", "elderly"),
    "aged": ("aged", "aging", "ageing", "old", "age"),
    "old": ("old", "aged", "aging", "ageing"),
    "young": ("young", "juvenile", "adolescent"),
    "tumor": ("tumor", "tumour", "tumors", "tumours"),
    "tumour": ("tumor", "tumour", "tumors", "tumours"),
    "tumors": ("tumor", "tumour", "tumors", "tumours"),
    "cancer": ("cancer", "carcinoma", "tumor", "tumour", "malignant"),
    "knockout": ("knockout", "ko", "null", "deficient"),
    "ko": ("ko", "knockout"),
    "wildtype": ("wildtype", "wt", "wild type"),
    "wt": ("wt", "wildtype", "wild type"),
    "fetal": ("fetal", "foetal", "fetus", "foetus", "embryonic"),
    "foetal": ("fetal", "foetal", "fetus", "foetus", "embryonic"),
    "leukemia": ("leukemia", "leukaemia"),
    "leukaemia": ("leukemia", "leukaemia"),
    "hematopoietic": ("hematopoietic", "haematopoietic"),
    "haematopoietic": ("hematopoietic", "haematopoietic"),
    "esophagus": ("esophagus", "oesophagus", "esophageal", "oesophageal"),
    "oesophagus": ("esophagus", "oesophagus", "esophageal", "oesophageal"),
    "pediatric": ("pediatric", "paediatric", "children", "child"),
    "paediatric": ("pediatric", "paediatric", "children", "child"),
    "infant": ("infant", "neonatal", "neonate", "newborn"),
    "neonatal": ("neonatal", "neonate", "newborn", "infant"),
    "covid": ("covid", "sars cov 2", "coronavirus"),
    "obese": ("obese", "obesity", "high fat diet", "hfd"),
    "obesity": ("obese", "obesity", "high fat diet", "hfd"),
    "hfd": ("hfd", "high fat diet"),
    "diabetic": ("diabetic", "diabetes", "db db", "stz"),
    "diabetes": ("diabetic", "diabetes", "db db", "stz"),
    "stroke": ("stroke", "ischemia", "ischaemia", "mcao"),
    "ischemia": ("ischemia", "ischaemia", "ischemic", "ischaemic"),
    "sepsis": ("sepsis", "septic", "lps", "endotoxin"),
    "lps": ("lps", "lipopolysaccharide", "endotoxin"),
    "fibrosis": ("fibrosis", "fibrotic", "bleomycin", "ccl4"),
    "scrnaseq": ("scrnaseq", "scrna seq", "single cell rna seq"),
    "snrnaseq": ("snrnaseq", "snrna seq", "single nucleus", "single nuclei", "nuclei"),
    "nuclei": ("nuclei", "nucleus", "snrna seq", "snrnaseq"),
    "organoid": ("organoid", "organoids", "spheroid", "spheroids"),
    "organoids": ("organoid", "organoids", "spheroid", "spheroids"),
    "ad": ("ad", "alzheimer", "alzheimers", "alzheimer disease"),
    "alzheimer": ("alzheimer", "alzheimers", "alzheimer disease", "ad"),
    "pbmc": ("pbmc", "pbmcs", "peripheral blood mononuclear cell", "peripheral blood mononuclear cells"),
    "t cell": ("t cell", "t cells", "t-cell", "t-cells", "lymphocyte"),
    "xenograft": ("xenograft", "pdx", "xenografts"),
    "pdx": ("pdx", "xenograft"),
    "metastasis": ("metastasis", "metastases", "metastatic"),
    "metastatic": ("metastasis", "metastases", "metastatic"),
}

# ---------------------------------------------------------------- variants of names
# Words and patterns that a value may carry besides the name of a term.

LEADING_WORDS = (
    "human", "homo sapiens", "mouse", "mice", "murine", "mus musculus", "primary", "whole", "fresh", "frozen", "normal", "healthy", "adult", "total", "isolated",
    "sorted", "facs sorted", "purified", "dissociated",
)
TRAILING_WORDS = (
    "tissues?", "samples?", "biops(?:y|ies)", "specimens?", "sections?", "organoids?", "from (?:human|mouse|mice|patients?|donors?)", "of (?:human|mouse|mice)",
)
#: (pattern, replacement) of names of any kind, and of cell types only, in order.
PLURALS = ((r"\bcells\b", "cell"), (r"(\w{3,}[^s])s$", "$1"), (r"(\w{3,})ies$", "$1y"))
CELL_FORMS = ((r"\bcells?\b$", ""), (r"\b(cd4|cd8) t cells?\b", "$1 positive alpha beta t cell"), (r"\b(cd\d+[a-z]?)\b", "$1 positive"))
BLOOD_WORDS = ("peripheral blood", "blood", "circulating")
CELL_MARKERS = (r"cd\d+[a-z]?", "lin", "epcam", "live")
MARKER_LEVELS = ("positive", "negative", "hi", "low")
#: Tier of a label: method and confidence of a value that is one, least letters of one.
LABEL_TIERS = (("label", 0.95, 0), ("exact_synonym", 0.9, 0), ("synonym", 0.75, 6))
