"""Fixed values of the data formats and the default analysis parameters."""

# Text formats.
COMMENT_PREFIX = "##"
MATRIX_ID_COLUMN = "gene_id"
FIELD_SEPARATOR = "\t"

# Sample classes kept for the two-group contrast.
CASE_LABEL = "Primary Tumor"
CONTROL_LABEL = "Solid Tissue Normal"

# Tissue of each cancer cohort, shared with the healthy cohorts.
DOMAIN_OF_COHORT = {
    "BRCA": "BREAST",
    "LUAD": "LUNG",
    "THCA": "THYROID",
    "PRAD": "PROSTATE",
    "COAD": "COLON",
    "KIRC": "KIDNEY",
}

# Trailing version of a feature id.
VERSION_PATTERN = r"\..*$"

# Group names of the long table.
CASE = "case"
CONTROL = "control"
BASELINE = "baseline"

# Thresholds and sizes of the analyses.
FEATURE_BUCKETS = 16
RESULT_BUCKETS = 64
CPM_SCALE = 1_000_000.0
MIN_CPM = 1.0
MIN_FRACTION = 0.20
MAX_FDR = 0.05
MIN_EFFECT = 1.0
SAFE_QUANTILE = 0.25
TOP_FEATURES = 2000
SVD_COMPONENTS = 50
TREES = 100
REDUCED_DEPTH = 10
FEATURE_DEPTH = 5
TRAIN_FRACTION = 0.7
SEED = 42
SCALING_FRACTIONS = (0.10, 0.25, 0.50, 0.75, 1.00)
CORPUS_ROWS = 750_000 * 63_856

# Smallest positive double: the floor under -log10(p).
P_FLOOR = 4.9e-324
