"""Thresholds, menus and patterns that define the results. Not tuned per table."""

# -- detectors
SENTINEL_MIN_ROWS = 20
SENTINEL_MIN_PCT = 0.05
MAX_SPIKE_SHARE = 0.20
SPIKE_RATIO = 5.0
MAGIC_NEGATIVES = (-1, -9, -99, -999, -9999)
MIN_DISTINCT = 12
SPIKE_NEIGHBOURS = 10
FAR_FRACTION = 0.5
UNIT_FACTORS = (12, 100, 1000)
UNIT_MIN_GAP_RATIO = 1.5
UNIT_MIN_ROWS = 20
UNIT_MIN_POSITIVES = 200
UNIT_MIN_SHARE, UNIT_MAX_SHARE = 0.01, 0.50
UNIT_FACTOR_TOL = 0.25
UNIT_MIN_DISTINCT_HI = 5
UNIT_LOW_SLACK, UNIT_HIGH_SLACK = 0.9, 1.1
NORM_KEY_PATTERN = "[^a-z0-9]"
NINES_PATTERN = "^9{2,}$"

# -- repair menu, in menu order
OPERATION_MENU = (
    "fill_mean", "fill_median", "fill_mode", "drop_rows", "clip_outliers", "fill_unknown",
    "normalize_categories", "sentinel_to_median", "rescale_units", "dedupe_rows",
)
NUMERIC_ONLY_OPS = ("fill_mean", "fill_median", "clip_outliers", "sentinel_to_median", "rescale_units")
TEXT_ONLY_OPS = ("normalize_categories",)
ROW_OPS = ("drop_rows", "dedupe_rows")
MISSING_OPS = ("fill_mean", "fill_median", "fill_mode", "fill_unknown", "drop_rows")
UNKNOWN_LABEL = "Unknown"
IQR_FENCE = 1.5

# -- planning
DEFECT_PRIORITY = {"sentinel": 0, "mixed_units": 1, "category_variants": 2,
                   "duplicates": 3, "missing": 4, "top_coded": 5}
OTHER_DEFECT_PRIORITY = 9

# -- evaluation and gate
CV_FOLDS = 5
CV_REPEATS = 3
TEST_SIZE = 0.2
ALPHA = 0.05
MAX_ITERATIONS = 16
MIN_STAGE_GAIN_FRAC = 0.25
RANDOM_STATE = 42
CI_LEVEL = 0.975

# -- study
PILOT_FRAC = 0.20
MDE_Z = 0.84
RECOVERY_EPS = 1e-9
UNIT_RESTORE_TOL = 0.5

# -- task validation
TASK_TYPES = ("binary", "multiclass", "regression")
MODEL_FAMILIES = ("linear", "tree_ensemble", "distance", "neural")
MAX_MISSING_FRAC = 0.40
MAX_ONEHOT_LEVELS = 300
ID_DISTINCT_SHARE = 0.98
ID_MIN_ROWS = 50
ID_NAME_PATTERN = r"(?i)(^|[_\s.-])(id|uuid|guid|index|idx)$|^(id|uuid|guid)([_\s.-]|$)"
MISSING_MARKS = ("?", "")
DISTINCT_CAP = 60

# -- preprocessing recommender
SKEW_LIMIT = 1.0
HIGH_CARD = 15
MISSING_INFORMATIVE = 0.05
IMBALANCE_RATIO = 0.25
PROBABILITY_GATES = ("brier",)
MISSING_LEVEL = "__missing__"
FALLBACK_SE = 2.0
NUM_IMPUTE = ("median", "mean", "median+indicator")
CAT_IMPUTE = ("most_frequent", "constant_missing")
ENCODINGS = ("onehot", "onehot_capped", "ordinal")
SCALINGS = ("none", "standard", "robust", "yeo_johnson")
KNN_NEIGHBOURS = 5
