"""Fixed values that the results depend on."""

# Label binning and weights.
N_EDGES = 101
LAST_EDGE_PAD = 1e-6
INVERSE_COUNT_EPS = 1e-6
PREDICTION_LIMIT = 1e150

# Column names of the labelled feature table.
LABEL = "LinScore"
ALT_LABEL = "BinaryScore"
WEIGHT = "Weight"
ID_COLUMNS = ["Name", "Original_PFP_Pred_GO_term", "Updated_PFP_Pred_GO_term"]
FORCED_DOUBLE = ["Rank", "Out_of_Total"]
UNSCALED = [
    "AnnotationScore",
    "ProteinExistence",
    "Predicted_Ontology_F",
    "Predicted_Ontology_P",
    "Depth",
    "Total_Count",
]

# Down-sampling bands on the label.
LOW_BAND = 0.1
HIGH_BAND = 0.9

# Reasons reported with the best parameter set.
REASON_SINGLE = "single best answer by r2/mse"
REASON_TIE_DEFAULT = "2+ best params, with default"
REASON_TIE_FIRST = "2+ best params, without default"
REASON_NONE = "no valid run"
DEFAULT_KEY_SUFFIX = "hp_0"

# Network training rules.
EARLY_STOP_MIN_DELTA = 1e-6
EARLY_STOP_PATIENCE = 10
PLATEAU_FACTOR = 0.5
PLATEAU_PATIENCE = 10
PLATEAU_MIN_DELTA = 1e-4
PLATEAU_MIN_LR = 1e-6
FUNNEL_START = 256
FUNNEL_END = 8
FUNNEL_STEP = 8
EXPLICIT_WIDTHS_MAX_LAYERS = 9
GRADIENT_SAMPLE_ROWS = 1024

# Prediction agreement (absolute and relative tolerance).
CLOSE_ATOL = 1e-6
CLOSE_RTOL = 1e-5

# Share of grid keys drawn by a random search.
RANDOM_SHARE = {"random_forest": 0.1, "svr": 0.198}

# Default grid row of the penalised linear models.
LINEAR_DEFAULTS = {
    "eta0": 0.001,
    "batch_size": 32,
    "epochs": 1000,
    "tol": 0.001,
    "learning_rate": "constant",
    "n_iter_no_change": 5,
    "l1_ratio": 0.15,
}
LINEAR_DEFAULT_ALPHA = {"mb_SGD": 0.0, "lasso": 0.0001, "ridge": 0.0001, "elasticnet": 0.0001}

# Lists crossed by the penalised linear grid.
LINEAR_LISTS = {
    "eta0": [0.00001, 0.0001, 0.001],
    "batch_size": [32, 128, 256],
    "tol": [0.0001, 0.001, 0.01],
    "epochs": [1000],
    "learning_rate": ["adaptive", "constant"],
    "n_iter_no_change": [5],
}
ELASTIC_L1_RATIOS = [0.1, 0.5, 0.9]
PENALTY_RATIO = {"mb_SGD": 0.0, "ols": 0.0, "lasso": 1.0, "ridge": 0.0}

# Ranges of the wide boosted-tree search (name, low, high, log, integer).
BOOSTED_SPACE = [
    ("max_depth", 1.0, 30.0, False, True),
    ("min_child_weight", 1e-5, 10.0, True, False),
    ("gamma", 0.0, 10.0, False, False),
    ("lambda", 1e-5, 10.0, True, False),
    ("alpha", 1e-5, 10.0, True, False),
    ("learning_rate", 1e-5, 1.0, True, False),
    ("n_estimators", 50.0, 5000.0, False, True),
    ("subsample", 0.1, 1.0, False, False),
    ("colsample_bytree", 0.1, 1.0, False, False),
    ("colsample_bylevel", 0.1, 1.0, False, False),
    ("colsample_bynode", 0.1, 1.0, False, False),
    ("scale_pos_weight", 1e-2, 10.0, True, False),
    ("max_delta_step", 0.0, 10.0, False, False),
]
BOOSTED_PATIENCE = 50
