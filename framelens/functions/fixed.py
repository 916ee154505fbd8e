"""Fixed values. These must equal the published data formats for results to match."""

# --- fixed values: column and feature names -------------------------------------------------
PASSTHROUGH_COLUMNS = ("index", "episode_index", "task_index", "frame_index", "timestamp", "action")
DEFAULT_LABEL_PREFIX = "latent_labels"
FORBIDDEN_LABEL_PREFIX = "observation."
FEATURE_SUFFIXES = {
    "ids": ("codebook_id_latents", "codebook_ids"),
    "continuous": ("continuous_vector_latents", "continuous"),
    "codebook_vectors": ("codebook_vector_latents", "codebook_vectors"),
}
REQUIRED_ROLES = ("continuous", "valid", "action")
FLOATING_DTYPES = ("float16", "float32", "float64")

# --- fixed values: statistics ---------------------------------------------------------------
STAT_QUANTILES = {"q01": 0.01, "q10": 0.10, "q50": 0.50, "q90": 0.90, "q99": 0.99}
SUMMARY_QUANTILES = {"p01": 0.01, "p05": 0.05, "median": 0.50, "p95": 0.95, "p99": 0.99}
VARIANCE_FLOOR = 1e-12
NORM_PRODUCT_FLOOR = 1e-12
MSE_FLOOR = 1e-12
RATIO_FLOOR = 1e-12
MASS_SHARE = 0.8

# --- fixed values: latent formats -----------------------------------------------------------
FORMAT_REPRESENTATIONS = {
    "ids": "codebook_id_latents",
    "continuous": "continuous_vector_latents",
    "codebook_vectors": "codebook_vector_latents",
}
FORMAT_DISPLAY_NAMES = {
    "ids": "Reconstruction (IDs)",
    "continuous": "Reconstruction (Continuous)",
    "codebook_vectors": "Reconstruction (Codebook Vectors)",
}

# --- fixed values: ablation conditions ------------------------------------------------------
BASELINE_CONDITION = "normal"
CONDITION_COLUMNS = {
    "normal": "loss_normal",
    "hard_codebook": "loss_hard_codebook",
    "shuffled_action_tokens": "loss_shuffled_action_tokens",
    "zeroed_action_tokens": "loss_zeroed_action_tokens",
}
CONDITION_DESCRIPTIONS = {
    "normal": "Standard relaxed NSVQ reconstruction path.",
    "hard_codebook": "Hard nearest-codebook vectors decoded through the same decoder.",
    "shuffled_action_tokens": "Hard codebook action tokens batch-shuffled before decoding.",
    "zeroed_action_tokens": "Action tokens replaced with zeros before decoding.",
}

# --- fixed values: artifacts ----------------------------------------------------------------
ARTIFACT_SCHEMA_VERSION = 1
UNKNOWN_TOKEN = "unknown"
TOKEN_FORBIDDEN_PATTERN = "[^A-Za-z0-9._-]+"
TOKEN_EDGE_PATTERN = "^[._-]+|[._-]+$"
MANIFEST_PRIORITY = ("export_manifest.json", "label_manifest.json")
REGISTRY_RELATIVE_PATH = "analysis_registry/artifacts.jsonl"
LABEL_MODE_PARAMETERS = {
    "constant": ("constant_value",),
    "gaussian": ("mean", "std"),
    "uniform": ("low", "high"),
}
