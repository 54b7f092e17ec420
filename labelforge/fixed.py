"""Fixed values.

These values must equal the reference's for equal results; they are stated
here once, in plain text, and imported by the operators.
"""

# --- fixed values (must match the reference) -------------------------------

# Prediction bands and the default uncertainty threshold.
BAND_TRUE = "TRUE"
BAND_FALSE = "FALSE"
BAND_UNSURE = "?"
UNCERTAINTY_THRESHOLD = 0.25
TRUE_TEXTS = ("TRUE", "True")
FALSE_TEXTS = ("FALSE", "False")

# Verdict classes, their display names and the fallback labels.
CLASS_NAMES = {1: "Coniferous", 2: "Deciduous", 3: "Bad"}
BAD_CLASS = 3
BAD_PARSE_LABEL = "bad_parse"
BAD_FETCH_LABEL = "bad"
FENCE_JSON = "```json"
FENCE = "```"

# Header of the labelled URL list (both names on one line mark a header).
HEADER_MARKERS = ("is_conifer", "downloadUrl")

# Focal loss.
FOCAL_ALPHA = 0.67
FOCAL_GAMMA = 2.0

# Image size and per-channel normalisation (RGB, after /255).
IMG_SIZE = 128
NORM_MEAN = (0.273, 0.337, 0.274)
NORM_STD = (0.131, 0.124, 0.108)

# Fetch timeouts in seconds: ingest, annotate / validate, folder download.
INGEST_TIMEOUT = 30
ANNOTATE_TIMEOUT = 5
DOWNLOAD_TIMEOUT = 10

# Batch sizes, fetch concurrency and the selection quota.
SCORE_BATCH = 32
ANNOTATE_BATCH = 8
FETCH_CONCURRENCY = 8
SELECT_TARGET = 3000

# Split presets and seed.
EVAL_FRACTIONS = (("train", 0.70), ("val", 0.15), ("test", 0.15))
TRAIN_FRACTIONS = (("train", 0.80), ("val", 0.18), ("test", 0.02))
SEED = 42

# Upscaling.
UPSCALE_FACTOR = 2
UPSCALE_METHODS = ("bilinear", "lanczos")

# Positional file names.
LABELLED_NAME_WIDTH = 3
URL_NAME_WIDTH = 6
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
