"""Record layouts and fixed parameter values."""

from pyspark.sql import types as T

# Names, labels and thresholds that results depend on.
KEY = "eventID"
FEATURES = ["nswprice", "nswdemand", "vicprice", "vicdemand", "transfer"]
UP, DOWN = "UP", "DOWN"
KS_REFERENCE, KS_CURRENT, KS_ALPHA, KS_SEED = 1000, 336, 0.005, 42
EDDM_WARNING, EDDM_DRIFT, EDDM_MIN_ERRORS = 0.95, 0.90, 50
RETRAIN_ROWS = 2000
PAST_ROWS = 35000
TRAIN_SHARE, TRAIN_SEED = 0.8, 42

FEATURE_EVENT = T.StructType(
    [T.StructField(KEY, T.StringType())] + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)

LABEL_EVENT = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("label", T.StringType())])

# date, day and period stay text: as numbers they would lose zeros or turn into exponents.
RAW_CSV = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("date", "day", "period")]
    + [T.StructField(f, T.DoubleType()) for f in FEATURES]
    + [T.StructField("class", T.StringType())]
)

PREDICTION_COLUMNS = [
    KEY,
    *FEATURES,
    "predicted_label",
    "true_label",
    "prediction_time",
    "label_arrival_time",
    "model_version",
]

# Longest text allowed per column of the prediction table.
PREDICTION_WIDTHS = {KEY: 20, "predicted_label": 10, "true_label": 10, "model_version": 20}

REGISTRY = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("trained_at", T.TimestampType()),
        T.StructField("rows", T.LongType()),
    ]
)
