"""Explicit schemas of the engine's tables.

Readers never infer types: a predictions file without ``?`` would otherwise
be read as booleans and one with ``?`` as text.
"""

from pyspark.sql import types as T

LABELS = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("label", T.StringType()),  # cast by to_int_label (may arrive as "1.0")
])

FUSED_LABELS = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("final_label", T.IntegerType()),
])

PREDICTIONS = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("logit", T.DoubleType()),
])

EPOCH_METRICS = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("val_acc", T.DoubleType()),
])

SCORED_BATCHES = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("batch", T.IntegerType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("logit", T.DoubleType()),
    T.StructField("label", T.IntegerType()),
])

PREDICTION_COLUMNS = ["filename", "prediction", "probability", "logit"]
