"""Linear classification head on an embedding column.

The reference fine-tunes a linear head on image-backbone features and keeps
the epoch with the best validation accuracy.  Re-aimed: a logistic head on a
feature column, trained by full-batch gradient steps of a fixed rate from zero.
Every step is one pass in which each task sums the gradient of its rows with
numpy; the sums of the tasks (one number for each feature) are added by Spark.
One run is read at several steps ("epochs"); the best on the validation rows
(earliest on ties, accuracy above 0) is kept and its test accuracy reported.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelforge.operators.metrics import accuracy_at, best_epoch
from labelforge.operators.split import TRAIN_FRACTIONS, stratified_split
from labelforge.session import materialize

EPOCHS = (1, 2, 5, 10, 20)
RATE = 1.0


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives / positives as one row; fails when either is 0."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return counts.select(
        F.when(F.col("pos") == 0, F.raise_error(F.lit("no positive samples")))
        .when(F.col("neg") == 0, F.raise_error(F.lit("no negative samples")))
        .otherwise(F.col("neg") / F.col("pos")).alias("pos_weight"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, with a last feature of 1 (the intercept)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def _gradient(train: DataFrame, weights: np.ndarray, positive: float) -> np.ndarray:
    """Mean gradient of the (weighted) logistic loss over all rows."""

    def run(batches):
        total, n = np.zeros(len(weights)), 0
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                p = 1 / (1 + np.exp(-(x @ weights)))
                total += ((p - y) * np.where(y == 1, positive, 1.0)) @ x
                n += batch.num_rows
        if n:
            yield pa.record_batch({"i": pa.array([*range(len(total)), -1], pa.int32()), "g": pa.array([*total, float(n)])})

    sums = dict(train.select("x", "y").mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g")).collect())
    n = sums.pop(-1, 0.0)
    return np.array([sums[i] for i in range(len(weights))]) / n if n else np.zeros(len(weights))


def _scored(rows: DataFrame, models: dict[int, np.ndarray]) -> DataFrame:
    """(split, y, p_<epoch>): the probability of every row by every model."""
    names = [f"p_{e}" for e in models]
    weights = np.stack(list(models.values()), 1)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = 1 / (1 + np.exp(-(_matrix(batch.column(2)) @ weights)))
                yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(p[:, i]) for i in range(len(names))]],
                                      names=["split", "y", *names])

    return rows.select("split", "y", "x").mapInArrow(run, ", ".join(["split string, y double", *[f"{c} double" for c in names]]))


def train_head(df: DataFrame, key: str = "filename", features: str = "embedding", label: str = "label",
               epochs: Sequence[int] = EPOCHS, seed: int = 42, rate: float = RATE, weighted: bool = False) -> DataFrame:
    """One row per epoch read: ``epoch, val_accuracy, is_best, test_accuracy``
    (test accuracy only on the best row).  ``weighted`` gives positives the
    weight of B23."""
    data = df.select(key, F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    # keys, labels and hashes are ranked; the features join the finished split
    parts = stratified_split(data.select(key, "y").distinct(), key=key, label="y", fractions=TRAIN_FRACTIONS, seed=seed)
    split = materialize(data.join(parts, [key, "y"]).select("split", "y", "x"))
    train = split.filter(F.col("split") == "train")
    positive = 1.0
    if weighted:
        positive = float(pos_weight(train.withColumn("label", F.col("y").cast("int"))).first()["pos_weight"])
    size = train.select(F.max(F.size("x"))).first()[0] or 0
    weights, models = np.zeros(size + 1), {}
    for step in range(1, max(epochs) + 1):
        weights = weights - rate * _gradient(train, weights, positive)
        if step in epochs:
            models[int(step)] = weights
    held_out = _scored(split.filter(F.col("split").isin("val", "test")), models)
    of = lambda part, c: F.when(F.col("split") == part, F.col(c))
    scores = held_out.agg(*[accuracy_at(of(part, f"p_{e}"), of(part, "y")).alias(f"{part}_{e}")
                            for e in models for part in ("val", "test")]).first()
    spark = df.sparkSession
    table = spark.createDataFrame([(e, float(scores[f"val_{e}"] or 0.0), 0.0) for e in models],
                                  "epoch int, accuracy double, mean_loss double")
    best = best_epoch(table).first()["best_epoch"]
    out = [(e, float(scores[f"val_{e}"] or 0.0), e == best, scores[f"test_{e}"] if e == best else None)
           for e in sorted(models)]
    return spark.createDataFrame(out, "epoch int, val_accuracy double, is_best boolean, test_accuracy double")
