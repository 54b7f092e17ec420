"""Platt calibration of logits (I5, I6) and calibrator persistence (K5).

The fit is Spark ML ``LogisticRegression`` on one feature with the library
defaults of the reference's fit translated: L2 with C = 1 over n rows is
``regParam = 1/n``, no standardisation, intercept not penalised.  The fit is
distributed (``treeAggregate`` per iteration); no rows reach the driver.
"""

from __future__ import annotations

import warnings

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from labelforge.functions.labels import sigmoid
from labelforge.operators.metrics import accuracy_at, brier_score


def fit_platt(df: DataFrame, logit: str = "logit", label: str = "label", n_rows: int | None = None,
              max_iter: int = 100, tol: float = 1e-10) -> PipelineModel:
    """Fit P(label = 1 | logit)."""
    n = n_rows if n_rows is not None else df.count()
    if n == 0:
        raise ValueError("no rows to calibrate on")
    data = df.select(F.col(logit).cast("double").alias("__lf_x"), F.col(label).cast("double").alias("__lf_y"))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=["__lf_x"], outputCol="__lf_features"),
        LogisticRegression(featuresCol="__lf_features", labelCol="__lf_y", regParam=1.0 / n,
                           elasticNetParam=0.0, standardization=False, fitIntercept=True,
                           maxIter=max_iter, tol=tol),
    ])
    return pipe.fit(data)


def platt_coefficients(model: PipelineModel) -> tuple[float, float]:
    lr = model.stages[-1]
    return float(lr.coefficients[0]), float(lr.intercept)


def apply_calibration(df: DataFrame, model: PipelineModel | None, logit: str = "logit",
                      out: str = "probability_cal") -> DataFrame:
    """Calibrated P(1) when a model is given, else the plain sigmoid."""
    if model is None:
        return df.withColumn(out, sigmoid(logit))
    slope, intercept = platt_coefficients(model)
    # a one-feature logistic model is a closed form: stay in native expressions
    z = F.lit(slope) * F.col(logit).cast("double") + F.lit(intercept)
    return df.withColumn(out, sigmoid(z))


def calibration_report(df: DataFrame, model: PipelineModel, logit: str = "logit",
                       label: str = "label") -> DataFrame:
    """E6 + E7 raw and calibrated, with the fitted coefficients, one row."""
    slope, intercept = platt_coefficients(model)
    scored = apply_calibration(df.withColumn("__lf_raw", sigmoid(logit)), model, logit, "__lf_cal")
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(slope).alias("slope"),
        F.lit(intercept).alias("intercept"),
        brier_score("__lf_raw", label).alias("brier_raw"),
        brier_score("__lf_cal", label).alias("brier_cal"),
        accuracy_at("__lf_raw", label).alias("acc_raw"),
        accuracy_at("__lf_cal", label).alias("acc_cal"),
    )


def transform_with_model(df: DataFrame, model: PipelineModel, logit: str = "logit",
                         out: str = "probability_cal") -> DataFrame:
    """I5 through the saved pipeline itself (``vector_to_array(probability)[1]``)."""
    data = df.withColumn("__lf_x", F.col(logit).cast("double"))
    scored = model.transform(data)
    return (scored.withColumn(out, vector_to_array("probability")[1])
            .drop("__lf_x", "__lf_features", "rawPrediction", "probability", "prediction"))


def save_calibrator(model: PipelineModel, path: str) -> None:
    """K5: persist (overwrite)."""
    model.write().overwrite().save(path)


def load_calibrator(path: str) -> PipelineModel | None:
    """K5: load; on absence or failure warn and return None (raw sigmoid)."""
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # noqa: BLE001 - documented fallback
        warnings.warn(f"could not load calibrator ({exc}); falling back to raw sigmoid", stacklevel=2)
        return None
