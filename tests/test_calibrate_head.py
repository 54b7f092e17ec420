import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.operators.calibrate import (
    apply_calibration, calibration_report, fit_platt, load_calibrator, platt_coefficients, save_calibrator,
    transform_with_model,
)
from labelforge.operators.head import pos_weight, train_head


def _newton(x, y, n):
    """L2 (C = 1, intercept free) logistic fit by Newton's method."""
    w = np.zeros(2)
    X = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ w))
        g = X.T @ (p - y) + np.array([w[0], 0.0])
        H = X.T @ (X * (p * (1 - p))[:, None]) + np.diag([1.0, 0.0])
        w -= np.linalg.solve(H, g)
    return w


def _data(n=200, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.6 * x + 0.4)))).astype(int)
    return x, y


def test_platt_matches_newton(spark, tmp_dir):
    x, y = _data()
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "logit double, label int")
    model = fit_platt(df)
    slope, intercept = platt_coefficients(model)
    ws, wi = _newton(x, y.astype(float), len(x))
    assert slope == pytest.approx(ws, abs=1e-5) and intercept == pytest.approx(wi, abs=1e-5)
    rep = calibration_report(df, model).first()
    assert rep.brier_cal <= rep.brier_raw + 1e-9
    # the closed form and the saved pipeline agree
    a = [r.probability_cal for r in apply_calibration(df, model).orderBy("logit").collect()]
    path = tmp_dir + "/calib"
    save_calibrator(model, path)
    loaded = load_calibrator(path)
    b = [r.probability_cal for r in transform_with_model(df, loaded).orderBy("logit").collect()]
    assert a == pytest.approx(b, abs=1e-9)


def test_calibrator_fallback(spark, tmp_dir):
    with pytest.warns(UserWarning):
        assert load_calibrator(tmp_dir + "/missing") is None
    df = spark.createDataFrame([(0.0,)], "logit double")
    assert apply_calibration(df, None).first().probability_cal == 0.5


def test_pos_weight(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert pos_weight(df).first().pos_weight == 3.0
    with pytest.raises(Exception):
        pos_weight(spark.createDataFrame([(0,)], "label int")).collect()


def test_train_head_on_embeddings(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("filename"), "embedding",
        (F.col("label") < 5).cast("int").alias("label"))
    out = train_head(emb, epochs=(1, 5)).collect()
    assert len(out) == 2 and sum(r.is_best for r in out) == 1
    best = [r for r in out if r.is_best][0]
    assert best.test_accuracy is not None and 0.0 <= best.test_accuracy <= 1.0


def test_train_head_separable_fixture(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y = i % 2
        v = rng.normal(0, 0.1, 4)
        v[0] += 3.0 if y else -3.0
        rows.append((f"k{i}", [float(x) for x in v], y))
    df = spark.createDataFrame(rows, "filename string, embedding array<double>, label int")
    out = {r.epoch: r for r in train_head(df, epochs=(1, 5, 20)).collect()}
    best = [r for r in out.values() if r.is_best]
    assert len(best) == 1 and best[0].val_accuracy == 1.0 and best[0].test_accuracy == 1.0
    # earliest epoch wins a tie
    assert best[0].epoch == min(e for e, r in out.items() if r.val_accuracy == 1.0)
