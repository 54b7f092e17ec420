import pytest

from labelforge.operators.metrics import (
    accuracy_at, best_epoch, binary_report, brier_score, classification_report, confusion_matrix,
    epoch_metrics, loss_summary, prediction_summary,
)


def test_binary_report_fixture(spark):
    preds = spark.createDataFrame([("a", "TRUE"), ("b", "TRUE"), ("c", "False"), ("d", "FALSE"), ("e", "?"),
                                   ("f", "maybe")], "filename string, prediction string")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("d", 1), ("e", 1), ("f", 0)],
                                   "filename string, label int")
    r = binary_report(preds, labels).first().asDict()
    assert (r["total"], r["confident_total"], r["uncertain_count"]) == (6, 4, 2)
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1)
    for k in ("accuracy", "precision", "recall", "f1"):
        assert r[k] == pytest.approx(0.5)
    assert r["coverage"] == pytest.approx(4 / 6)
    assert r["tp"] + r["fp"] + r["fn"] + r["tn"] + r["uncertain_count"] == r["total"]


def test_binary_report_no_overlap_gives_zeros(spark):
    preds = spark.createDataFrame([("a", "TRUE")], "filename string, prediction string")
    labels = spark.createDataFrame([("z", 1)], "filename string, label int")
    r = binary_report(preds, labels).collect()
    assert len(r) == 1 and r[0].total == 0 and r[0].accuracy == 0.0 and r[0].f1 == 0.0


def test_prediction_summary(spark):
    df = spark.createDataFrame([("TRUE",), ("TRUE",), ("FALSE",)], "prediction string")
    r = prediction_summary(df).first()
    assert (r.total, r.n_true, r.pct_true, r.n_false, r.n_uncertain, r.pct_uncertain) == (3, 2, 66.7, 1, 0, 0.0)


def test_brier_and_accuracy_fixture(spark):
    df = spark.createDataFrame([(0.9, 1), (0.4, 1), (0.5, 0)], "p double, y int")
    r = df.agg(brier_score("p", "y").alias("b"), accuracy_at("p", "y").alias("a")).first()
    assert r.b == pytest.approx(0.206667, abs=1e-6)
    assert r.a == pytest.approx(2 / 3)


def test_loss_summary(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 0)], "logit double, label int")
    r = loss_summary(df).first()
    assert r.mean_bce == pytest.approx(0.693147, abs=1e-6)
    assert r.mean_focal == pytest.approx(0.116102, abs=1e-6)
    assert r.sum_focal == pytest.approx(2 * 0.116102, abs=1e-5)


def test_matrix_and_report_fixture(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (2, 5)], "truth int, pred int")
    m = {r.truth: (r.pred_1, r.pred_2, r.pred_3) for r in confusion_matrix(df).collect()}
    assert m == {1: (1, 1, 0), 2: (0, 1, 1), 3: (0, 0, 0)}
    assert {r.truth: r.n_out_of_range for r in confusion_matrix(df).collect()} == {1: 0, 2: 1, 3: 0}
    rep = {r.class_name: r for r in classification_report(df).collect()}
    assert [rep[n].support for n in ("Coniferous", "Deciduous", "Bad")] == [2, 3, 0]
    assert rep["Coniferous"].precision == 1.0 and rep["Deciduous"].precision == 0.5
    assert rep["Bad"].precision == 0.0
    assert rep["Coniferous"].recall == 0.5 and rep["Deciduous"].recall == pytest.approx(1 / 3)
    # a prediction outside the list -> micro average instead of accuracy
    assert "micro avg" in rep and rep["micro avg"].precision == pytest.approx(2 / 4)
    assert rep["macro avg"].support == 5


def test_report_accuracy_row_when_all_in_list(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "truth int, pred int")
    rep = {r.class_name: r for r in classification_report(df).collect()}
    assert rep["accuracy"].f1 == pytest.approx(2 / 3) and rep["accuracy"].precision is None


def test_best_epoch_fixture(spark):
    em = spark.createDataFrame([(0, 0.7, 1.0), (1, 0.8, 0.9), (2, 0.8, 0.8), (3, 0.6, 0.7)],
                               "epoch int, accuracy double, mean_loss double")
    r = best_epoch(em).first()
    assert (r.best_epoch, r.best_loss) == (1, 0.9)
    zeros = spark.createDataFrame([(0, 0.0, 1.0), (1, 0.0, 1.0)], "epoch int, accuracy double, mean_loss double")
    assert best_epoch(zeros).first().best_epoch is None


def test_epoch_metrics_average_of_batches(spark):
    rows = [(0, 0, 1.0, True), (0, 0, 3.0, False), (0, 1, 10.0, True)]
    df = spark.createDataFrame(rows, "epoch int, batch int, loss double, correct boolean")
    r = epoch_metrics(df).first()
    assert r.mean_loss == pytest.approx((2.0 + 10.0) / 2)  # short batch weighs the same
    assert r.accuracy == pytest.approx(2 / 3)
