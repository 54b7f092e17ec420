"""Invariants of the catalogue queries on the driver's sf0.01 tables."""

import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_fusion_counts_add_up(spark, q):
    s = q["fusion_stats"](spark, SF).first()
    assert s.final + s.discarded == s.merged and s.positives + s.negatives == s.final
    assert q["label_fusion"](spark, SF).count() == s.final


def test_report_counts_add_up(spark, q):
    r = q["binary_report"](spark, SF).first()
    assert r.tp + r.fp + r.fn + r.tn + r.uncertain_count == r.total
    s = q["prediction_summary"](spark, SF).first()
    assert s.n_true + s.n_false + s.n_uncertain == s.total == r.total


def test_probability_is_sigmoid_of_logit(spark, q):
    for row in q["band_predictions"](spark, SF).collect():
        assert abs(row.probability - 1 / (1 + math.exp(-row.logit))) < 1e-5


def test_split_covers_everything(spark, q):
    sizes = {r.split: r.n_rows for r in q["split_sizes"](spark, SF).collect()}
    assert sum(sizes.values()) == q["band_predictions"](spark, SF).count()
    assert q["evaluate_split"](spark, SF).first().total == sizes["test"]


def test_matrix_rows_match_report_support(spark, q):
    m = {r.truth: r.pred_1 + r.pred_2 + r.pred_3 + r.n_out_of_range for r in q["confusion_matrix"](spark, SF).collect()}
    rep = {r.class_name: r.support for r in q["classification_report"](spark, SF).collect()}
    assert (m[1], m[2], m[3]) == (rep["Coniferous"], rep["Deciduous"], rep["Bad"])


def test_selection_sizes(spark, q):
    rows = q["select_uncertain"](spark, SF).collect()
    n_bad = sum(r.bucket == "bad" for r in rows)
    assert 0 < n_bad < len(rows)
    over = q["select_uncertain_overflow"](spark, SF).collect()
    assert all(r.bucket == "bad" for r in over) and len(over) == n_bad


def test_resume_counts(spark, q):
    s = q["resume_summary"](spark, SF).first()
    assert q["pending_urls"](spark, SF).count() == s.to_do <= s.total
    assert q["batch_annotate"](spark, SF).count() == s.to_do
