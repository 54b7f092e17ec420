"""Evaluation aggregates.

Every report is one aggregation pass (``count_if`` / ``avg`` with map-side
partial aggregation) followed by a one-row projection, so the only data
movement is the partial-aggregate exchange of a few numbers per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from labelforge.functions.labels import (
    BAND_FALSE, BAND_TRUE, BAND_UNSURE, CLASS_NAMES, percent_of_total, prediction_to_num, safe_ratio,
)
from labelforge.operators.joins import counted_truth
from labelforge.functions.losses import FOCAL_ALPHA, FOCAL_GAMMA, bce_with_logits, focal_loss


def _f1(p, r):
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def confident_only(df: DataFrame, prediction: str = "prediction", out: str = "pred_num") -> DataFrame:
    """C4: rows whose prediction maps to 1 / 0 (B10), with that number."""
    return df.withColumn(out, prediction_to_num(prediction)).filter(F.col(out).isNotNull())


def uncertain_only(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """The ``?`` rows."""
    return df.filter(F.col(prediction) == BAND_UNSURE)


def confusion_binary(df: DataFrame, pred_num: str = "pred_num", label: str = "label", weight: str | None = None) -> DataFrame:
    """TP, FP, FN, TN over confident rows (``pred_num`` not null).
    ``weight`` names a column that says how many rows a row stands for."""
    p, y = F.col(pred_num), F.col(label)
    rows = F.lit(1) if weight is None else F.col(weight)

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, rows)), F.lit(0)).cast("long")

    return df.agg(
        total((p == 1) & (y == 1)).alias("tp"),
        total((p == 1) & (y == 0)).alias("fp"),
        total((p == 0) & (y == 1)).alias("fn"),
        total((p == 0) & (y == 0)).alias("tn"),
    )


def binary_report_from_joined(joined: DataFrame, prediction: str = "prediction", label: str = "label",
                              boolean_prediction: bool = False, numeric_prediction: bool = False,
                              weight: str | None = None) -> DataFrame:
    """E3 over an already joined frame: one row with total, confident_total,
    uncertain_count, accuracy, precision, recall, f1, coverage, tp, fp, fn, tn.
    An empty input gives one row of zeros.  ``weight`` names a column that says
    how many joined rows a row stands for."""
    num = prediction_to_num(prediction, boolean=boolean_prediction, numeric=numeric_prediction)
    rows = F.lit(1) if weight is None else F.col(weight)
    pred, truth = F.col("pred_num"), F.col("label")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")

    counts = joined.select(num.alias("pred_num"), F.col(label).alias("label"), rows.alias("n")).agg(
        total(F.lit(True)).alias("total"),
        total(pred.isNotNull()).alias("confident_total"),
        total(pred == truth).alias("correct"),
        total((pred == 1) & (truth == 1)).alias("tp"),
        total((pred == 1) & (truth == 0)).alias("fp"),
        total((pred == 0) & (truth == 1)).alias("fn"),
        total((pred == 0) & (truth == 0)).alias("tn"),
    )
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "total", "confident_total",
        (F.col("total") - F.col("confident_total")).alias("uncertain_count"),
        safe_ratio(F.col("correct"), F.col("confident_total")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        safe_ratio(F.col("confident_total"), F.col("total")).alias("coverage"),
        "tp", "fp", "fn", "tn",
    )


def binary_report(predictions: DataFrame, labels: DataFrame, key: str = "filename",
                  prediction: str = "prediction", label: str = "label",
                  boolean_prediction: bool = False, numeric_prediction: bool = False) -> DataFrame:
    """Join predictions to truth on ``key`` (D1, inner, duplicates
    multiply) and report.  Both sides are counted per key first, so a key of n
    and m rows is not paired n times m."""
    joined = counted_truth(predictions, labels, key, prediction, label)
    return binary_report_from_joined(joined, prediction, label, boolean_prediction, numeric_prediction, "n_rows")


def prediction_summary(predictions: DataFrame, prediction: str = "prediction") -> DataFrame:
    """E8 + B19: total and count / percent (1 decimal) of TRUE, FALSE, ``?``."""
    p = F.col(prediction)
    counts = predictions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(p == BAND_TRUE).alias("n_true"),
        F.count_if(p == BAND_FALSE).alias("n_false"),
        F.count_if(p == BAND_UNSURE).alias("n_uncertain"),
    )
    return counts.select(
        "total",
        "n_true", percent_of_total(F.col("n_true"), F.col("total")).alias("pct_true"),
        "n_false", percent_of_total(F.col("n_false"), F.col("total")).alias("pct_false"),
        "n_uncertain", percent_of_total(F.col("n_uncertain"), F.col("total")).alias("pct_uncertain"),
    )


def _mean(value, weight: str | None) -> F.Column:
    """Mean of a column; with ``weight``, of as many rows as that says."""
    if weight is None:
        return F.avg(value)
    counted = F.when(value.isNotNull(), F.col(weight))
    return F.try_divide(F.sum(value * F.col(weight)), F.sum(counted).cast("double"))


def brier_score(prob, label, weight: str | None = None) -> F.Column:
    """E6 aggregate: mean squared error of the probability."""
    p = F.col(prob) if isinstance(prob, str) else prob
    y = F.col(label) if isinstance(label, str) else label
    return _mean(F.pow(p - y.cast("double"), F.lit(2.0)), weight)


def _agrees(prob, label, threshold: float) -> F.Column:
    p = F.col(prob) if isinstance(prob, str) else prob
    y = F.col(label) if isinstance(label, str) else label
    above = (p > F.lit(float(threshold))) & ~F.isnan(p)
    return (above.cast("int") == y.cast("int")).cast("double")


def accuracy_at(prob, label, threshold: float = 0.5, weight: str | None = None) -> F.Column:
    """E7 aggregate: mean of ``(p > t) == y`` (strict; NaN is not above t)."""
    return _mean(_agrees(prob, label, threshold), weight)


def loss_summary(df: DataFrame, logit: str = "logit", label: str = "label",
                 alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA, weight: str | None = None) -> DataFrame:
    """Per-row losses reduced by mean and by sum.  ``weight``
    names a column that says how many rows a row stands for."""
    bce = bce_with_logits(logit, label)
    focal = focal_loss(logit, label, alpha, gamma)
    w = F.lit(1) if weight is None else F.col(weight)
    return df.agg(
        F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("n"),
        _mean(bce, weight).alias("mean_bce"),
        F.sum(bce * w).alias("sum_bce"),
        _mean(focal, weight).alias("mean_focal"),
        F.sum(focal * w).alias("sum_focal"),
    )


def reduce_loss(loss, reduction: str = "mean"):
    """``mean`` / ``sum`` aggregate, or ``none`` (the per-row column)."""
    if reduction == "mean":
        return F.avg(loss)
    if reduction == "sum":
        return F.sum(loss)
    if reduction == "none":
        return loss
    raise ValueError(f"unknown reduction: {reduction!r}")


def _class_counts(df: DataFrame, truth: str, pred: str, labels: Sequence[int]) -> DataFrame:
    t, p = F.col(truth), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for a in labels:
        for b in labels:
            aggs.append(F.count_if((t == a) & (p == b)).alias(f"c_{a}_{b}"))
        aggs.append(F.count_if(t == a).alias(f"support_{a}"))
        aggs.append(F.count_if((t == a) & (~p.isin(*labels) | p.isNull())).alias(f"out_{a}"))
        aggs.append(F.count_if(p == a).alias(f"predicted_{a}"))
    in_list_t = t.isin(*labels)
    in_list_p = p.isin(*labels)
    aggs.append(F.count_if(in_list_t & (~in_list_p | p.isNull())).alias("n_out_of_range"))
    aggs.append(F.count_if(~in_list_t | t.isNull() | ~in_list_p | p.isNull()).alias("n_outside_any"))
    return df.agg(*aggs)


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "pred",
                     labels: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """rows = truth class (all listed, zero rows kept), one count column
    ``pred_<c>`` per listed class; pairs with a class outside the list are
    ignored by the matrix and counted per truth row in ``n_out_of_range``.
    One aggregation pass, then the one-row result is unpivoted."""
    counts = _class_counts(df, truth, pred, labels)
    rows = F.array(*[
        F.struct(F.lit(a).alias("truth"),
                 *[F.col(f"c_{a}_{b}").alias(f"pred_{b}") for b in labels],
                 F.col(f"out_{a}").alias("n_out_of_range"))
        for a in labels
    ])
    return counts.select(F.inline(rows))


def classification_report(df: DataFrame, truth: str = "truth", pred: str = "pred",
                          labels: Sequence[int] = (1, 2, 3),
                          names: dict[int, str] | None = None) -> DataFrame:
    """E5: per-class precision / recall / f1 / support plus averages, with 0
    on zero division.  Support counts every row whose truth is the class,
    including rows predicted outside the list.  The first average row is
    ``accuracy`` when every class seen is in the list, else ``micro avg``."""
    names = names or CLASS_NAMES
    counts = _class_counts(df, truth, pred, labels)
    per_class = []
    for a in labels:
        tp = F.col(f"c_{a}_{a}")
        prec = safe_ratio(tp, F.col(f"predicted_{a}"))
        rec = safe_ratio(tp, F.col(f"support_{a}"))
        per_class.append((F.lit(names.get(a, str(a))), prec, rec, _f1(prec, rec), F.col(f"support_{a}")))
    total_support = sum((F.col(f"support_{a}") for a in labels[1:]), F.col(f"support_{labels[0]}"))
    total_pred = sum((F.col(f"predicted_{a}") for a in labels[1:]), F.col(f"predicted_{labels[0]}"))
    total_tp = sum((F.col(f"c_{a}_{a}") for a in labels[1:]), F.col(f"c_{labels[0]}_{labels[0]}"))
    k = float(len(labels))
    macro_p = sum((pc[1] for pc in per_class[1:]), per_class[0][1]) / F.lit(k)
    macro_r = sum((pc[2] for pc in per_class[1:]), per_class[0][2]) / F.lit(k)
    macro_f = sum((pc[3] for pc in per_class[1:]), per_class[0][3]) / F.lit(k)

    def weighted(i):
        num = sum((pc[i] * pc[4] for pc in per_class[1:]), per_class[0][i] * per_class[0][4])
        return safe_ratio(num, total_support)

    micro_p = safe_ratio(total_tp, total_pred)
    micro_r = safe_ratio(total_tp, total_support)
    micro_is_accuracy = F.col("n_outside_any") == 0
    first_avg = F.struct(
        F.when(micro_is_accuracy, F.lit("accuracy")).otherwise(F.lit("micro avg")).alias("class_name"),
        F.when(~micro_is_accuracy, micro_p).alias("precision"),
        F.when(~micro_is_accuracy, micro_r).alias("recall"),
        _f1(micro_p, micro_r).alias("f1"),
        total_support.alias("support"),
    )

    def row(name, p, r, f, s):
        return F.struct(name.alias("class_name"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.alias("support"))

    rows = [row(*pc) for pc in per_class] + [
        first_avg,
        row(F.lit("macro avg"), macro_p, macro_r, macro_f, total_support),
        row(F.lit("weighted avg"), weighted(1), weighted(2), weighted(3), total_support),
    ]
    return counts.select(F.inline(F.array(*rows)))


def epoch_metrics(scored: DataFrame, epoch: str = "epoch", batch: str = "batch",
                  loss: str = "loss", correct: str = "correct") -> DataFrame:
    """Per epoch, the plain average of per-batch mean losses (a short
    last batch weighs the same) and the pooled accuracy."""
    per_batch = scored.groupBy(epoch, batch).agg(
        F.avg(loss).alias("batch_loss"),
        F.count(F.lit(1)).alias("batch_rows"),
        F.sum(F.col(correct).cast("long")).alias("batch_correct"),
    )
    return per_batch.groupBy(epoch).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("batch_rows").alias("n_rows"),
        F.avg("batch_loss").alias("mean_loss"),
        (F.sum("batch_correct") / F.sum("batch_rows")).alias("accuracy"),
    )


def best_epoch(metrics: DataFrame, epoch: str = "epoch", accuracy: str = "accuracy",
               loss: str = "mean_loss") -> DataFrame:
    """Highest accuracy; the earliest epoch wins ties (a later epoch
    must be strictly better); an accuracy of 0 or NaN never wins.  One row, nulls
    when no epoch qualifies."""
    best = (metrics.filter((F.col(accuracy) > 0) & ~F.isnan(accuracy))
            .agg(F.max_by(F.struct(F.col(epoch).alias("e"), F.col(accuracy).alias("a"), F.col(loss).alias("l")),
                          F.struct(F.col(accuracy), -F.col(epoch))).alias("b")))
    return best.select(F.col("b.e").alias("best_epoch"), F.col("b.a").alias("best_accuracy"),
                       F.col("b.l").alias("best_loss"))


def split_sizes(split_df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows (and positives) per split."""
    return split_df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
    )
