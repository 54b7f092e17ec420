"""The query catalogue: Spark queries over the driver's tables and their
DuckDB oracle SQL (same column names, same rounding).

Floating results are rounded to 6 decimals in both engines; percentages to 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelforge import api
from labelforge.functions.labels import binary_to_band, label_from_text, sigmoid, uncertainty_band
from labelforge.functions.text import has_image_extension, path_basename, positional_name, url_basename
from labelforge.operators import batch, metrics
from labelforge.operators.calibrate import calibration_report, fit_platt, load_calibrator, save_calibrator
from labelforge.operators.fusion import fuse_labels, fusion_stats
from labelforge.operators.head import train_head
from labelforge.operators.ingest import fetch_plan, ingest_plan, ingest_summary, labels_output
from labelforge.operators.partitioning import spread_scan
from labelforge.fixed import NORM_MEAN, NORM_STD
from labelforge.operators.images import (
    as_bgr, channel_stats, count_files, image_channel_stats, list_images, load_images, normalise_pixels, to_rgb, upscale, write_image_table,
)
from labelforge.operators.joins import attach_images, counted_truth, join_truth, pending, resume_summary
from labelforge.operators.head import pos_weight
from labelforge.operators.metrics import confident_only, uncertain_only
from labelforge.operators.select import bounded_error_log, head, quota_fill, sorted_listing
from labelforge.operators.split import EVAL_FRACTIONS, TRAIN_FRACTIONS, restrict_to_split, stratified_split
from labelforge.plans import derived as D
from labelforge.session import materialize, scratch_path
from labelforge.sinks.image_store import read_store
from labelforge.sinks.files import write_csv, write_jsonl, write_uncertain
from labelforge.sources.files import with_content
from labelforge.sources.annotations import parse_annotation_lines, processed_urls_from_lines, read_annotations
from labelforge.sources.tables import read_table_csv
from labelforge.sources.text import parse_gt_tokens, parse_http_lines, parse_labelled_lines, read_tsv, unknown_label_texts
from labelforge.functions.verdict import coerce_class_id, fill_confidence, is_bad, label_text, with_verdict

THRESHOLD = 0.25
SEED = 42


def _r(col, digits: int = 6):
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def _round_all(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.select(*[_r(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ fusion

def q_label_fusion(spark: SparkSession, sf: str) -> DataFrame:
    labels = D.table(spark, sf, "labels")
    crowd = labels.select(F.col("doc_id").alias("filename"), F.col("quality").alias("label"))
    model = labels.select(F.col("doc_id").alias("filename"), F.col("toxic").alias("label"))
    return fuse_labels(crowd, model)


def q_fusion_stats(spark: SparkSession, sf: str) -> DataFrame:
    labels = D.table(spark, sf, "labels")
    crowd = labels.select(F.col("doc_id").alias("filename"), F.col("quality").alias("label"))
    model = labels.select(F.col("doc_id").alias("filename"), F.col("toxic").alias("label"))
    return fusion_stats(crowd, model)


_SQL_FUSION_BASE = """
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS filename, quality AS label_crowd FROM labels),
     m AS (SELECT CAST(doc_id AS VARCHAR) AS filename, toxic AS label_model FROM labels),
     j AS (SELECT c.filename, label_crowd, label_model,
                  CASE WHEN label_crowd = 1 THEN 1
                       WHEN label_crowd = 0 AND label_model = 0 THEN 0 END AS final_label
           FROM c JOIN m ON c.filename = m.filename)
"""

SQL_LABEL_FUSION = _SQL_FUSION_BASE + "SELECT filename, final_label FROM j WHERE final_label IS NOT NULL"

SQL_FUSION_STATS = _SQL_FUSION_BASE + """
SELECT (SELECT count(*) FROM c) AS crowd, (SELECT count(*) FROM m) AS model,
       count(*) AS merged, count(final_label) AS final,
       count(*) FILTER (WHERE final_label = 1) AS positives,
       count(*) FILTER (WHERE final_label = 0) AS negatives,
       count(*) - count(final_label) AS discarded,
       count(*) FILTER (WHERE label_crowd = 0 AND label_model = 1) AS risk,
       (SELECT count(*) FROM c WHERE filename IS NULL) + (SELECT count(*) FROM m WHERE filename IS NULL) AS null_keys
FROM j
"""

# ------------------------------------------------------------ S: scoring

_SQL_S = """
WITH s AS (
  SELECT CAST(vec_id AS VARCHAR) AS filename,
         list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE)
                  * CASE WHEN i % 2 = 1 THEN 8.0 ELSE -8.0 END / ((i + 1) // 2))) AS logit
  FROM embeddings),
p AS (
  SELECT filename, logit, 1.0 / (1.0 + exp(-logit)) AS probability FROM s),
b AS (
  SELECT filename, logit, probability,
         CASE WHEN probability < 0.25 THEN 'FALSE' WHEN probability > 0.75 THEN 'TRUE' ELSE '?' END
           AS prediction
  FROM p),
t AS (
  SELECT CAST(vec_id AS VARCHAR) AS filename, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label
  FROM embeddings)
"""


def _banded(spark: SparkSession, sf: str) -> DataFrame:
    s = D.scores(spark, sf).withColumn("probability", sigmoid("logit"))
    return s.withColumn("prediction", uncertainty_band("probability", THRESHOLD))


def q_band_predictions(spark: SparkSession, sf: str) -> DataFrame:
    b = _banded(spark, sf)
    return b.select("filename", "prediction", _r("probability").alias("probability"), _r("logit").alias("logit"))


SQL_BAND_PREDICTIONS = _SQL_S + """
SELECT filename, prediction, round(probability, 6) AS probability, round(logit, 6) AS logit FROM b
"""


def q_prediction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.prediction_summary(_banded(spark, sf))


SQL_PREDICTION_SUMMARY = _SQL_S + """
SELECT count(*) AS total,
       count(*) FILTER (WHERE prediction = 'TRUE') AS n_true,
       round(100.0 * count(*) FILTER (WHERE prediction = 'TRUE') / count(*), 1) AS pct_true,
       count(*) FILTER (WHERE prediction = 'FALSE') AS n_false,
       round(100.0 * count(*) FILTER (WHERE prediction = 'FALSE') / count(*), 1) AS pct_false,
       count(*) FILTER (WHERE prediction = '?') AS n_uncertain,
       round(100.0 * count(*) FILTER (WHERE prediction = '?') / count(*), 1) AS pct_uncertain
FROM b
"""

_REPORT_RATIOS = ("accuracy", "precision", "recall", "f1", "coverage")


def q_binary_report(spark: SparkSession, sf: str) -> DataFrame:
    rep = metrics.binary_report(_banded(spark, sf), D.truth(spark, sf))
    return _round_all(rep, _REPORT_RATIOS)


_SQL_REPORT_FROM_J = """
, n AS (
  SELECT CASE WHEN prediction IN ('TRUE', 'True') THEN 1
              WHEN prediction IN ('FALSE', 'False') THEN 0 END AS pred_num, label FROM j),
c AS (
  SELECT count(*) AS total, count(pred_num) AS confident_total,
         count(*) FILTER (WHERE pred_num = label) AS correct,
         count(*) FILTER (WHERE pred_num = 1 AND label = 1) AS tp,
         count(*) FILTER (WHERE pred_num = 1 AND label = 0) AS fp,
         count(*) FILTER (WHERE pred_num = 0 AND label = 1) AS fn,
         count(*) FILTER (WHERE pred_num = 0 AND label = 0) AS tn
  FROM n),
r AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
            CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
  FROM c)
SELECT total, confident_total, total - confident_total AS uncertain_count,
       round(CASE WHEN confident_total > 0 THEN correct / confident_total ELSE 0.0 END, 6) AS accuracy,
       round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                  ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN total > 0 THEN confident_total / total ELSE 0.0 END, 6) AS coverage,
       tp, fp, fn, tn
FROM r
"""

SQL_BINARY_REPORT = _SQL_S + """, j AS (SELECT b.prediction, t.label FROM b JOIN t ON b.filename = t.filename)
""" + _SQL_REPORT_FROM_J


def q_confusion_binary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_binary(confident_only(counted_truth(_banded(spark, sf), D.truth(spark, sf))), weight="n_rows")


SQL_CONFUSION_BINARY = _SQL_S + """
SELECT count(*) FILTER (WHERE prediction = 'TRUE' AND label = 1) AS tp,
       count(*) FILTER (WHERE prediction = 'TRUE' AND label = 0) AS fp,
       count(*) FILTER (WHERE prediction = 'FALSE' AND label = 1) AS fn,
       count(*) FILTER (WHERE prediction = 'FALSE' AND label = 0) AS tn
FROM b JOIN t ON b.filename = t.filename
"""

# ------------------------------------------------------------- splitting

def _sql_split(rows: str, held: str, last: str) -> str:
    """Stratified split of ``rows`` (filename, label): ``held`` of all rows (a
    fraction "a/b") are held out and ``last`` of those are the test part, both
    rounded up; strata by largest remainder, ties in the order of the labels."""
    up = lambda n, f: f"(({n} * {f.split('/')[0]} + {f.split('/')[1]} - 1) // {f.split('/')[1]})"
    return f"""
, cnt AS (SELECT label, CAST(count(*) AS HUGEINT) AS n FROM {rows} GROUP BY label),
whole AS (SELECT sum(n) AS n_all, {up('sum(n)', held)} AS n_held FROM cnt),
cut AS (SELECT n_all, n_held, n_all - n_held AS n_train, n_held - {up('n_held', last)} AS n_val FROM whole),
s1 AS (SELECT label, n, n * n_train // n_all AS low,
              row_number() OVER (ORDER BY (n * n_train) % n_all DESC, label) AS turn,
              n_train - sum(n * n_train // n_all) OVER () AS missing FROM cnt, cut),
p1 AS (SELECT label, n, low + CASE WHEN turn <= missing THEN 1 ELSE 0 END AS train FROM s1),
s2 AS (SELECT label, n, train, (n - train) * n_val // n_held AS low,
              row_number() OVER (ORDER BY ((n - train) * n_val) % n_held DESC, label) AS turn,
              n_val - sum((n - train) * n_val // n_held) OVER () AS missing FROM p1, cut),
p2 AS (SELECT label, train, low + CASE WHEN turn <= missing THEN 1 ELSE 0 END AS val FROM s2),
ranked AS (
  SELECT filename, label,
         row_number() OVER (PARTITION BY label ORDER BY md5('42|' || filename), filename) - 1 AS rk
  FROM {rows}),
sp AS (
  SELECT filename, ranked.label,
         CASE WHEN rk < train THEN 'train' WHEN rk < train + val THEN 'val' ELSE 'test' END AS split
  FROM ranked JOIN p2 ON ranked.label = p2.label)
"""


_SQL_SPLIT = _sql_split("t", "3/10", "1/2")


def _split_truth(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(D.truth(spark, sf), key="filename", label="label",
                            fractions=EVAL_FRACTIONS, seed=SEED)


def q_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.split_sizes(_split_truth(spark, sf))


SQL_SPLIT_SIZES = _SQL_S + _SQL_SPLIT + """
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_positive FROM sp GROUP BY split
"""


def q_evaluate_split(spark: SparkSession, sf: str) -> DataFrame:
    split = _split_truth(spark, sf)
    preds = restrict_to_split(_banded(spark, sf), split, "test")
    rep = metrics.binary_report(preds, D.truth(spark, sf))
    return _round_all(rep, _REPORT_RATIOS)


SQL_EVALUATE_SPLIT = _SQL_S + _SQL_SPLIT + """
, j AS (SELECT b.prediction, t.label FROM b JOIN t ON b.filename = t.filename
        WHERE b.filename IN (SELECT filename FROM sp WHERE split = 'test'))
""" + _SQL_REPORT_FROM_J

# ------------------------------------------------- calibration and losses


def q_brier_and_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    j = counted_truth(_banded(spark, sf), D.truth(spark, sf), prediction="probability")
    out = j.agg(F.sum("n_rows").alias("n"), metrics.brier_score("probability", "label", "n_rows").alias("brier"),
                metrics.accuracy_at("probability", "label", weight="n_rows").alias("accuracy"))
    return _round_all(out, ("brier", "accuracy"))


SQL_BRIER_AND_ACCURACY = _SQL_S + """
SELECT count(*) AS n, round(avg(power(probability - label, 2)), 6) AS brier,
       round(avg(CASE WHEN (CASE WHEN probability > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 6)
         AS accuracy
FROM b JOIN t ON b.filename = t.filename
"""


def q_loss_summary(spark: SparkSession, sf: str) -> DataFrame:
    j = counted_truth(D.scores(spark, sf), D.truth(spark, sf), prediction="logit")
    out = metrics.loss_summary(j, "logit", "label", weight="n_rows")
    return _round_all(out, ("mean_bce", "sum_bce", "mean_focal", "sum_focal"))


SQL_LOSS_SUMMARY = _SQL_S + """
, l AS (
  SELECT greatest(logit, 0.0) - logit * label + ln(1 + exp(-abs(logit))) AS bce
  FROM s JOIN t ON s.filename = t.filename),
f AS (SELECT bce, 0.67 * power(1.0 - exp(-bce), 2.0) * bce AS focal FROM l)
SELECT count(*) AS n, round(avg(bce), 6) AS mean_bce, round(sum(bce), 6) AS sum_bce,
       round(avg(focal), 6) AS mean_focal, round(sum(focal), 6) AS sum_focal
FROM f
"""


def q_platt_calibration(spark: SparkSession, sf: str) -> DataFrame:
    j = D.scores(spark, sf).join(D.truth(spark, sf), "filename")
    model = fit_platt(j, "logit", "label")
    rep = calibration_report(j, model, "logit", "label")
    return _round_all(rep, ("slope", "intercept", "brier_raw", "brier_cal", "acc_raw", "acc_cal"))


def q_train_head(spark: SparkSession, sf: str) -> DataFrame:
    emb = D.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("filename"), "embedding",
        F.when(F.col("label") < 5, F.lit(1)).otherwise(F.lit(0)).alias("label"))
    return _round_all(train_head(emb, key="filename", features="embedding", label="label"), ("val_accuracy", "test_accuracy"))


# the same gradient steps over list arithmetic; x has a last element 1
SQL_TRAIN_HEAD = _SQL_S + _sql_split("t", "1/5", "1/10") + """
, x AS (SELECT sp.split, CAST(sp.label AS DOUBLE) AS y,
               list_append(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), 1.0) AS x
        FROM embeddings JOIN sp ON sp.filename = CAST(vec_id AS VARCHAR)),
fit AS (SELECT * FROM (
  WITH RECURSIVE r(k, w) AS (
    SELECT 0, (SELECT list_transform(any_value(x), lambda v: CAST(0.0 AS DOUBLE)) FROM x)
    UNION ALL
    SELECT k + 1, list_transform(list_zip(w, g), lambda z: z[1] - z[2])
    FROM r, LATERAL (
      SELECT list(gj ORDER BY j) AS g FROM (
        SELECT j, sum((p - y) * x[j]) / count(*) AS gj
        FROM (SELECT y, x, 1.0 / (1.0 + exp(-list_inner_product(x, r.w))) AS p FROM x WHERE split = 'train'), range(1, 66) AS t(j)
        GROUP BY j))
    WHERE k < 20)
  SELECT k, w FROM r WHERE k IN (1, 2, 5, 10, 20))),
acc AS (SELECT k, split, avg(CASE WHEN (CASE WHEN 1.0 / (1.0 + exp(-list_inner_product(x, w))) > 0.5 THEN 1 ELSE 0 END) = y
                                  THEN 1.0 ELSE 0.0 END) AS a
        FROM fit, x WHERE split <> 'train' GROUP BY k, split),
best AS (SELECT arg_max(k, (a, -k)) AS k FROM acc WHERE split = 'val' AND a > 0)
SELECT CAST(v.k AS INTEGER) AS epoch, round(v.a, 6) AS val_accuracy, v.k = best.k AS is_best,
       CASE WHEN v.k = best.k THEN round(s.a, 6) END AS test_accuracy
FROM acc v JOIN acc s ON v.k = s.k AND v.split = 'val' AND s.split = 'test', best
"""


# ------------------------------------------------------ V: verdict parsing

_SQL_V = """
WITH ev AS (
  SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
p AS (
  SELECT event_id, event_type, k % 3 + 1 AS cls, printf('%.2f', k / 100.0) AS conf FROM ev),
q AS (
  SELECT event_id, event_type, cls, conf,
         CASE WHEN event_type = 'error' THEN 'bad' WHEN cls = 1 THEN 'coniferous'
              WHEN cls = 2 THEN 'deciduous' ELSE 'bad' END AS label_txt,
         CASE WHEN event_type = 'view' THEN '"' || CAST(cls AS VARCHAR) || '"'
              WHEN event_type = 'purchase' THEN CAST(cls + 2 AS VARCHAR) || '.5'
              ELSE CAST(cls AS VARCHAR) END AS class_json
  FROM p),
v AS (
  SELECT event_id, label_txt,
         CASE WHEN event_type = 'signup' THEN '{"label": "' || label_txt || '"}'
              ELSE '{"class_id": ' || class_json || ', "label": "' || label_txt || '", "confidence": '
                   || conf || '}' END AS verdict_json
  FROM q)
"""

# typed reading of a JSON object ``j`` (text) the way the engine reads verdicts
_SQL_TYPED = """
  CASE WHEN json_type(j, '$.class_id') IS NULL OR json_type(j, '$.class_id') = 'NULL' THEN 3
       WHEN json_type(j, '$.class_id') = 'BOOLEAN' THEN
            CASE WHEN json_extract_string(j, '$.class_id') = 'true' THEN 1 ELSE 0 END
       WHEN json_type(j, '$.class_id') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN
            CAST(trunc(CAST(json_extract_string(j, '$.class_id') AS DOUBLE)) AS INTEGER)
       WHEN json_type(j, '$.class_id') = 'VARCHAR'
            AND regexp_matches(json_extract_string(j, '$.class_id'), '^\\s*[+-]?[0-9]+\\s*$') THEN
            CAST(trim(json_extract_string(j, '$.class_id')) AS INTEGER)
       ELSE 3 END AS class_id,
  json_extract_string(j, '$.label') AS label,
  coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.0) AS confidence,
  (coalesce(json_type(j, '$.class_id') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
            AND CAST(json_extract_string(j, '$.class_id') AS DOUBLE) = 3.0, false)
   OR lower(coalesce(json_extract_string(j, '$.label'), '')) LIKE '%bad%') AS is_bad
"""


def _parsed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = with_verdict(D.verdict_texts(spark, sf), "model_text")
    return v.select(
        "seq", "url", "parsed",
        coerce_class_id("prediction").alias("class_id"),
        label_text("prediction").alias("label"),
        fill_confidence("prediction").alias("confidence"),
        is_bad("prediction").alias("is_bad"),
    )


def q_parse_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed_verdicts(spark, sf).drop("url")


_SQL_PARSED = _SQL_V + """
, t AS (
  SELECT event_id AS seq,
         CASE WHEN event_id % 17 = 0 THEN 'The main tree looks ' || label_txt
              WHEN event_id % 17 = 1 THEN verdict_json || ' I am fairly sure.'
              ELSE '```json' || chr(10) || verdict_json || chr(10) || '```' END AS model_text
  FROM v),
c AS (
  SELECT seq, model_text, trim(replace(replace(model_text, '```json', ''), '```', ''), ' ' || chr(10)) AS cleaned
  FROM t),
k AS (
  SELECT seq, model_text,
         (json_valid(cleaned) AND left(cleaned, 1) = '{' AND right(cleaned, 1) = '}') AS parsed,
         CASE WHEN json_valid(cleaned) AND left(cleaned, 1) = '{' AND right(cleaned, 1) = '}'
              THEN cleaned ELSE '{"class_id": 3, "label": "bad_parse"}' END AS j
  FROM c),
pv AS (
  SELECT seq, parsed, """ + _SQL_TYPED + """
  FROM k)
"""

SQL_PARSE_VERDICTS = _SQL_PARSED + "SELECT seq, parsed, class_id, label, confidence, is_bad FROM pv"


def q_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    pv = _parsed_verdicts(spark, sf).withColumn("truth", F.col("seq") % 2 + 1)
    return metrics.confusion_matrix(pv, "truth", "class_id", (1, 2, 3))


SQL_CONFUSION_MATRIX = _SQL_PARSED + """
, m AS (SELECT seq % 2 + 1 AS truth, class_id AS pred FROM pv),
cls AS (SELECT * FROM (VALUES (1), (2), (3)) AS x(c))
SELECT cls.c AS truth,
       (SELECT count(*) FROM m WHERE m.truth = cls.c AND m.pred = 1) AS pred_1,
       (SELECT count(*) FROM m WHERE m.truth = cls.c AND m.pred = 2) AS pred_2,
       (SELECT count(*) FROM m WHERE m.truth = cls.c AND m.pred = 3) AS pred_3,
       (SELECT count(*) FROM m WHERE m.truth = cls.c AND (m.pred NOT IN (1, 2, 3) OR m.pred IS NULL))
         AS n_out_of_range
FROM cls
"""


def q_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    pv = _parsed_verdicts(spark, sf).withColumn("truth", F.col("seq") % 2 + 1)
    rep = metrics.classification_report(pv, "truth", "class_id", (1, 2, 3))
    return _round_all(rep, ("precision", "recall", "f1"))


SQL_CLASSIFICATION_REPORT = _SQL_PARSED + """
, m AS (SELECT seq % 2 + 1 AS truth, class_id AS pred FROM pv),
names AS (SELECT * FROM (VALUES (1, 'Coniferous'), (2, 'Deciduous'), (3, 'Bad')) AS x(c, class_name)),
pc AS (
  SELECT c, class_name,
         (SELECT count(*) FROM m WHERE truth = c AND pred = c) AS tp,
         (SELECT count(*) FROM m WHERE pred = c) AS npred,
         (SELECT count(*) FROM m WHERE truth = c) AS support
  FROM names),
pr AS (
  SELECT c, class_name, support, tp, npred,
         CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM pc),
pf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                 ELSE 0.0 END AS f1
  FROM pr),
tot AS (
  SELECT sum(tp) AS stp, sum(npred) AS snpred, sum(support) AS ssup,
         avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
         CASE WHEN sum(support) > 0 THEN sum(precision * support) / sum(support) ELSE 0.0 END AS wp,
         CASE WHEN sum(support) > 0 THEN sum(recall * support) / sum(support) ELSE 0.0 END AS wr,
         CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END AS wf
  FROM pf),
mic AS (
  SELECT CASE WHEN snpred > 0 THEN stp / snpred ELSE 0.0 END AS up,
         CASE WHEN ssup > 0 THEN stp / ssup ELSE 0.0 END AS ur,
         (SELECT count(*) FROM m WHERE truth NOT IN (1, 2, 3) OR truth IS NULL
                                    OR pred NOT IN (1, 2, 3) OR pred IS NULL) AS outside
  FROM tot)
SELECT class_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM pf
UNION ALL
SELECT CASE WHEN outside = 0 THEN 'accuracy' ELSE 'micro avg' END,
       CASE WHEN outside = 0 THEN NULL ELSE round(up, 6) END,
       CASE WHEN outside = 0 THEN NULL ELSE round(ur, 6) END,
       round(CASE WHEN up + ur > 0 THEN 2 * up * ur / (up + ur) ELSE 0.0 END, 6),
       CAST(ssup AS BIGINT)
FROM mic, tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(ssup AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), CAST(ssup AS BIGINT) FROM tot
"""

# ------------------------------------------------------- V: quota selection


def _annotation_records(spark: SparkSession, sf: str) -> DataFrame:
    records, _ = parse_annotation_lines(D.annotation_lines(spark, sf))
    return records


def _select(spark: SparkSession, sf: str, overflow: bool) -> DataFrame:
    """The target follows the table: all bad rows and a third of the
    candidates, or (overflow) half of the bad rows."""
    # only the reported columns are landed; quota_fill reads them back
    records = materialize(_annotation_records(spark, sf).select("seq", "url", "is_bad", "class_id", "confidence"))
    n, n_bad = records.agg(F.count(F.lit(1)), F.count_if("is_bad")).first()
    sel = quota_fill(records, target=n_bad // 2 if overflow else n_bad + (n - n_bad) // 3)
    return sel.select("seq", "url", "bucket", "cand_rank", "is_bad", "class_id", "confidence")


def q_select_uncertain(spark: SparkSession, sf: str) -> DataFrame:
    return _select(spark, sf, False)


def q_select_uncertain_overflow(spark: SparkSession, sf: str) -> DataFrame:
    return _select(spark, sf, True)


def q_annotation_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, rejects = parse_annotation_lines(D.annotation_lines(spark, sf))
    return rejects


_SQL_RECORDS = _SQL_V + """
, lines AS (
  SELECT event_id AS seq,
         '{"url": "https://img.example.org/' || CAST(event_id AS VARCHAR) || '.jpg", "model": "stub", '
         || '"prediction": '
         || CASE WHEN event_id % 17 = 0 THEN '{"class_id": 3, "label": "bad_parse"}' ELSE verdict_json END
         || '}' AS record
  FROM v),
l AS (
  SELECT seq, CASE WHEN seq % 19 = 0 THEN left(record, 25) WHEN seq % 23 = 0 THEN '' ELSE record END AS value
  FROM lines),
rec AS (
  SELECT seq, json_extract_string(value, '$.url') AS url,
         coalesce(CAST(json_extract(value, '$.prediction') AS VARCHAR), '{}') AS j
  FROM l WHERE value <> '' AND json_valid(value)),
typed AS (SELECT seq, url, """ + _SQL_TYPED + """ FROM rec)
"""


def _sql_select(target: str) -> str:
    return _SQL_RECORDS + f"""
, nb AS (SELECT count(*) FILTER (WHERE is_bad) AS n_bad, count(*) AS n FROM typed),
cand AS (
  SELECT *, row_number() OVER (ORDER BY confidence, seq) - 1 AS cand_rank FROM typed WHERE NOT is_bad)
SELECT seq, url, 'bad' AS bucket, CAST(NULL AS BIGINT) AS cand_rank, is_bad, class_id, confidence
FROM typed WHERE is_bad
UNION ALL
SELECT seq, url, 'candidate', cand_rank, is_bad, class_id, confidence
FROM cand, nb WHERE cand_rank < greatest(0, {target} - n_bad)
"""


SQL_ANNOTATION_REJECTS = _SQL_RECORDS + """
SELECT seq, value FROM l WHERE value <> '' AND NOT json_valid(value)
"""

# ------------------------------------------------------- pages: resume / ingest


def q_pending_urls(spark: SparkSession, sf: str) -> DataFrame:
    urls = D.url_lines(spark, sf).select("seq", F.col("value").alias("url")).filter(F.col("url").contains("http"))
    done = processed_urls_from_lines(D.processed_lines(spark, sf))
    return pending(urls, done)


def q_resume_summary(spark: SparkSession, sf: str) -> DataFrame:
    urls = D.url_lines(spark, sf).select("seq", F.col("value").alias("url")).filter(F.col("url").contains("http"))
    done = processed_urls_from_lines(D.processed_lines(spark, sf))
    return resume_summary(urls, done)


_SQL_DONE = """
WITH pl AS (
  SELECT url, CASE WHEN url LIKE '%#top' THEN left(rec, 30) ELSE rec END AS value
  FROM (SELECT url, '{"url": "' || url || '", "model": "stub", "prediction": {"class_id": 1, "label": "coniferous"}}'
               AS rec FROM pages WHERE url LIKE '%/de/%')),
done AS (SELECT DISTINCT json_extract_string(value, '$.url') AS url FROM pl
         WHERE json_valid(value) AND json_extract_string(value, '$.url') IS NOT NULL),
urls AS (SELECT page_id AS seq, url FROM pages WHERE url LIKE '%http%')
"""

SQL_PENDING_URLS = _SQL_DONE + """
SELECT seq, url FROM urls WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.url = urls.url)
"""

SQL_RESUME_SUMMARY = _SQL_DONE + """
SELECT (SELECT count(*) FROM urls) AS total, (SELECT count(*) FROM done) AS processed,
       (SELECT count(*) FROM urls WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.url = urls.url)) AS to_do
"""


def _ingest(spark: SparkSession, sf: str) -> DataFrame:
    plan = ingest_plan(D.url_lines(spark, sf), D.existing_files(spark, sf), header_lines=0)
    return fetch_plan(plan, D.stub_fetcher).drop("content")


def q_ingest_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _ingest(spark, sf).select("pos", "filename", "url", "status")


def q_ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    lines = D.url_lines(spark, sf)
    return ingest_summary(lines, _ingest(spark, sf), header_lines=0)


_SQL_INGEST = """
WITH body AS (SELECT page_id AS pos, trim(url) AS url FROM pages WHERE trim(url) <> ''),
named AS (
  SELECT pos, url,
         CASE WHEN url LIKE 'http%' THEN
              CASE WHEN string_split(url, '/')[-1] LIKE '%.jpg' THEN string_split(url, '/')[-1]
                   ELSE printf('%06d.jpg', pos) END END AS filename
  FROM body),
files AS (SELECT DISTINCT printf('%06d.jpg', page_id) AS filename FROM pages WHERE url LIKE '%/en/%'),
st AS (
  SELECT pos, filename, url,
         CASE WHEN url NOT LIKE 'http%' THEN 'failed'
              WHEN filename IN (SELECT filename FROM files) THEN 'exists'
              WHEN url LIKE '%#top' THEN 'error: unreachable'
              ELSE 'ok' END AS status
  FROM named)
"""

SQL_INGEST_PLAN = _SQL_INGEST + "SELECT pos, filename, url, status FROM st WHERE status <> 'failed'"

SQL_INGEST_SUMMARY = _SQL_INGEST + """
SELECT (SELECT count(*) FROM pages) AS total,
       count(*) FILTER (WHERE status = 'ok') AS downloaded,
       count(*) FILTER (WHERE status = 'exists') AS skipped,
       count(*) FILTER (WHERE status = 'failed' OR status LIKE 'error%') AS failed,
       count(*) FILTER (WHERE status IN ('ok', 'exists')) AS kept
FROM st
"""


def _collision_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A URL list in which every 97th page has the same file name."""
    n = F.col("page_id")
    return D.table(spark, sf, "pages").select(n.alias("seq"), F.concat(
        F.lit("https://img.example.org/"), n.cast("string"), F.lit("/"), (n % 97).cast("string"), F.lit(".jpg")).alias("value"))


def _every_third_fails(pdf):
    """Fetcher of the collision queries: fails by the page number in the URL."""
    import pandas as pd
    number = pdf["url"].str.extract(r"org/(\d+)/")[0].astype(int)
    return pd.DataFrame({"content": [b"x"] * len(pdf), "error": ["gone" if n % 3 == 0 else None for n in number]})


def _raises_on_third(pdf):
    """Fetcher that raises for a whole call when one of its URLs is bad."""
    out = _every_third_fails(pdf)
    if out["error"].notna().any():
        raise RuntimeError("boom")
    return out


def q_ingest_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """D4 + I3: of the URLs with one file name the first that succeeds counts."""
    plan = ingest_plan(_collision_lines(spark, sf), spark.createDataFrame([], "filename string"), header_lines=0)
    return fetch_plan(plan, _every_third_fails, concurrency=2, batch_size=7).select("pos", "filename", "url", "status")


SQL_INGEST_COLLISIONS = """
WITH l AS (SELECT page_id AS pos, CAST(page_id % 97 AS VARCHAR) || '.jpg' AS filename,
                  'https://img.example.org/' || CAST(page_id AS VARCHAR) || '/' || CAST(page_id % 97 AS VARCHAR) || '.jpg' AS url
           FROM pages),
f AS (SELECT filename, min(pos) FILTER (WHERE pos % 3 <> 0) AS first_ok FROM l GROUP BY filename)
SELECT pos, l.filename, url, CASE WHEN pos > first_ok THEN 'exists' WHEN pos % 3 = 0 THEN 'error: gone' ELSE 'ok' END AS status
FROM l JOIN f ON l.filename = f.filename
"""


def q_fetch_isolated(spark: SparkSession, sf: str) -> DataFrame:
    """A raising call fails only the rows at fault."""
    rows = _collision_lines(spark, sf).select("seq", F.col("value").alias("url"))
    return batch.fetch(rows, _raises_on_third, concurrency=3).select("seq", "url", "status")


SQL_FETCH_ISOLATED = """
SELECT page_id AS seq,
       'https://img.example.org/' || CAST(page_id AS VARCHAR) || '/' || CAST(page_id % 97 AS VARCHAR) || '.jpg' AS url,
       CASE WHEN page_id % 3 = 0 THEN 'error: boom' ELSE 'ok' END AS status
FROM pages
"""

# ------------------------------------------------------------ batch jobs


def q_batch_score(spark: SparkSession, sf: str) -> DataFrame:
    emb = D.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("filename"), "embedding")
    out = batch.batch_score(emb, D.stub_scorer, ["embedding"], key="filename", threshold=THRESHOLD)
    return out.select("filename", "prediction", _r("probability").alias("probability"), _r("logit").alias("logit"))


def _annotate(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread_scan(D.table(spark, sf, "pages")).select("url", "html")
    done = processed_urls_from_lines(D.processed_lines(spark, sf))
    return batch.annotate(pages, _content_annotator, _html_fetcher, done=done)


def _html_fetcher(pdf):
    return D.stub_fetcher(pdf)


def _content_annotator(pdf):
    return D.stub_annotator(pdf)


def q_batch_annotate(spark: SparkSession, sf: str) -> DataFrame:
    out = _annotate(spark, sf)
    return out.select("url", "error", "parsed", "class_id", "label", "confidence")


# the stub annotator's verdict JSON (null = it answered in prose), as column j0
_SQL_ANNOTATE_CORE = """
  CASE WHEN (2 * length(html) - length(replace(html, 'e', ''))) % 7 = 0 THEN NULL
       ELSE '{"class_id": ' || CAST((2 * length(html) - length(replace(html, 'e', ''))) % 3 + 1 AS VARCHAR) || ', "label": "'
            || CASE (2 * length(html) - length(replace(html, 'e', ''))) % 3
                    WHEN 0 THEN 'coniferous' WHEN 1 THEN 'deciduous' ELSE 'bad' END
            || '", "confidence": ' || printf('%.2f', ((2 * length(html) - length(replace(html, 'e', ''))) % 100) / 100.0)
            || '}' END AS j0
"""


def _sql_batch_annotate() -> str:
    return _SQL_DONE + """
, todo AS (SELECT url, html FROM pages WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.url = pages.url)),
a0 AS (SELECT url, html, """ + _SQL_ANNOTATE_CORE + """ FROM todo),
b AS (
  SELECT url,
         CASE WHEN url LIKE '%#top' THEN 'unreachable' END AS error,
         (url NOT LIKE '%#top' AND j0 IS NOT NULL) AS parsed,
         CASE WHEN url LIKE '%#top' THEN '{"class_id": 3, "label": "bad"}'
              ELSE coalesce(j0, '{"class_id": 3, "label": "bad_parse"}') END AS j
  FROM a0)
SELECT url, error, parsed, class_id, label, confidence FROM (SELECT url, error, parsed, """ + _SQL_TYPED + """ FROM b)
"""


class _WorkerLost(BaseException):
    """Ends the Python worker; not an answer of the annotator."""


def _annotator_of_urls(pdf):
    """The stub annotator on the URL's text."""
    return D.stub_annotator(pdf.assign(content=pdf["url"]))


def _annotator_that_dies(pdf):
    """The same, in a worker that is lost now and then."""
    if zlib.crc32(pdf["url"].iloc[0].encode()) % 5 == 0:
        raise _WorkerLost
    return _annotator_of_urls(pdf)


def q_annotate_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """An annotation job over files whose workers die, then the
    job that goes on where it stopped; every record once, with its model."""
    base = scratch_path(spark, "annotate-resumed")
    urls, output = f"{base}/urls", f"{base}/out"
    D.table(spark, sf, "pages").select("url").write.text(urls)
    D.processed_lines(spark, sf).select("value").write.text(output)
    try:
        api.annotate(spark, urls, output, _annotator_that_dies, D.stub_fetcher, model_id="first", flush_rows=8)
    except Exception as lost:  # noqa: BLE001 - the job is aborted; what its tasks saved stays
        if "_WorkerLost" not in str(lost):
            raise
    api.annotate(spark, urls, output, _annotator_of_urls, D.stub_fetcher, model_id="second")
    records, _ = parse_annotation_lines(spark.read.text(output).withColumn("seq", F.lit(0).cast("long")))
    model = F.try_variant_get("record", "$.model", "string")
    made = records.filter(model.isin("first", "second"))
    return made.select("url", "error", model.isNotNull().alias("has_model"), F.try_variant_get("record", "$.timestamp", "double").isNotNull().alias("has_time"),
                       "class_id", "label", "confidence")


def _sql_annotate_resumed() -> str:
    return _SQL_DONE + """
, todo AS (SELECT url AS html, url FROM pages WHERE url LIKE '%http%' AND NOT EXISTS (SELECT 1 FROM done WHERE done.url = pages.url)),
a0 AS (SELECT url, html, """ + _SQL_ANNOTATE_CORE + """ FROM todo),
b AS (
  SELECT url, CASE WHEN url LIKE '%#top' THEN 'unreachable' END AS error,
         CASE WHEN url LIKE '%#top' THEN '{"class_id": 3, "label": "bad"}'
              ELSE coalesce(j0, '{"class_id": 3, "label": "bad_parse"}') END AS j
  FROM a0)
SELECT url, error, true AS has_model, true AS has_time, class_id, label, confidence FROM (SELECT url, error, """ + _SQL_TYPED + """ FROM b)
"""


def q_validate_annotator(spark: SparkSession, sf: str) -> DataFrame:
    gt = D.gt_pages(spark, sf)
    out = batch.validate_annotator(gt, _content_annotator, _html_fetcher)
    return out.select("url", "gt_label", "pred_class", "written", "parsed")


def _sql_validate_annotator() -> str:
    return """
WITH g AS (SELECT url, html, CASE WHEN url LIKE 'https%' THEN 1 ELSE 2 END AS gt_label FROM pages),
a0 AS (SELECT url, html, gt_label, """ + _SQL_ANNOTATE_CORE + """ FROM g),
b AS (
  SELECT url, gt_label,
         (url NOT LIKE '%#top' AND j0 IS NOT NULL) AS parsed,
         CASE WHEN url LIKE '%#top' THEN '{"class_id": 3, "label": "bad"}'
              ELSE coalesce(j0, '{"class_id": 3, "label": "bad_parse"}') END AS j
  FROM a0)
SELECT url, gt_label, class_id AS pred_class, true AS written, parsed
FROM (SELECT url, gt_label, parsed, """ + _SQL_TYPED + """ FROM b)
"""


def q_validate_matrix(spark: SparkSession, sf: str) -> DataFrame:
    gt = D.gt_pages(spark, sf)
    out = batch.validate_annotator(gt, _content_annotator, _html_fetcher)
    return metrics.confusion_matrix(out, "gt_label", "pred_class", (1, 2, 3))


def _sql_validate_matrix() -> str:
    inner = _sql_validate_annotator()
    return "WITH vr AS (" + inner + """),
cls AS (SELECT * FROM (VALUES (1), (2), (3)) AS x(c))
SELECT cls.c AS truth,
       (SELECT count(*) FROM vr WHERE gt_label = cls.c AND pred_class = 1) AS pred_1,
       (SELECT count(*) FROM vr WHERE gt_label = cls.c AND pred_class = 2) AS pred_2,
       (SELECT count(*) FROM vr WHERE gt_label = cls.c AND pred_class = 3) AS pred_3,
       (SELECT count(*) FROM vr WHERE gt_label = cls.c AND (pred_class NOT IN (1, 2, 3) OR pred_class IS NULL))
         AS n_out_of_range
FROM cls
"""

# ---------------------------------------------------- epochs and statistics


def q_epoch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    em = metrics.epoch_metrics(D.scored_batches(spark, sf))
    return _round_all(em, ("mean_loss", "accuracy"))


_SQL_EPOCHS = """
WITH sb AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
         CAST(hour(ts) AS INTEGER) AS batch, value AS loss,
         CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS correct
  FROM events),
pb AS (SELECT epoch, batch, avg(loss) AS bl, count(*) AS br, sum(correct) AS bc FROM sb GROUP BY epoch, batch),
em AS (SELECT epoch, count(*) AS n_batches, CAST(sum(br) AS BIGINT) AS n_rows, avg(bl) AS mean_loss,
              sum(bc) / sum(br) AS accuracy FROM pb GROUP BY epoch)
"""

SQL_EPOCH_METRICS = _SQL_EPOCHS + """
SELECT epoch, n_batches, n_rows, round(mean_loss, 6) AS mean_loss, round(accuracy, 6) AS accuracy FROM em
"""


def q_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    em = metrics.epoch_metrics(D.scored_batches(spark, sf))
    best = metrics.best_epoch(em)
    return _round_all(best, ("best_accuracy", "best_loss"))


SQL_BEST_EPOCH = _SQL_EPOCHS + """
SELECT (arg_max(epoch, (accuracy, -epoch)) FILTER (WHERE accuracy > 0)) AS best_epoch,
       round(arg_max(accuracy, (accuracy, -epoch)) FILTER (WHERE accuracy > 0), 6) AS best_accuracy,
       round(arg_max(mean_loss, (accuracy, -epoch)) FILTER (WHERE accuracy > 0), 6) AS best_loss
FROM em
"""


def q_vector_channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    from labelforge.operators.images import vector_channel_stats
    emb = D.table(spark, sf, "embeddings")
    out = vector_channel_stats(emb, "embedding", group_by="label")
    return _round_all(out, ("mean", "std"))


SQL_VECTOR_CHANNEL_STATS = """
SELECT label, count(*) AS n,
       round(avg(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 6) AS mean,
       round(avg(list_stddev_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 6) AS std
FROM embeddings GROUP BY label
"""


def q_label_encoding(spark: SparkSession, sf: str) -> DataFrame:
    labels = D.table(spark, sf, "labels")
    txt = binary_to_band("quality")
    return labels.select(
        F.col("doc_id").alias("filename"),
        txt.alias("is_conifer"),
        label_from_text(txt, "binary").alias("label"),
        label_from_text(txt, "verdict").alias("gt_label"),
        positional_name("doc_id", 3).alias("positional_name"),
    )


SQL_LABEL_ENCODING = """
SELECT doc_id AS filename,
       CASE WHEN quality = 1 THEN 'TRUE' WHEN quality = 0 THEN 'FALSE' ELSE '?' END AS is_conifer,
       CASE WHEN quality = 1 THEN 1 ELSE 0 END AS label,
       CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 2 END AS gt_label,
       printf('%03d.jpg', doc_id) AS positional_name
FROM labels
"""


def q_url_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.table(spark, sf, "pages")
    return pages.select(
        "page_id",
        url_basename("url").alias("url_basename"),
        path_basename(F.concat(F.lit("/data/images/"), url_basename("url"))).alias("path_basename"),
        has_image_extension("url").alias("is_image"),
        F.col("url").startswith("http").alias("starts_http"),
    )


SQL_URL_NAMES = """
SELECT page_id,
       string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS url_basename,
       string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS path_basename,
       regexp_matches(lower(url), '\\.(jpg|jpeg|png)$') AS is_image,
       starts_with(url, 'http') AS starts_http
FROM pages
"""


def q_incremental_annotate(spark: SparkSession, sf: str) -> DataFrame:
    from labelforge.streaming.incremental import annotate_pages_incrementally
    out = annotate_pages_incrementally(spark, sf)
    return out.select("url", "error", "parsed", "class_id", "label", "confidence")


# ------------------------------------------------------- text-line readers


def q_labelled_urls(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = parse_labelled_lines(D.labelled_lines(spark, sf), header_lines=0)
    return rows.select("pos", "filename", "label", "url")


def q_unknown_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A1: label texts that are neither TRUE nor FALSE, with their number."""
    rows, _ = parse_labelled_lines(D.labelled_lines(spark, sf), header_lines=0)
    return unknown_label_texts(rows)


def q_labelled_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, rejects = parse_labelled_lines(D.labelled_lines(spark, sf), header_lines=0)
    return rejects


_SQL_LABELLED = """
WITH l AS (
  SELECT page_id AS seq,
         CASE WHEN url LIKE '%/fr/%' THEN lower(CASE WHEN url LIKE 'https%' THEN 'TRUE' ELSE 'FALSE' END)
              ELSE CASE WHEN url LIKE 'https%' THEN 'TRUE' ELSE 'FALSE' END END
         || CASE WHEN url LIKE '%#top' THEN ' ' ELSE chr(9) END || url AS value
  FROM pages),
p AS (SELECT seq AS pos, value, string_split(trim(value), chr(9)) AS parts FROM l WHERE trim(value) <> '')
"""

SQL_LABELLED_URLS = _SQL_LABELLED + """
SELECT pos, printf('%03d.jpg', pos) AS filename, CASE WHEN parts[1] = 'TRUE' THEN 1 ELSE 0 END AS label,
       parts[2] AS url
FROM p WHERE len(parts) = 2
"""

SQL_LABELLED_REJECTS = _SQL_LABELLED + """
SELECT pos, value, 'malformed: expected 2 TAB parts' AS reason FROM p WHERE len(parts) <> 2
"""


def q_gt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return parse_gt_tokens(D.gt_token_lines(spark, sf))


SQL_GT_TOKENS = """
WITH l AS (
  SELECT page_id AS seq,
         CASE WHEN url LIKE '%/en/%' THEN (CASE WHEN url LIKE 'https%' THEN 'TRUE' ELSE 'FALSE' END) || '  ' || url
              WHEN url LIKE '%/fr/%' THEN url || ' ' || (CASE WHEN url LIKE 'https%' THEN 'TRUE' ELSE 'FALSE' END)
              WHEN url LIKE '%/de/%' THEN url
              ELSE 'FALSE ' || url || ' ' || (CASE WHEN url LIKE 'https%' THEN 'TRUE' ELSE 'FALSE' END) END AS value
  FROM pages),
t AS (SELECT seq, list_filter(string_split_regex(trim(value), '\\s+'), lambda x: x <> '') AS tokens FROM l),
u AS (
  SELECT seq, list_filter(tokens, lambda x: contains(x, 'http'))[-1] AS url,
         list_filter(tokens, lambda x: x IN ('TRUE', 'FALSE'))[-1] AS lt
  FROM t)
SELECT seq, url, CASE lt WHEN 'TRUE' THEN 1 WHEN 'FALSE' THEN 2 END AS gt_label
FROM u WHERE url IS NOT NULL AND lt IS NOT NULL
"""


def q_http_lines(spark: SparkSession, sf: str) -> DataFrame:
    return parse_http_lines(D.http_lines(spark, sf))


SQL_HTTP_LINES = """
WITH l AS (
  SELECT page_id AS seq,
         CASE WHEN url LIKE '%#top' THEN 'no link here' WHEN url LIKE '%/de/%' THEN ''
              ELSE '  ' || url || ' ' END AS value
  FROM pages)
SELECT seq, trim(value) AS url FROM l WHERE trim(value) <> '' AND contains(trim(value), 'http')
"""

# ------------------------------------------------------ filters and weights


def q_uncertain_predictions(spark: SparkSession, sf: str) -> DataFrame:
    unsure = uncertain_only(_banded(spark, sf))
    return unsure.select("filename", "prediction", _r("probability").alias("probability"),
                         _r("logit").alias("logit"))


SQL_UNCERTAIN_PREDICTIONS = _SQL_S + """
SELECT filename, prediction, round(probability, 6) AS probability, round(logit, 6) AS logit
FROM b WHERE prediction = '?'
"""


def q_confident_predictions(spark: SparkSession, sf: str) -> DataFrame:
    j = _banded(spark, sf).join(D.truth(spark, sf), "filename")
    return confident_only(j).select("filename", "pred_num", "label")


SQL_CONFIDENT_PREDICTIONS = _SQL_S + """
SELECT b.filename, CASE WHEN prediction = 'TRUE' THEN 1 ELSE 0 END AS pred_num, label
FROM b JOIN t ON b.filename = t.filename WHERE prediction IN ('TRUE', 'FALSE')
"""


def q_pos_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _round_all(pos_weight(D.truth(spark, sf)), ("pos_weight",))


SQL_POS_WEIGHT = _SQL_S + """
SELECT round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS pos_weight FROM t
"""


def q_fetch_error_log(spark: SparkSession, sf: str) -> DataFrame:
    failures = _ingest(spark, sf).filter(F.col("status").startswith("error"))
    first, rest = bounded_error_log(materialize(failures), 10, "pos")
    return first.select("pos", "url", "status", F.lit(rest.first()["suppressed"]).cast("long").alias("suppressed"))


SQL_FETCH_ERROR_LOG = _SQL_INGEST + """
SELECT pos, url, status, (SELECT greatest(count(*) - 10, 0) FROM st WHERE status LIKE 'error%') AS suppressed
FROM st WHERE status LIKE 'error%' ORDER BY pos LIMIT 10
"""


# Platt scaling by Newton's method in SQL: L2 (C = 1) on the slope, free
# intercept - the objective Spark ML minimises with regParam = 1/n.
SQL_PLATT_CALIBRATION = _SQL_S + """
, d AS (SELECT s.logit AS x, CAST(t.label AS DOUBLE) AS y FROM s JOIN t ON s.filename = t.filename),
fit AS (SELECT * FROM (
  WITH RECURSIVE r(k, a, b) AS (
    SELECT 0, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE)
    UNION ALL
    SELECT k + 1,
           a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
           b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM r, LATERAL (
      SELECT sum((p - y) * x) + r.a AS g0, sum(p - y) AS g1,
             sum(p * (1 - p) * x * x) + 1 AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p)) AS h11
      FROM (SELECT x, y, 1.0 / (1.0 + exp(-(r.a * x + r.b))) AS p FROM d))
    WHERE k < 40)
  SELECT a, b FROM r ORDER BY k DESC LIMIT 1)),
sc AS (SELECT y, 1.0 / (1.0 + exp(-x)) AS p_raw, 1.0 / (1.0 + exp(-(a * x + b))) AS p_cal FROM d, fit)
SELECT count(*) AS n, round(any_value(a), 6) AS slope, round(any_value(b), 6) AS intercept,
       round(avg(power(p_raw - y, 2)), 6) AS brier_raw, round(avg(power(p_cal - y, 2)), 6) AS brier_cal,
       round(avg(CASE WHEN (CASE WHEN p_raw > 0.5 THEN 1 ELSE 0 END) = y THEN 1.0 ELSE 0.0 END), 6) AS acc_raw,
       round(avg(CASE WHEN (CASE WHEN p_cal > 0.5 THEN 1 ELSE 0 END) = y THEN 1.0 ELSE 0.0 END), 6) AS acc_cal
FROM sc, fit
"""


def q_train_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    split = stratified_split(D.truth(spark, sf), key="filename", label="label", fractions=TRAIN_FRACTIONS, seed=SEED)
    return metrics.split_sizes(split)


SQL_TRAIN_SPLIT_SIZES = _SQL_S + _sql_split("t", "1/5", "1/10") + """
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_positive FROM sp GROUP BY split
"""


def _event_split(spark: SparkSession, sf: str) -> DataFrame:
    events = D.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("filename"),
                                                 F.col("event_type").alias("label"))
    return stratified_split(events, key="filename", label="label", fractions=EVAL_FRACTIONS, seed=SEED)


def q_event_split(spark: SparkSession, sf: str) -> DataFrame:
    """H1 over strata of odd sizes, row by row."""
    return _event_split(spark, sf).select("filename", "label", "split")


SQL_EVENT_SPLIT = """
WITH t AS (SELECT CAST(event_id AS VARCHAR) AS filename, event_type AS label FROM events)
""" + _sql_split("t", "3/10", "1/2") + "SELECT filename, label, split FROM sp"


def q_label_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """H1 on the labels table, stratified by both labels together."""
    rows = D.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("filename"),
                                               (2 * F.col("quality") + F.col("toxic")).alias("label"))
    split = stratified_split(rows, key="filename", label="label", fractions=TRAIN_FRACTIONS, seed=SEED)
    return split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


SQL_LABEL_SPLIT_SIZES = """
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS filename, 2 * quality + toxic AS label FROM labels)
""" + _sql_split("t", "1/5", "1/10") + "SELECT split, label, count(*) AS n_rows FROM sp GROUP BY split, label"


# ------------------------------------------------------------- hard values


def q_band_edge_cases(spark: SparkSession, sf: str) -> DataFrame:
    """B9, E7, E14 with NaN: every seventh probability is NaN."""
    b = _banded(spark, sf).withColumn("probability", F.when(F.col("filename").cast("long") % 7 == 0, F.lit(float("nan")))
                                      .otherwise(F.col("probability")))
    j = b.withColumn("prediction", uncertainty_band("probability", THRESHOLD)).join(D.truth(spark, sf), "filename")
    out = j.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), metrics.accuracy_at("probability", "label").alias("accuracy"))
    return _round_all(out, ("accuracy",))


SQL_BAND_EDGE_CASES = _SQL_S + """
, e AS (SELECT b.filename, CASE WHEN CAST(b.filename AS BIGINT) % 7 = 0 THEN NULL ELSE probability END AS p, label
        FROM b JOIN t ON b.filename = t.filename)
SELECT CASE WHEN p < 0.25 THEN 'FALSE' WHEN p > 0.75 THEN 'TRUE' ELSE '?' END AS prediction, count(*) AS n,
       round(avg(CASE WHEN (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM e GROUP BY 1
"""


def q_parse_verdicts_edge(spark: SparkSession, sf: str) -> DataFrame:
    """B11-B14 on NaN, cut emoji, huge class ids and trailing text."""
    n = F.col("event_id") % 8
    text = (F.when(n == 0, F.lit('{"class_id": NaN, "label": "ok"}'))
            .when(n == 1, F.lit('{"class_id": 1, "label": "\\ud83d"}'))
            .when(n == 2, F.lit('{"class_id": 99999999999, "label": "far"}'))
            .when(n == 3, F.lit('{"class_id": "99999999999", "label": "far"}'))
            .when(n == 4, F.lit('{"class_id": 2, "confidence": NaN}'))
            .when(n == 5, F.lit('{"class_id": Infinity, "label": "x"}'))
            .when(n == 6, F.lit('{"class_id": 1e999, "confidence": -Infinity}'))
            .otherwise(F.concat(F.lit('{"class_id": '), (F.col("event_id") % 3 + 1).cast("string"), F.lit("} and more"))))
    ev = spread_scan(D.table(spark, sf, "events")).select("event_id", text.alias("model_text"))
    v = with_verdict(ev, "model_text")
    confidence = fill_confidence("prediction")
    return v.select("event_id", "parsed", coerce_class_id("prediction").alias("class_id"),
                    F.isnan(confidence).alias("nan_confidence"), is_bad("prediction").alias("is_bad"))


SQL_PARSE_VERDICTS_EDGE = """
SELECT event_id, event_id % 8 <> 7 AS parsed,
       CAST(CASE event_id % 8 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 2
                              WHEN 5 THEN 3 WHEN 6 THEN 3 ELSE 3 END AS INTEGER) AS class_id,
       event_id % 8 = 4 AS nan_confidence, event_id % 8 = 7 AS is_bad
FROM events
"""


def q_numeric_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """B10 on a predictions column of numbers, written as text."""
    rows = D.table(spark, sf, "labels").select(F.col("doc_id").alias("filename"), F.col("quality").alias("label"),
                                               F.when(F.col("doc_id") % 2 == 0, F.col("toxic").cast("string"))
                                               .otherwise(F.col("toxic").cast("double").cast("string")).alias("prediction"))
    rep = metrics.binary_report(rows, rows, numeric_prediction=True)
    return _round_all(rep, _REPORT_RATIOS)


SQL_NUMERIC_PREDICTIONS = """
WITH j AS (SELECT CASE WHEN p.toxic = 1 THEN 'TRUE' ELSE 'FALSE' END AS prediction, y.quality AS label
           FROM labels p JOIN labels y ON p.doc_id = y.doc_id)
""" + _SQL_REPORT_FROM_J


def q_hot_key_report(spark: SparkSession, sf: str) -> DataFrame:
    """D1, E3 and E1 on a key of four values: sums without n x m rows."""
    ev = D.table(spark, sf, "events")
    preds = ev.select(F.col("event_type").alias("filename"),
                      F.when(F.col("event_id") % 3 == 0, "TRUE").when(F.col("event_id") % 3 == 1, "FALSE").otherwise("?").alias("prediction"))
    truth = ev.select(F.col("event_type").alias("filename"), (F.col("user_id") % 2).cast("int").alias("label"))
    return _round_all(metrics.binary_report(preds, truth), _REPORT_RATIOS)


SQL_HOT_KEY_REPORT = """
WITH p AS (SELECT event_type AS k, CASE event_id % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' ELSE '?' END AS prediction,
                  CAST(count(*) AS BIGINT) AS np FROM events GROUP BY ALL),
y AS (SELECT event_type AS k, user_id % 2 AS label, CAST(count(*) AS BIGINT) AS ny FROM events GROUP BY ALL),
w AS (SELECT CASE prediction WHEN 'TRUE' THEN 1 WHEN 'FALSE' THEN 0 END AS pred_num, label, np * ny AS n
      FROM p JOIN y ON p.k = y.k),
c AS (
  SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE pred_num IS NOT NULL) AS BIGINT) AS confident_total,
         CAST(sum(n) FILTER (WHERE pred_num = label) AS BIGINT) AS correct,
         CAST(sum(n) FILTER (WHERE pred_num = 1 AND label = 1) AS BIGINT) AS tp,
         CAST(sum(n) FILTER (WHERE pred_num = 1 AND label = 0) AS BIGINT) AS fp,
         CAST(sum(n) FILTER (WHERE pred_num = 0 AND label = 1) AS BIGINT) AS fn,
         CAST(sum(n) FILTER (WHERE pred_num = 0 AND label = 0) AS BIGINT) AS tn
  FROM w),
r AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
            CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
  FROM c)
SELECT total, confident_total, total - confident_total AS uncertain_count,
       round(CASE WHEN confident_total > 0 THEN correct / confident_total ELSE 0.0 END, 6) AS accuracy,
       round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                  ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN total > 0 THEN confident_total / total ELSE 0.0 END, 6) AS coverage,
       tp, fp, fn, tn
FROM r
"""


def q_labelled_ingest(spark: SparkSession, sf: str) -> DataFrame:
    files = D.table(spark, sf, "pages").filter(F.col("url").contains("/en/")) \
        .select(F.format_string("%03d.jpg", F.col("page_id")).alias("filename"))
    plan = ingest_plan(D.labelled_lines(spark, sf), files, header_lines=0, labelled=True)
    return labels_output(fetch_plan(plan, D.stub_fetcher).select("filename", "label", "status"))


SQL_UNKNOWN_LABELS = _SQL_LABELLED + """
SELECT parts[1] AS label_text, count(*) AS n FROM p WHERE len(parts) = 2 AND parts[1] NOT IN ('TRUE', 'FALSE') GROUP BY 1
"""

SQL_LABELLED_INGEST = _SQL_LABELLED + """
, ok AS (SELECT pos, printf('%03d.jpg', pos) AS filename, CASE WHEN parts[1] = 'TRUE' THEN 1 ELSE 0 END AS label,
                parts[2] AS url
         FROM p WHERE len(parts) = 2)
SELECT filename, label FROM ok
WHERE filename IN (SELECT printf('%03d.jpg', page_id) FROM pages WHERE url LIKE '%/en/%') OR url NOT LIKE '%#top'
"""


# -------------------------------------------------- readers, sinks, listings


def q_csv_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """K1 then A5: a CSV with other columns and another order, read by name."""
    path = scratch_path(spark, "labels-csv")
    rows = D.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("filename"), F.col("quality").alias("label"),
                                               F.col("toxic").alias("extra"))
    write_csv(rows, path, ["extra", "label", "filename"])
    return read_table_csv(spark, path, "filename string, label int")


SQL_CSV_BY_NAME = "SELECT CAST(doc_id AS VARCHAR) AS filename, quality AS label FROM labels"


def q_tsv_without_last_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A TAB-separated file without its last three rows."""
    path = scratch_path(spark, "orders-tsv")
    rows = D.table(spark, sf, "labels").select("doc_id", "quality").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return read_tsv(spark, path, "doc_id bigint, quality int", drop_last=3)


SQL_TSV_WITHOUT_LAST_ROWS = """
SELECT doc_id, quality FROM (SELECT *, row_number() OVER (ORDER BY doc_id DESC) AS back FROM labels) WHERE back > 3
"""


def q_jsonl_append(spark: SparkSession, sf: str) -> DataFrame:
    """K2: two appends, read back as annotations."""
    path = scratch_path(spark, "annotations-jsonl")
    rows = D.table(spark, sf, "events").select(
        F.concat(F.lit("http://x/"), F.col("event_id").cast("string")).alias("url"), (F.col("event_id") % 2).alias("turn"),
        F.struct((F.col("event_id") % 3 + 1).cast("int").alias("class_id"), F.col("value").alias("confidence")).alias("prediction"))
    for turn in (0, 1):
        write_jsonl(rows.where(F.col("turn") == turn), path, mode="append", columns=["url", "prediction"])
    records, _ = read_annotations(spark, path)
    return records.select("url", "class_id", _r("confidence").alias("confidence"), "is_bad")


SQL_JSONL_APPEND = """
SELECT 'http://x/' || CAST(event_id AS VARCHAR) AS url, CAST(event_id % 3 + 1 AS INTEGER) AS class_id,
       round(coalesce(value, 0.0), 6) AS confidence, event_id % 3 = 2 AS is_bad
FROM events
"""


def q_uncertain_file(spark: SparkSession, sf: str) -> DataFrame:
    """K3: the side file of unsure rows, read back."""
    path = scratch_path(spark, "uncertain")
    if not write_uncertain(_banded(spark, sf), path):
        return _banded(spark, sf).select("filename", "prediction").limit(0)
    return read_table_csv(spark, path, "filename string, prediction string, probability double").select(
        "filename", "prediction", _r("probability").alias("probability"))


SQL_UNCERTAIN_FILE = _SQL_S + "SELECT filename, prediction, round(probability, 6) AS probability FROM b WHERE prediction = '?'"


def q_saved_calibrator(spark: SparkSession, sf: str) -> DataFrame:
    """A calibrator saved, loaded and applied."""
    path = scratch_path(spark, "calibrator")
    j = materialize(D.scores(spark, sf).join(D.truth(spark, sf), "filename"))
    save_calibrator(fit_platt(j, "logit", "label"), path)
    rep = calibration_report(j, load_calibrator(path), "logit", "label")
    return _round_all(rep, ("slope", "intercept", "brier_raw", "brier_cal", "acc_raw", "acc_cal"))


def q_first_listed(spark: SparkSession, sf: str) -> DataFrame:
    """the first five names of a sorted listing."""
    names = D.table(spark, sf, "pages").select(F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit("_"), url_basename("url")).alias("path"))
    return head(sorted_listing(names), 5, "path")


SQL_FIRST_LISTED = """
SELECT '/data/' || CAST(page_id AS VARCHAR) || '_' || string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS path
FROM pages ORDER BY path LIMIT 5
"""


def q_attach_images(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with the image of their name, or an error."""
    labels = D.table(spark, sf, "labels").select(F.format_string("%06d.jpg", F.col("doc_id")).alias("filename"), F.col("quality").alias("label"))
    images = D.table(spark, sf, "pages").select(F.concat(F.lit("/img/"), F.format_string("%06d.jpg", F.col("page_id"))).alias("path"))
    return attach_images(labels, images).select("filename", "label", "path", "error")


SQL_ATTACH_IMAGES = """
SELECT printf('%06d.jpg', doc_id) AS filename, quality AS label,
       CASE WHEN page_id IS NOT NULL THEN '/img/' || printf('%06d.jpg', page_id) END AS path,
       CASE WHEN page_id IS NULL THEN 'image not found: ' || printf('%06d.jpg', doc_id) END AS error
FROM labels LEFT JOIN pages ON page_id = doc_id
"""



def _page_files(spark: SparkSession, sf: str) -> str:
    """A folder with a file for each page: its html, under names that begin
    with a letter, ``_`` or ``.``; every fifth is no image by its name."""
    n = F.col("page_id")
    lead = F.when(n % 3 == 0, "_").when(n % 3 == 1, ".").otherwise("p")
    pages = D.table(spark, sf, "pages").select(F.concat(lead, n.cast("string"), F.when(n % 5 == 0, ".txt").otherwise(".png")).alias("name"), "html")
    return D.write_files(pages, scratch_path(spark, "page-files"))


def q_listed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The images of a folder with names of all kinds, and the number
    of its files."""
    folder = _page_files(spark, sf)
    return list_images(spark, folder).select("filename", "length", F.lit(count_files(spark, folder)).cast("long").alias("n_files"))


_SQL_PAGE_FILES = """
WITH f AS (SELECT CASE page_id % 3 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE 'p' END || CAST(page_id AS VARCHAR)
                  || CASE WHEN page_id % 5 = 0 THEN '.txt' ELSE '.png' END AS filename, coalesce(html, '') AS html, page_id FROM pages)
"""

SQL_LISTED_FILES = _SQL_PAGE_FILES + """
SELECT filename, CAST(octet_length(encode(html)) AS BIGINT) AS length, (SELECT count(*) FROM f) AS n_files FROM f WHERE filename LIKE '%.png'
"""


def q_attached_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with the file of their name, whose bytes are read in the task
    that digests them; one without a file has an error."""
    folder = _page_files(spark, sf)
    n = F.col("doc_id")
    name = F.concat(F.when(n % 3 == 0, "_").when(n % 3 == 1, ".").otherwise("p"), n.cast("string"), F.lit(".png"))
    labels = D.table(spark, sf, "labels").select(name.alias("filename"), F.col("quality").alias("label"))
    found = with_content(attach_images(labels, list_images(spark, folder).select("path")))
    return found.select("filename", "label", F.sha2("content", 256).alias("sha256"), "error")


SQL_ATTACHED_CONTENTS = _SQL_PAGE_FILES + """
, l AS (SELECT CASE doc_id % 3 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE 'p' END || CAST(doc_id AS VARCHAR) || '.png' AS filename, quality AS label FROM labels)
SELECT l.filename, label, sha256(html) AS sha256, CASE WHEN f.filename IS NULL THEN 'image not found: ' || l.filename END AS error
FROM l LEFT JOIN f USING (filename)
"""


def _first_version(pdf):
    """Fetcher of the first run: the content names the URL; ``#top`` fails."""
    return _version(pdf, "one ", pdf["url"].str.endswith("#top"))


def _second_version(pdf):
    """Fetcher of the second run: French pages fail."""
    return _version(pdf, "two ", pdf["url"].str.contains("/fr/"))


def _version(pdf, word, fails):
    import pandas as pd
    return pd.DataFrame({"content": [(word + u).encode() for u in pdf["url"]], "error": ["gone" if f else None for f in fails]})


def q_ingest_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Images fetched into a store, and again with ``overwrite``:
    one row a name, the old one where the second fetch failed."""
    base = scratch_path(spark, "ingest-overwrite")
    lines, store = f"{base}/urls", f"{base}/store"
    D.table(spark, sf, "pages").orderBy("page_id").select("url").write.text(lines)
    api.ingest(spark, lines, store, _first_version, type="no_markup")
    api.ingest(spark, lines, store, _second_version, type="no_markup", overwrite=True)
    return read_store(spark, store).select("filename", F.col("content").cast("string").alias("content"))


# the first line is a header; positions count from the line after it
SQL_INGEST_OVERWRITE = _SQL_INGEST.replace(
    "SELECT page_id AS pos, trim(url) AS url FROM pages WHERE trim(url) <> ''",
    "SELECT page_id - 1 AS pos, trim(url) AS url FROM pages WHERE trim(url) <> '' AND page_id > 0") + """
SELECT filename, CASE WHEN url NOT LIKE '%/fr/%' THEN 'two ' ELSE 'one ' END || url AS content
FROM named WHERE url LIKE 'http%' AND (url NOT LIKE '%/fr/%' OR url NOT LIKE '%#top')
"""

# ------------------------------------------------------------------ images


def _pixel_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A grey 8 x 8 image of each embedding."""
    value = lambda v: F.least(F.greatest(F.floor((v.cast("double") + 4) * 32), F.lit(0)), F.lit(255))
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(value(v)), 2, "0")), ""))
    rows = D.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"),
                                                   F.lit(1).alias("n_channels"), data.alias("data"))
    return to_rgb(rows)


# kernels of 8 input pixels as SQL: weight of input i for output o
_SQL_SINC = "CASE WHEN {x} = 0 THEN 1.0 ELSE sin(pi() * ({x})) / (pi() * ({x})) END"
_SQL_SHAPES = {
    "bilinear": (1, "greatest(1 - abs({x}), 0)"),
    "bicubic": (2, "CASE WHEN abs({x}) < 1 THEN (1.5 * abs({x}) - 2.5) * abs({x}) * abs({x}) + 1 "
                   "WHEN abs({x}) < 2 THEN ((-0.5 * abs({x}) + 2.5) * abs({x}) - 4) * abs({x}) + 2 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN abs({x}) < 3 THEN (" + _SQL_SINC.replace("{x}", "({x})") + ") * (" + _SQL_SINC.replace("{x}", "({x} / 3)") + ") ELSE 0 END"),
}


def _sql_resized(size: int, method: str, name: str) -> str:
    """CTEs ending in ``name`` (id, oy, ox, v): the grey images of _pixel_rows
    resized to size x size whole values."""
    scale = 8 / size
    if method == "plain":
        weight = f"greatest(1 - abs(i - greatest(least((o + 0.5) * {scale} - 0.5, 7), 0)), 0)"
        first = "v"
    else:
        half, shape = _SQL_SHAPES[method]
        wide = max(scale, 1.0)
        centre = f"(o + 0.5) * {scale}"
        weight = (f"CASE WHEN i >= greatest(floor({centre} - {half * wide} + 0.5), 0) AND i < least(floor({centre} + {half * wide} + 0.5), 8) THEN "
                  + shape.format(x=f"((i + 0.5 - {centre}) / {wide})") + " ELSE 0 END")
        first = "floor(least(greatest(v, 0), 255) + 0.5)"
    return f"""
{name}_k AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (
  SELECT o, i, CAST({weight} AS DOUBLE) AS w FROM range({size}) AS a(o), range(8) AS b(i))),
{name}_x AS (SELECT id, y, o AS ox, {first} AS v FROM (SELECT id, y, o, sum(w * px.v) AS v FROM px JOIN {name}_k ON i = x GROUP BY ALL)),
{name} AS (SELECT id, o AS oy, ox, floor(least(greatest(v, 0), 255) + 0.5) AS v FROM (
  SELECT id, o, ox, sum(w * r.v) AS v FROM {name}_x r JOIN {name}_k ON i = y GROUP BY ALL))"""


_SQL_PX = """
WITH px AS (SELECT CAST(vec_id AS VARCHAR) AS id, (n - 1) // 8 AS y, (n - 1) % 8 AS x,
                   least(greatest(floor((CAST(embedding[n] AS DOUBLE) + 4) * 32), 0), 255) AS v
            FROM embeddings, range(1, 65) AS r(n)),"""


def q_image_channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    """E10 on images: bicubic to 4 x 4."""
    return channel_stats(image_channel_stats(_pixel_rows(spark, sf), 4))


SQL_IMAGE_CHANNEL_STATS = _SQL_PX + _sql_resized(4, "bicubic", "z") + """,
one AS (SELECT id, avg(v / 255) AS m, stddev_pop(v / 255) AS s FROM z GROUP BY id)
SELECT round(avg(m), 3) AS mean_r, round(avg(m), 3) AS mean_g, round(avg(m), 3) AS mean_b,
       round(avg(s), 3) AS std_r, round(avg(s), 3) AS std_g, round(avg(s), 3) AS std_b, count(*) AS n_images
FROM one
"""


def q_normalised_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Plain bilinear to 4 x 4, normalised per channel."""
    px = normalise_pixels(_pixel_rows(spark, sf), size=4)
    return px.select("path", F.posexplode("pixels").alias("n", "v")).groupBy("path").agg(
        _r(F.sum(F.when(F.col("n") % 3 == 0, F.col("v").cast("double"))), 3).alias("red"),
        _r(F.sum(F.when(F.col("n") == 28, F.col("v").cast("double"))), 3).alias("one"))


SQL_NORMALISED_PIXELS = _SQL_PX + _sql_resized(4, "plain", "z") + """
SELECT id AS path, round(sum((v / 255 - 0.273) / 0.131), 3) AS red,
       round(sum(CASE WHEN oy * 4 + ox = 9 THEN (v / 255 - 0.337) / 0.124 END), 3) AS one
FROM z GROUP BY id
"""


def _channel_sum(data: str, pixels: int, channel: int, weight: Callable):
    """Sum of one channel over the first ``pixels`` RGB pixels, pixel i by
    ``weight(i)``; the bytes are taken apart once, as Latin-1 characters."""
    chars = F.slice(F.split(F.decode(data, "ISO-8859-1"), ""), 1, 3 * pixels)
    parts = F.transform(chars, lambda c, i: F.when(i % 3 == channel, weight(F.floor(i / 3)) * F.ascii(c)).otherwise(0).cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def q_upscaled_images(spark: SparkSession, sf: str) -> DataFrame:
    """Both methods, written as an image table and read back."""
    path = scratch_path(spark, "upscaled")
    rows = _pixel_rows(spark, sf)
    write_image_table(upscale(rows), path)
    back = spark.read.parquet(path)
    return back.select("filename", "method", "height", "width", _channel_sum("data", 16 * 16, 0, lambda i: i % 13 + 1).alias("weighted"))


SQL_UPSCALED_IMAGES = _SQL_PX + _sql_resized(16, "bilinear", "zb") + "," + _sql_resized(16, "lanczos", "zl") + """,
every AS (SELECT 'bilinear' AS method, * FROM zb UNION ALL SELECT 'lanczos', * FROM zl)
SELECT id AS filename, method, CAST(16 AS INTEGER) AS height, CAST(16 AS INTEGER) AS width,
       CAST(sum(((oy * 16 + ox) % 13 + 1) * v) AS BIGINT) AS weighted
FROM every GROUP BY id, method
"""


# the same images in colour (D.coloured_images); each channel is an image of its own in SQL
_SQL_COLOURED = _SQL_PX.replace("WITH px AS", "WITH grey AS") + """
px AS (SELECT id || '|0' AS id, y, x, v FROM grey UNION ALL SELECT id || '|1', y, x, 255 - v FROM grey UNION ALL SELECT id || '|2', y, x, floor(v / 3) FROM grey),"""
_SQL_CHANNEL = "split_part(id, '|', 1) AS {name}, CAST(split_part(id, '|', 2) AS INTEGER) AS channel"


def q_coloured_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """B20 on images in colour: each channel by its own mean and deviation."""
    px = normalise_pixels(as_bgr(D.coloured_images(spark, sf)), size=4).select("path", F.posexplode("pixels").alias("n", "v"))
    place = F.floor(F.col("n") / 3).cast("int")
    return px.groupBy("path", (F.col("n") % 3).alias("channel")).agg(_r(F.sum((place % 5 + 1) * F.col("v").cast("double")), 3).alias("weighted"))


SQL_COLOURED_PIXELS = _SQL_COLOURED + _sql_resized(4, "plain", "z") + f"""
SELECT path, channel, round(sum(((oy * 4 + ox) % 5 + 1) * CAST(CAST((v / 255 - [{', '.join(map(str, NORM_MEAN))}][channel + 1])
       / [{', '.join(map(str, NORM_STD))}][channel + 1] AS FLOAT) AS DOUBLE)), 3) AS weighted
FROM (SELECT {_SQL_CHANNEL.format(name='path')}, oy, ox, v FROM z) GROUP BY path, channel
"""


def q_coloured_upscaled(spark: SparkSession, sf: str) -> DataFrame:
    """I8 on images in colour: every byte of every channel."""
    up = upscale(as_bgr(D.coloured_images(spark, sf)), methods=("bilinear",))
    totals = [_channel_sum("data", 16 * 16, c, lambda i: i % 13 + 1) for c in range(3)]
    return up.select("filename", F.posexplode(F.array(*totals)).alias("channel", "weighted"))


SQL_COLOURED_UPSCALED = _SQL_COLOURED + _sql_resized(16, "bilinear", "z") + f"""
SELECT filename, channel, CAST(sum(((oy * 16 + ox) % 13 + 1) * v) AS BIGINT) AS weighted
FROM (SELECT {_SQL_CHANNEL.format(name='filename')}, oy, ox, v FROM z) GROUP BY filename, channel
"""


def q_loaded_images(spark: SparkSession, sf: str) -> DataFrame:
    """Image files with names of all kinds, some cut short, decoded."""
    folder = D.image_files(spark, sf, scratch_path(spark, "image-files"))
    totals = [_channel_sum("data", 64, i, lambda i: i + 1).alias(c) for i, c in enumerate(("red", "green", "blue"))]
    return load_images(spark, folder).select("filename", "height", "width", *totals,
                                             F.col("error").isNotNull().alias("failed"))


SQL_LOADED_IMAGES = _SQL_COLOURED.rstrip().rstrip(",") + """,
s AS (SELECT split_part(id, '|', 1) AS vec, CAST(sum((y * 8 + x + 1) * v) FILTER (WHERE id LIKE '%|0') AS BIGINT) AS red,
             CAST(sum((y * 8 + x + 1) * v) FILTER (WHERE id LIKE '%|1') AS BIGINT) AS green,
             CAST(sum((y * 8 + x + 1) * v) FILTER (WHERE id LIKE '%|2') AS BIGINT) AS blue FROM px GROUP BY ALL),
f AS (SELECT *, CAST(vec AS BIGINT) AS n, CAST(vec AS BIGINT) % 7 = 0 AS failed FROM s)
SELECT CASE n % 3 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE 'p' END || vec || '.png' AS filename,
       CAST(CASE WHEN NOT failed THEN 8 END AS INTEGER) AS height, CAST(CASE WHEN NOT failed THEN 8 END AS INTEGER) AS width,
       CASE WHEN NOT failed THEN red END AS red, CASE WHEN NOT failed THEN green END AS green, CASE WHEN NOT failed THEN blue END AS blue, failed FROM f
"""


def _scorer_of_weights(weights):
    """Set-up of a scorer: its weights, spread over as many elements as it meets."""
    import numpy as np

    def score(pdf):
        x = np.stack(pdf["embedding"].to_numpy()).astype("float32").astype("float64")
        return x @ weights[: x.shape[1]]

    return score


def q_batch_score_model(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer that each worker sets up once, its weights from a broadcast."""
    import numpy as np

    i = np.arange(4096)
    weights = spark.sparkContext.broadcast(np.where(i % 2 == 0, 8.0, -8.0) / (i // 2 + 1))
    emb = D.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("filename"), "embedding")
    out = batch.batch_score(emb, batch.Model(_scorer_of_weights, weights), ["embedding"], key="filename", threshold=THRESHOLD)
    return out.select("filename", "prediction", _r("probability").alias("probability"), _r("logit").alias("logit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "label_fusion": q_label_fusion,
    "fusion_stats": q_fusion_stats,
    "band_predictions": q_band_predictions,
    "prediction_summary": q_prediction_summary,
    "binary_report": q_binary_report,
    "confusion_binary": q_confusion_binary,
    "split_sizes": q_split_sizes,
    "evaluate_split": q_evaluate_split,
    "brier_and_accuracy": q_brier_and_accuracy,
    "loss_summary": q_loss_summary,
    "parse_verdicts": q_parse_verdicts,
    "confusion_matrix": q_confusion_matrix,
    "classification_report": q_classification_report,
    "select_uncertain": q_select_uncertain,
    "select_uncertain_overflow": q_select_uncertain_overflow,
    "annotation_rejects": q_annotation_rejects,
    "pending_urls": q_pending_urls,
    "resume_summary": q_resume_summary,
    "ingest_plan": q_ingest_plan,
    "ingest_summary": q_ingest_summary,
    "batch_score": q_batch_score,
    "batch_annotate": q_batch_annotate,
    "annotate_resumed": q_annotate_resumed,
    "validate_annotator": q_validate_annotator,
    "validate_matrix": q_validate_matrix,
    "epoch_metrics": q_epoch_metrics,
    "best_epoch": q_best_epoch,
    "vector_channel_stats": q_vector_channel_stats,
    "label_encoding": q_label_encoding,
    "url_names": q_url_names,
    "platt_calibration": q_platt_calibration,
    "train_head": q_train_head,
    "incremental_annotate": q_incremental_annotate,
    "labelled_urls": q_labelled_urls,
    "labelled_rejects": q_labelled_rejects,
    "unknown_labels": q_unknown_labels,
    "gt_tokens": q_gt_tokens,
    "http_lines": q_http_lines,
    "uncertain_predictions": q_uncertain_predictions,
    "confident_predictions": q_confident_predictions,
    "pos_weight": q_pos_weight,
    "fetch_error_log": q_fetch_error_log,
    "train_split_sizes": q_train_split_sizes,
    "labelled_ingest": q_labelled_ingest,
    "ingest_collisions": q_ingest_collisions,
    "fetch_isolated": q_fetch_isolated,
    "event_split": q_event_split,
    "label_split_sizes": q_label_split_sizes,
    "band_edge_cases": q_band_edge_cases,
    "parse_verdicts_edge": q_parse_verdicts_edge,
    "numeric_predictions": q_numeric_predictions,
    "hot_key_report": q_hot_key_report,
    "csv_by_name": q_csv_by_name,
    "tsv_without_last_rows": q_tsv_without_last_rows,
    "jsonl_append": q_jsonl_append,
    "uncertain_file": q_uncertain_file,
    "saved_calibrator": q_saved_calibrator,
    "first_listed": q_first_listed,
    "attach_images": q_attach_images,
    "listed_files": q_listed_files,
    "attached_contents": q_attached_contents,
    "ingest_overwrite": q_ingest_overwrite,
    "image_channel_stats": q_image_channel_stats,
    "normalised_pixels": q_normalised_pixels,
    "upscaled_images": q_upscaled_images,
    "coloured_pixels": q_coloured_pixels,
    "coloured_upscaled": q_coloured_upscaled,
    "loaded_images": q_loaded_images,
    "batch_score_model": q_batch_score_model,
}

ORACLE_SQL: dict[str, str] = {
    "label_fusion": SQL_LABEL_FUSION,
    "fusion_stats": SQL_FUSION_STATS,
    "band_predictions": SQL_BAND_PREDICTIONS,
    "prediction_summary": SQL_PREDICTION_SUMMARY,
    "binary_report": SQL_BINARY_REPORT,
    "confusion_binary": SQL_CONFUSION_BINARY,
    "split_sizes": SQL_SPLIT_SIZES,
    "evaluate_split": SQL_EVALUATE_SPLIT,
    "brier_and_accuracy": SQL_BRIER_AND_ACCURACY,
    "loss_summary": SQL_LOSS_SUMMARY,
    "parse_verdicts": SQL_PARSE_VERDICTS,
    "confusion_matrix": SQL_CONFUSION_MATRIX,
    "classification_report": SQL_CLASSIFICATION_REPORT,
    "select_uncertain": _sql_select("(n_bad + (n - n_bad) // 3)"),
    "select_uncertain_overflow": _sql_select("(n_bad // 2)"),
    "annotation_rejects": SQL_ANNOTATION_REJECTS,
    "pending_urls": SQL_PENDING_URLS,
    "resume_summary": SQL_RESUME_SUMMARY,
    "ingest_plan": SQL_INGEST_PLAN,
    "ingest_summary": SQL_INGEST_SUMMARY,
    "batch_score": SQL_BAND_PREDICTIONS,
    "batch_annotate": _sql_batch_annotate(),
    "annotate_resumed": _sql_annotate_resumed(),
    "validate_annotator": _sql_validate_annotator(),
    "validate_matrix": _sql_validate_matrix(),
    "epoch_metrics": SQL_EPOCH_METRICS,
    "best_epoch": SQL_BEST_EPOCH,
    "vector_channel_stats": SQL_VECTOR_CHANNEL_STATS,
    "label_encoding": SQL_LABEL_ENCODING,
    "url_names": SQL_URL_NAMES,
    "incremental_annotate": _sql_batch_annotate(),
    "labelled_urls": SQL_LABELLED_URLS,
    "labelled_rejects": SQL_LABELLED_REJECTS,
    "gt_tokens": SQL_GT_TOKENS,
    "http_lines": SQL_HTTP_LINES,
    "uncertain_predictions": SQL_UNCERTAIN_PREDICTIONS,
    "confident_predictions": SQL_CONFIDENT_PREDICTIONS,
    "pos_weight": SQL_POS_WEIGHT,
    "fetch_error_log": SQL_FETCH_ERROR_LOG,
    "platt_calibration": SQL_PLATT_CALIBRATION,
    "train_head": SQL_TRAIN_HEAD,
    "train_split_sizes": SQL_TRAIN_SPLIT_SIZES,
    "labelled_ingest": SQL_LABELLED_INGEST,
    "ingest_collisions": SQL_INGEST_COLLISIONS,
    "fetch_isolated": SQL_FETCH_ISOLATED,
    "event_split": SQL_EVENT_SPLIT,
    "label_split_sizes": SQL_LABEL_SPLIT_SIZES,
    "band_edge_cases": SQL_BAND_EDGE_CASES,
    "parse_verdicts_edge": SQL_PARSE_VERDICTS_EDGE,
    "numeric_predictions": SQL_NUMERIC_PREDICTIONS,
    "hot_key_report": SQL_HOT_KEY_REPORT,
    "csv_by_name": SQL_CSV_BY_NAME,
    "tsv_without_last_rows": SQL_TSV_WITHOUT_LAST_ROWS,
    "jsonl_append": SQL_JSONL_APPEND,
    "uncertain_file": SQL_UNCERTAIN_FILE,
    "saved_calibrator": SQL_PLATT_CALIBRATION,
    "first_listed": SQL_FIRST_LISTED,
    "attach_images": SQL_ATTACH_IMAGES,
    "unknown_labels": SQL_UNKNOWN_LABELS,
    "listed_files": SQL_LISTED_FILES,
    "coloured_pixels": SQL_COLOURED_PIXELS,
    "coloured_upscaled": SQL_COLOURED_UPSCALED,
    "loaded_images": SQL_LOADED_IMAGES,
    "batch_score_model": SQL_BAND_PREDICTIONS,
    "attached_contents": SQL_ATTACHED_CONTENTS,
    "ingest_overwrite": SQL_INGEST_OVERWRITE,
    "image_channel_stats": SQL_IMAGE_CHANNEL_STATS,
    "normalised_pixels": SQL_NORMALISED_PIXELS,
    "upscaled_images": SQL_UPSCALED_IMAGES,
}
