"""Job-level entry points with the reference's parameter names.

Each function reads its inputs with the engine's sources, runs the operator
chain and writes its outputs with the engine's sinks.  Models, annotators and
fetchers are the caller's batch functions.  Wherever a step calls the outside
world (fetch, annotate, score), its result is landed once in the shared
checkpoint folder before it feeds several outputs, so a retried task or a
second action never calls the outside world again for the same rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelforge.errors import path_exists, require_rows
from labelforge.functions.labels import uncertainty_band
from labelforge.functions.verdict import is_object
from labelforge.operators import batch as B
from labelforge.operators import images as I
from labelforge.operators.calibrate import (
    calibration_report, fit_platt, load_calibrator, save_calibrator,
)
from labelforge.operators.fusion import fuse_labels, fusion_stats
from labelforge.operators.ingest import fetch_plan, ingest_plan, ingest_summary, labels_output
from labelforge.operators.joins import pending, resume_summary
from labelforge.operators.metrics import binary_report, classification_report, confusion_matrix, prediction_summary
from labelforge.operators.select import quota_fill, selection_order
from labelforge.operators.split import EVAL_FRACTIONS, restrict_to_split, stratified_split
from labelforge.schemas import PREDICTION_COLUMNS
from labelforge.session import materialize, scratch_path
from labelforge.sinks.files import to_jsonl, write_csv, write_jsonl, write_uncertain
from labelforge.sinks.image_store import append, read_store, replace
from labelforge.sinks.line_log import Journal, append_lines, forget, unfinished
from labelforge.sources.annotations import read_annotations, read_processed_urls
from labelforge.sources.tables import read_labels, read_predictions
from labelforge.sources.text import parse_labelled_lines, read_gt_tokens, read_http_lines, read_lines, unknown_label_texts

from labelforge.fixed import (
    ANNOTATE_BATCH, FETCH_CONCURRENCY, IMG_SIZE, INGEST_TIMEOUT, SCORE_BATCH, SEED, SELECT_TARGET, UNCERTAINTY_THRESHOLD,
    UPSCALE_FACTOR,
    UPSCALE_METHODS,
)


#: Annotations that a task makes before it saves them, and rows of a task.
FLUSH_ROWS = 64
TASK_ROWS = 20_000


# ----------------------------------------------------------------- fusion

def fuse(spark: SparkSession, crowd_path: str, model_path: str, output_path: str | None = None):
    """Fuse crowd and model labels (D2, E1); writes ``filename, final_label``."""
    crowd, model = read_labels(spark, crowd_path), read_labels(spark, model_path)
    fused = fuse_labels(crowd, model)
    if output_path:
        write_csv(fused, output_path, ["filename", "final_label"])
    return fused, fusion_stats(crowd, model)


# ----------------------------------------------------------------- ingest

def ingest(spark: SparkSession, input_path: str, image_store: str, fetcher, type: str = "markup",  # noqa: A002
           labels_path: str | None = None, overwrite: bool = False,
           concurrency: int = FETCH_CONCURRENCY, timeout: float = INGEST_TIMEOUT) -> DataFrame:
    """Fetch the images of a URL list into an image table.

    ``type`` is ``markup`` (TSV of label + URL, names ``%03d.jpg``) or
    ``no_markup`` (URL per line, names from the URL or ``%06d.jpg``).  Names
    already in ``image_store`` are skipped unless ``overwrite``; fetched images
    are added to it, and with ``overwrite`` take the place of those with their
    names (a fetch that fails leaves the old one); in markup mode the labels of existing and
    fetched rows go to ``labels_path``.  Returns the one-row summary; in markup
    mode with ``unknown_labels``, the rows whose label text is neither TRUE nor
    FALSE (they count as 0, ``sources.text.unknown_label_texts``)."""
    if type not in ("markup", "no_markup"):
        raise ValueError(f"unknown ingest type: {type!r}")
    labelled = type == "markup"
    lines = read_lines(spark, input_path)
    files = (read_store(spark, image_store).select("filename") if path_exists(spark, image_store)
             else spark.createDataFrame([], "filename string"))
    # landed before anything is appended to the store, so the existing-file
    # test can never see this run's own downloads
    plan = materialize(ingest_plan(lines, files, overwrite=overwrite, labelled=labelled))
    fetched = fetch_plan(plan, fetcher, concurrency, "binary", timeout)
    images = fetched.filter(F.col("status") == "ok").select("filename", "content")
    if overwrite:
        replace(images, image_store)
    else:
        append(images, image_store)
    outcome = fetched.drop("content")
    if labelled and labels_path:
        write_csv(labels_output(outcome), labels_path, ["filename", "label"])
    summary = ingest_summary(lines, outcome, labelled=labelled)
    if not labelled:
        return summary
    rows, _ = parse_labelled_lines(lines)
    unknown = unknown_label_texts(rows).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    return summary.withColumn("unknown_labels", F.lit(unknown).cast("long"))


# ------------------------------------------------------------- evaluation

def evaluate(spark: SparkSession, predictions: str, labels: str, subset: str = "all",
             seed: int = SEED) -> DataFrame:
    """Evaluate a predictions CSV against a labels CSV (D1, H1/H2, E3).  The
    split is computed on the whole labels table before the join."""
    preds = read_predictions(spark, predictions, "filename", "prediction")
    truth = read_labels(spark, labels).select("filename", F.col("label").cast("double").cast("int").alias("label"))
    if subset != "all":
        split = stratified_split(truth, fractions=EVAL_FRACTIONS, seed=seed)
        preds = restrict_to_split(preds, split, subset)
    # a file whose predictions are all numbers holds 1 and 0, not texts
    number = F.col("prediction").try_cast("double")
    texts = preds.filter(F.col("prediction").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("k")).first()
    return binary_report(preds, truth, numeric_prediction=0 < texts["n"] == texts["k"])


def calibrate(spark: SparkSession, predictions: str, labels: str, output: str) -> DataFrame:
    """Fit Platt scaling on logits (I6), save it (K5), report Brier and
    accuracy raw vs calibrated (E6, E7)."""
    preds = read_predictions(spark, predictions, "filename", "logit")
    truth = read_labels(spark, labels).select("filename", F.col("label").cast("double").cast("int").alias("label"))
    joined = materialize(preds.join(truth, "filename"))
    model = fit_platt(joined)
    save_calibrator(model, output)
    return calibration_report(joined, model)


# -------------------------------------------------------------- inference

def infer(spark: SparkSession, input_dir: str, output_csv: str, scorer,
          uncertainty_threshold: float = UNCERTAINTY_THRESHOLD, use_calibrated: bool = False,
          calibrator_path: str | None = None, batch_size: int = SCORE_BATCH, img_size: int = IMG_SIZE) -> DataFrame:
    """Score the images of a folder and band them (A9, A10, B20, I1, I5, B9,
    K1, K3, E8).  ``scorer`` receives batches with a ``pixels`` column (flat
    normalised H x W x 3 floats) and returns one logit per row.  An
    undecodable image is banded ``?`` with its error (never scored black)."""
    # the reference scans *.jpg and *.png (case-sensitive): a filter, no join
    names = I.list_images(spark, input_dir, ("jpg", "png"), case_sensitive=True)
    require_rows(names.select("path"), f"image folder {input_dir}")  # A11: no images -> typed error
    images = I.decoded_images(spark, input_dir).filter(F.col("path").rlike(r"\.(jpg|png)$"))
    calibrator = load_calibrator(calibrator_path) if use_calibrated and calibrator_path else None
    # pixels are made and scored in one Python stage
    scored = B.batch_score(images, scorer, ["pixels"], key="path", threshold=uncertainty_threshold, batch_size=batch_size,
                           calibrator=calibrator, failed="error", prepare=I.with_pixels(img_size))
    results = materialize(scored.withColumn("filename", F.element_at(F.split("filename", "/"), -1)))
    write_csv(results.orderBy("filename"), output_csv, PREDICTION_COLUMNS)
    write_uncertain(results, os.path.join(os.path.dirname(output_csv.rstrip("/")), "uncertain.csv"))
    return prediction_summary(results)


def band(df: DataFrame, uncertainty_threshold: float = UNCERTAINTY_THRESHOLD, prob: str = "probability") -> DataFrame:
    """B9 on an existing predictions frame."""
    return df.withColumn("prediction", uncertainty_band(prob, uncertainty_threshold))


# ------------------------------------------------------------- annotation

def annotate(spark: SparkSession, input: str, output: str, annotator, fetcher,  # noqa: A002
             model_id: str = "stub", batch_size: int = ANNOTATE_BATCH, concurrency: int | None = None,
             retry_errors: bool = False, flush_rows: int = FLUSH_ROWS) -> DataFrame:
    """Resumable annotation (A4, A8, D3, E15, I2, K2 append).  Returns the
    ``total / processed / to_do`` summary taken before the run.

    One Spark job; every task saves its answers after each ``flush_rows`` of
    them (``sinks.line_log``), so a task that is tried again, or the next run
    after a job that died, asks only for what came after.  ``retry_errors``
    takes URLs whose records all have an error again."""
    urls = read_http_lines(spark, input)
    done = materialize(read_processed_urls(spark, output, skip_errors=retry_errors))
    summary = materialize(resume_summary(urls, done))
    todo = pending(urls, done)
    kinds = "url string, status string, model_text string, error string, answered_at double"
    folders = unfinished(output)
    answers = spark.read.schema(kinds).json(folders) if folders else spark.createDataFrame([], kinds)
    if retry_errors:
        answers = answers.filter(F.col("error").isNull())
    # written, so that a task that is tried again gets the same rows
    path = scratch_path(spark, "pending-urls")
    todo.join(answers.dropDuplicates(["url"]), "url", "left").write.parquet(path)
    tasks = max(spark.sparkContext.defaultParallelism, -(-summary.first()["to_do"] // TASK_ROWS))
    job = uuid.uuid4().hex
    waiting = spark.read.schema(f"seq bigint, {kinds}").parquet(path).select(todo.columns + list(B.ANSWER)).repartition(tasks)
    out = B.annotate(waiting, annotator, fetcher, model_id=model_id, batch_size=batch_size, concurrency=concurrency,
                     journal=lambda: Journal(output, job, flush_rows), saved=True)
    append_lines(to_jsonl(out, ("url", "timestamp", "model", "error", "prediction")), output, job)
    forget(output)
    return summary


def validate(spark: SparkSession, input: str, output: str, annotator, fetcher,  # noqa: A002
             batch_size: int = ANNOTATE_BATCH, content_type: str = "binary"):
    """Validate an annotator on labelled URLs.
    Returns ``(matrix, report)``."""
    gt = read_gt_tokens(spark, input)
    out = materialize(B.validate_annotator(gt, annotator, fetcher, batch_size=batch_size,
                                           content_type=content_type))
    records = out.filter("written")  # an inference failure counts but writes no record
    write_jsonl(B.with_lineage(records).select("url", "timestamp", "gt_label", "error", "prediction"), output)
    return (confusion_matrix(out, "gt_label", "pred_class", (1, 2, 3)),
            classification_report(out, "gt_label", "pred_class", (1, 2, 3)))


def _record_with_confidence(record, prediction, fill: bool):
    """The record with ``prediction.confidence = 0.0`` added when missing."""
    if not fill:
        return record
    pred_map = F.variant_get(prediction, "$", "map<string,variant>")
    filled = F.when(F.map_contains_key(pred_map, "confidence"), pred_map).otherwise(
        F.map_concat(pred_map, F.create_map(F.lit("confidence"), F.lit(0.0).cast("variant"))))
    rec_map = F.variant_get(record, "$", "map<string,variant>")
    rebuilt = F.to_variant_object(F.map_concat(F.map_filter(rec_map, lambda k, v: k != "prediction"),
                                               F.create_map(F.lit("prediction"), F.to_variant_object(filled))))
    return F.when(is_object(prediction), rebuilt).otherwise(record)


def select(spark: SparkSession, input: str, output: str, target: int = SELECT_TARGET) -> DataFrame:  # noqa: A002
    """Choose the bad and least-confident annotations for human work
    (A7, B13, B14, F1, F2, K2).  The output keeps every bad record in file
    order, then the candidates by rising confidence; a candidate without a
    confidence is written with ``confidence: 0.0``."""
    records, _ = read_annotations(spark, input)
    chosen = quota_fill(records, target)
    rendered = chosen.select(
        *[c.alias(f"__lf_o{i}") for i, c in enumerate(selection_order(chosen))],
        F.to_json(F.when(F.col("bucket") == "candidate",
                         _record_with_confidence(F.col("record"), F.col("prediction"), True))
                  .otherwise(F.col("record"))).alias("value"),
    )
    ordered = rendered.orderBy(*[c for c in rendered.columns if c != "value"]).select("value")
    ordered.write.mode("overwrite").text(output)
    return chosen


# ------------------------------------------------------------------ images

def image_statistics(spark: SparkSession, folder: str, img_size: int = IMG_SIZE) -> DataFrame:
    """Channel mean / std of a folder of images."""
    return I.channel_stats(I.image_channel_stats(I.decoded_images(spark, folder), img_size))


def upscale_directory(spark: SparkSession, input_dir: str, output_dir: str, scale: int = UPSCALE_FACTOR,
                      methods=UPSCALE_METHODS) -> DataFrame:
    """Upscale every image with every method into a table partitioned by
    method (I8, K4); returns the failures (reported, skipped)."""
    up = materialize(I.upscale(I.decoded_images(spark, input_dir), scale, methods))
    I.write_image_table(up, output_dir)
    return up.filter(F.col("error").isNotNull()).select("method", "filename", "error")
