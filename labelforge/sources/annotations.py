"""Annotation JSONL (A7) and the processed-URL set.

Each line is parsed strictly (``functions.verdict.parse_strict``) into a
VARIANT record.  A blank line is skipped; a non-blank line that is not a
strict JSON object is a reject (reported by position, not fatal).  The typed
view of the record's ``prediction`` is added with native VARIANT expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelforge.errors import path_exists
from labelforge.functions.text import is_blank, strip_ws
from labelforge.functions.verdict import (
    coerce_class_id, fill_confidence, is_bad, is_object, label_text, parse_strict,
)
from labelforge.operators.select import distinct_keys
from labelforge.sources.text import read_lines


def parse_annotation_lines(lines: DataFrame):
    """A7 on ``(seq, value)``: returns ``(records, rejects)``.

    records: ``seq, record VARIANT, url, error, prediction VARIANT,
    prediction_ok, class_id, label, confidence, is_bad``.  A missing
    ``prediction`` is ``{}``; a prediction that is not an object is read as a
    bad verdict (decision: never a crash)."""
    body = lines.filter(~is_blank("value")).select("seq", parse_strict(strip_ws("value")).alias("record"),
                                                   "value")
    rejects = body.filter(F.col("record").isNull()).select("seq", "value")
    good = body.filter(F.col("record").isNotNull())
    raw_pred = F.try_variant_get("record", "$.prediction", "variant")
    pred = F.when(raw_pred.isNull(), F.parse_json(F.lit("{}"))).otherwise(raw_pred)
    records = good.select("seq", "record", pred.alias("prediction")).select(
        "seq", "record",
        F.try_variant_get("record", "$.url", "string").alias("url"),
        F.try_variant_get("record", "$.error", "string").alias("error"),
        "prediction",
        is_object("prediction").alias("prediction_ok"),
    )
    ok = F.col("prediction_ok")
    records = records.select(
        "*",
        F.when(ok, coerce_class_id("prediction")).otherwise(F.lit(3)).alias("class_id"),
        F.when(ok, label_text("prediction")).otherwise(F.lit("bad_parse")).alias("label"),
        F.when(ok, fill_confidence("prediction")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, is_bad("prediction")).otherwise(F.lit(True)).alias("is_bad"),
    )
    return records, rejects


def read_annotations(spark: SparkSession, path: str):
    """A7 from a JSONL file or folder."""
    return parse_annotation_lines(read_lines(spark, path))


def processed_urls_from_lines(lines: DataFrame, skip_errors: bool = False) -> DataFrame:
    """A8 on ``(seq, value)``: distinct URLs of lines that parse and carry a
    text ``url`` (blank, broken and url-less lines are ignored; with
    ``skip_errors`` so are records with an error)."""
    records = lines.select(parse_strict(strip_ws("value")).alias("record"))
    if skip_errors:
        records = records.filter(F.try_variant_get("record", "$.error", "string").isNull())
    return distinct_keys(records.select(F.try_variant_get("record", "$.url", "string").alias("url")), "url")


def read_processed_urls(spark: SparkSession, path: str, skip_errors: bool = False) -> DataFrame:
    """A8 from the annotation output; an absent output is an empty set."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "url string")
    return processed_urls_from_lines(spark.read.text(path).withColumn("seq", F.lit(0).cast("long")), skip_errors)
