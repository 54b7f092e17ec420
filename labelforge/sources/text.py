"""Line-oriented sources.

Each reader is ``read_lines`` (a text scan with the exact 0-based line
position attached once, at read time) followed by a ``parse_*`` operator that
works on any ``(seq, value)`` frame, so the same logic runs on files and on
lines Spark derives from tables.  Rejected lines come back as a second frame
from the same scan, never as a driver-side list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelforge.errors import require_path
from labelforge.fixed import BAND_FALSE, BAND_TRUE, HEADER_MARKERS, LABELLED_NAME_WIDTH, URL_NAME_WIDTH
from labelforge.functions.labels import label_from_text
from labelforge.functions.text import contains_http, is_blank, positional_name, starts_with_http, strip_ws
from labelforge.operators.ordering import with_line_position


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(seq BIGINT, value STRING)``: every line with its position in file
    order (CR of CRLF ends removed by the line reader)."""
    require_path(spark, path)
    return with_line_position(spark.read.text(path), "seq")


def _after_header(lines: DataFrame, header_lines: int) -> DataFrame:
    # position among the lines after the header, as the reference enumerates them
    return (lines.filter(F.col("seq") >= header_lines)
            .withColumn("pos", F.col("seq") - F.lit(header_lines)))


def parse_labelled_lines(lines: DataFrame, header_lines: int = 1, width: int = LABELLED_NAME_WIDTH):
    """A1 on ``(seq, value)``: returns ``(rows, rejects)``.

    rows: ``pos, filename, label, url, label_text`` for lines that split into
    exactly two TAB parts; label 1 iff the text is exactly ``TRUE``; the name
    is ``%03d.jpg`` of the position (dropped lines still advance it).
    rejects: ``pos, value, reason`` for malformed non-blank lines."""
    body = _after_header(lines, header_lines).filter(~is_blank("value"))
    parts = F.split(strip_ws("value"), "\t", -1)
    shaped = body.withColumn("__parts", parts)
    ok = F.size("__parts") == 2
    rows = shaped.filter(ok).select(
        "pos",
        positional_name("pos", width).alias("filename"),
        label_from_text(F.col("__parts")[0], "binary").alias("label"),
        F.col("__parts")[1].alias("url"),
        F.col("__parts")[0].alias("label_text"),
    )
    rejects = shaped.filter(~ok).select("pos", "value", F.lit("malformed: expected 2 TAB parts").alias("reason"))
    return rows, rejects


def parse_url_lines(lines: DataFrame, header_lines: int = 1, width: int = URL_NAME_WIDTH):
    """A2 on ``(seq, value)``: returns ``(rows, failed)``.

    rows: ``pos, filename, url`` - the name is the last ``/`` segment when it
    ends ``.jpg``, else ``%06d.jpg`` of the position.
    failed: non-blank lines not starting with ``http``."""
    body = _after_header(lines, header_lines).filter(~is_blank("value")).withColumn("url", strip_ws("value"))
    valid = starts_with_http("url")
    last = F.try_element_at(F.split("url", "/", -1), F.lit(-1))
    rows = body.filter(valid).select(
        "pos",
        F.when(last.endswith(".jpg"), last).otherwise(positional_name("pos", width)).alias("filename"),
        "url",
    )
    failed = body.filter(~valid).select("pos", "url", F.lit("invalid line").alias("reason"))
    return rows, failed


def parse_gt_tokens(lines: DataFrame) -> DataFrame:
    """A3 on ``(seq, value)``: ``seq, url, gt_label`` (1 = TRUE, 2 = FALSE).

    A header is any line holding both ``is_conifer`` and ``downloadUrl``;
    tokens split on whitespace; the last token containing ``http`` is the
    URL and the last exact TRUE / FALSE token the label; rows need both."""
    v = strip_ws("value")
    tokens = F.filter(F.split(v, r"\s+", -1), lambda t: t != "")
    url = F.try_element_at(F.filter(tokens, lambda t: t.contains("http")), F.lit(-1))
    label_tok = F.try_element_at(F.filter(tokens, lambda t: t.isin("TRUE", "FALSE")), F.lit(-1))
    header = F.col("value").contains(HEADER_MARKERS[0]) & F.col("value").contains(HEADER_MARKERS[1])
    return (lines.filter(~header & ~is_blank("value"))
            .select("seq", url.alias("url"), label_from_text(label_tok, "verdict").alias("gt_label"))
            .filter(F.col("url").isNotNull() & F.col("gt_label").isNotNull()))


def parse_http_lines(lines: DataFrame) -> DataFrame:
    """A4 on ``(seq, value)``: stripped non-blank lines containing ``http``
    (duplicates and order kept)."""
    v = strip_ws("value")
    return lines.select("seq", v.alias("url")).filter((F.col("url") != "") & contains_http("url"))


def unknown_label_texts(rows: DataFrame) -> DataFrame:
    """A1: ``label_text, n`` of the label texts other than TRUE and FALSE, all
    of which count as label 0 (summed map-side, a row a text)."""
    return (rows.filter(~F.col("label_text").isin(BAND_TRUE, BAND_FALSE)).groupBy("label_text")
            .agg(F.count(F.lit(1)).alias("n")))


def read_labelled_urls(spark: SparkSession, path: str, header_lines: int = 1):
    """A1 from a TSV file."""
    return parse_labelled_lines(read_lines(spark, path), header_lines)


def read_url_list(spark: SparkSession, path: str, header_lines: int = 1):
    """A2 from a text file."""
    return parse_url_lines(read_lines(spark, path), header_lines)


def read_gt_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A3 from a text file."""
    return parse_gt_tokens(read_lines(spark, path))


def read_http_lines(spark: SparkSession, path: str) -> DataFrame:
    """A4 from a text file."""
    return parse_http_lines(read_lines(spark, path))


def read_tsv(spark: SparkSession, path: str, schema=None, drop_last: int = 0) -> DataFrame:
    """TAB-separated file with a header; ``drop_last`` removes that many
    final rows (by line position, no driver-side slicing)."""
    require_path(spark, path)
    reader = spark.read.option("sep", "\t").option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if drop_last <= 0:
        return df
    numbered = with_line_position(df, "__row")
    keep = numbered.count() - drop_last  # one count action; rows are numbered 0..n-1
    return numbered.filter(F.col("__row") < F.lit(keep)).drop("__row")
