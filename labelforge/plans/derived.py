"""Inputs derived by Spark from the driver's tables.

The driver's tables hold no predictions, verdicts or URL lists, so the query
catalogue derives them deterministically (every row of the source table is
used; the derivations grow with the tables):

* **S** (scores) from ``embeddings``: the dot product of all elements with
  the weights 8, -8, 4, -4, 8/3, -8/3, ... (each element cast to double), truth
  ``label < 5``.
* **V** (verdicts) from ``events``: the model text of a stub annotator whose
  verdict comes from ``props.k``: ``class_id = k % 3 + 1``, confidence
  ``k / 100``; the JSON type of ``class_id`` depends on ``event_type`` (text
  for views, a fraction 2 above the class for purchases, absent for
  signups); errors are labelled ``bad``; every 17th event is prose, every
  17th + 1 has trailing prose after the JSON.  The annotation JSONL of the
  same run has a broken line every 19th and a blank one every 23rd event.
* **pages**: the URL list; pages under ``/de/`` are already annotated (their
  JSONL record is broken when the URL ends ``#top``); pages under ``/en/``
  already have their image file; a ``#top`` URL fails to fetch.

Each derivation has a DuckDB twin in ``plans.catalog``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelforge.files import open_folder, write_whole
from labelforge.operators.partitioning import spread_scan

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- S (scores)

def score_logit(embedding: str = "embedding") -> Column:
    """Element i (from 0) weighs 8 / (i div 2 + 1), every second one negative."""
    def term(v, i):
        size = F.lit(8.0) / F.floor(i / 2 + 1).cast("double")
        return v.cast("double") * F.when(i % 2 == 0, size).otherwise(-size)
    return F.aggregate(F.transform(embedding, term), F.lit(0.0), lambda acc, v: acc + v)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename, logit`` for every embedding."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("filename"), score_logit().alias("logit"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename, label`` (1 when the embedding label is below 5)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("filename"),
                      F.when(F.col("label") < 5, F.lit(1)).otherwise(F.lit(0)).alias("label"))


def stub_scorer(pdf: pd.DataFrame) -> np.ndarray:
    """Batch scorer used by the catalogue: the S logit, computed in numpy."""
    x = np.stack(pdf["embedding"].to_numpy()).astype("float32").astype("float64")
    i = np.arange(x.shape[1])
    return x @ (np.where(i % 2 == 0, 8.0, -8.0) / (i // 2 + 1))


# -------------------------------------------------------------- V (verdicts)

def _verdict_parts(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    cls = k % 3 + 1
    conf = F.format_string("%.2f", (k / F.lit(100.0)).cast("double"))
    label = (F.when(F.col("event_type") == "error", F.lit("bad"))
             .when(cls == 1, F.lit("coniferous")).when(cls == 2, F.lit("deciduous")).otherwise(F.lit("bad")))
    class_json = (F.when(F.col("event_type") == "view", F.concat(F.lit('"'), cls.cast("string"), F.lit('"')))
                  .when(F.col("event_type") == "purchase", F.concat((cls + 2).cast("string"), F.lit(".5")))
                  .otherwise(cls.cast("string")))
    verdict_json = F.when(
        F.col("event_type") == "signup", F.concat(F.lit('{"label": "'), label, F.lit('"}'))
    ).otherwise(F.concat(F.lit('{"class_id": '), class_json, F.lit(', "label": "'), label,
                         F.lit('", "confidence": '), conf, F.lit("}")))
    return events.select("event_id", label.alias("label_txt"), verdict_json.alias("verdict_json"))


def verdict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, url, model_text``: what the stub annotator answered per event."""
    ev = _verdict_parts(spread_scan(table(spark, sf_dir, "events")))
    m = F.col("event_id") % 17
    text = (F.when(m == 0, F.concat(F.lit("The main tree looks "), F.col("label_txt")))
            .when(m == 1, F.concat(F.col("verdict_json"), F.lit(" I am fairly sure.")))
            .otherwise(F.concat(F.lit("```json\n"), F.col("verdict_json"), F.lit("\n```"))))
    return ev.select(F.col("event_id").alias("seq"),
                     F.concat(F.lit("https://img.example.org/"), F.col("event_id").cast("string"),
                              F.lit(".jpg")).alias("url"),
                     text.alias("model_text"))


def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: the annotation JSONL of the stub run, one line per event."""
    ev = _verdict_parts(spread_scan(table(spark, sf_dir, "events")))
    url = F.concat(F.lit("https://img.example.org/"), F.col("event_id").cast("string"), F.lit(".jpg"))
    pred = F.when(F.col("event_id") % 17 == 0, F.lit('{"class_id": 3, "label": "bad_parse"}')) \
        .otherwise(F.col("verdict_json"))
    record = F.concat(F.lit('{"url": "'), url, F.lit('", "model": "stub", "prediction": '), pred, F.lit("}"))
    line = (F.when(F.col("event_id") % 19 == 0, F.substring(record, 1, 25))
            .when(F.col("event_id") % 23 == 0, F.lit(""))
            .otherwise(record))
    return ev.select(F.col("event_id").alias("seq"), line.alias("value"))


# ------------------------------------------------------------------- pages

def url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: the URL list (one line per page, page_id = position)."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("value"))


def processed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: the existing annotation output for pages under /de/."""
    pages = table(spark, sf_dir, "pages").filter(F.col("url").contains("/de/"))
    record = F.concat(F.lit('{"url": "'), F.col("url"),
                      F.lit('", "model": "stub", "prediction": {"class_id": 1, "label": "coniferous"}}'))
    line = F.when(F.col("url").endswith("#top"), F.substring(record, 1, 30)).otherwise(record)
    return pages.select(F.col("page_id").alias("seq"), line.alias("value"))


def existing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename``: images already on disk (pages under /en/)."""
    pages = table(spark, sf_dir, "pages").filter(F.col("url").contains("/en/"))
    return pages.select(F.format_string("%06d.jpg", F.col("page_id")).alias("filename"))


def stub_fetcher(pdf: pd.DataFrame) -> pd.DataFrame:
    """Batch fetcher used by the catalogue: the page's html is its content;
    a ``#top`` URL fails."""
    fails = pdf["url"].str.endswith("#top")
    content = pdf["html"].where(~fails, None) if "html" in pdf else pd.Series([b""] * len(pdf))
    return pd.DataFrame({"content": content.values,
                         "error": np.where(fails, "unreachable", None)})


def stub_annotator(pdf: pd.DataFrame) -> list[str]:
    """Batch annotator used by the catalogue: a verdict from the characters of
    the content and its letters e (every 7th number answers in prose)."""
    out = []
    for text in pdf["content"]:
        n = len(text or "") + (text or "").count("e")
        cls = n % 3 + 1
        label = {1: "coniferous", 2: "deciduous", 3: "bad"}[cls]
        if n % 7 == 0:
            out.append("I cannot tell.")
        else:
            out.append('```json\n{"class_id": %d, "label": "%s", "confidence": %.2f}\n```'
                       % (cls, label, (n % 100) / 100.0))
    return out


def gt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, html, gt_label``: labelled URLs for validation (https -> 1)."""
    pages = spread_scan(table(spark, sf_dir, "pages"))
    return pages.select("url", "html",
                        F.when(F.col("url").startswith("https"), F.lit(1)).otherwise(F.lit(2)).alias("gt_label"))


# ------------------------------------------------------------ scored batches

def scored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``epoch, batch, loss, correct`` from events: day number, hour, value,
    and whether the event is not an error."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("epoch"),
        F.hour("ts").alias("batch"),
        F.col("value").alias("loss"),
        (F.col("event_type") != "error").alias("correct"),
    )


# ---------------------------------------------------- text lines from pages

def _page_label_text() -> Column:
    text = F.when(F.col("url").startswith("https"), F.lit("TRUE")).otherwise(F.lit("FALSE"))
    return F.when(F.col("url").contains("/fr/"), F.lower(text)).otherwise(text)


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: a labelled URL list (label TAB url); French pages write
    the label in lower case, ``#top`` pages lose the TAB (malformed)."""
    pages = table(spark, sf_dir, "pages")
    sep = F.when(F.col("url").endswith("#top"), F.lit(" ")).otherwise(F.lit("\t"))
    return pages.select(F.col("page_id").alias("seq"), F.concat(_page_label_text(), sep, F.col("url")).alias("value"))


def gt_token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: free-form truth lines; English pages put the label
    first, French pages last, German pages have none, the rest carry two
    label tokens (the last one counts)."""
    pages = table(spark, sf_dir, "pages")
    label = F.when(F.col("url").startswith("https"), F.lit("TRUE")).otherwise(F.lit("FALSE"))
    value = (F.when(F.col("url").contains("/en/"), F.concat(label, F.lit("  "), F.col("url")))
             .when(F.col("url").contains("/fr/"), F.concat(F.col("url"), F.lit(" "), label))
             .when(F.col("url").contains("/de/"), F.col("url"))
             .otherwise(F.concat(F.lit("FALSE "), F.col("url"), F.lit(" "), label)))
    return pages.select(F.col("page_id").alias("seq"), value.alias("value"))


def http_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: a URL file with padding, blank lines (German pages)
    and prose without a link (``#top`` pages)."""
    pages = table(spark, sf_dir, "pages")
    value = (F.when(F.col("url").endswith("#top"), F.lit("no link here"))
             .when(F.col("url").contains("/de/"), F.lit(""))
             .otherwise(F.concat(F.lit("  "), F.col("url"), F.lit(" "))))
    return pages.select(F.col("page_id").alias("seq"), value.alias("value"))


# ------------------------------------------------------------------- files

def write_files(rows: DataFrame, folder: str) -> str:
    """A file in ``folder`` for each row (name, content), written by its task."""
    name, content = rows.columns

    def run(batches):
        for pdf in batches:
            store, root = open_folder(folder)
            for n, c in zip(pdf[name], pdf[content], strict=True):
                write_whole(store, f"{root}/{n}", [c.encode() if isinstance(c, str) else c or b""])
            yield pdf[[name]]

    rows.mapInPandas(run, f"{name} string").count()
    return folder


def png(rgb: np.ndarray) -> bytes:
    """An H x W x 3 array as a PNG file."""
    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    lines = b"".join(b"\0" + line.tobytes() for line in np.ascontiguousarray(rgb, np.uint8))
    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def coloured_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the image source: an 8 x 8 image of each embedding, whose red is
    the element's value, green its complement and blue a third of it."""
    def value(v):
        return F.least(F.greatest(F.floor((v.cast("double") + 4) * 32), F.lit(0)), F.lit(255))

    def pixel(v):
        return F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (F.floor(value(v) / 3), 255 - value(v), value(v))])  # BGR

    data = F.unhex(F.array_join(F.transform("embedding", pixel), ""))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"),
                                                     F.lit(3).alias("n_channels"), data.alias("data"))


def image_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The coloured images as PNG files, under names that begin with a letter,
    ``_`` or ``.``; every seventh file is cut short."""
    def run(batches):
        for pdf in batches:
            number = pdf["path"].astype(int)
            files = [png(np.frombuffer(d, np.uint8).reshape(8, 8, 3)[..., ::-1]) for d in pdf["data"]]
            yield pd.DataFrame({"name": [f"{'_.p'[n % 3]}{n}.png" for n in number], "content": [f[:40] if n % 7 == 0 else f for f, n in zip(files, number, strict=True)]})

    return write_files(spread_scan(coloured_images(spark, sf_dir)).mapInPandas(run, "name string, content binary"), folder)
