"""Incremental annotation (J1): a Structured Streaming job over a folder of
URL list files.

New files are picked up by ``readStream.text``.  The URLs the stream has seen
are its keyed state (``dropDuplicates`` in RocksDB stores, checkpointed to the
shared folder by their changes), so a micro-batch looks up its own URLs and
never reads what earlier ones wrote: a URL is annotated once, however often it
is listed.  URLs of outputs from before the stream are written once to an index
in buckets of their hash; a micro-batch reads the buckets its URLs fall in.

Each micro-batch is annotated and written to ``<output>/batch_id=<id>`` with
overwrite, so one replayed after a failure (from the state of the batch before)
rewrites its own folder.  ``trigger(availableNow=True)`` processes what is there
and stops.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelforge.errors import path_exists
from labelforge.functions.text import contains_http, strip_ws
from labelforge.operators.batch import annotate
from labelforge.operators.joins import pending
from labelforge.session import scratch_path
from labelforge.sinks.files import write_jsonl
from labelforge.sources.annotations import parse_annotation_lines, processed_urls_from_lines

# Index of the URLs of earlier outputs; a leading underscore keeps it out of
# Spark's listing of the output folder.
SEED_INDEX = "_seed_urls"
#: Buckets of that index.
BUCKETS = 256

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _bucket():
    return F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int")


def write_seed_index(urls: DataFrame, path: str) -> None:
    """The distinct URLs of earlier outputs, one folder a bucket."""
    (urls.withColumn("bucket", _bucket()).repartition(BUCKETS, "bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def without_seeds(urls: DataFrame, path: str) -> DataFrame:
    """``urls`` (a written table) that are not in the index; only the buckets
    that they fall in are read."""
    spark = urls.sparkSession
    buckets = [r["b"] for r in urls.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS numbers at most
    seeds = spark.read.schema("url string, bucket int").parquet(path).filter(F.col("bucket").isin(buckets)).select("url")
    return pending(urls, seeds)


def annotate_incremental(spark: SparkSession, url_dir: str, output: str, annotator, fetcher,
                         checkpoint: str | None = None, enrich=None, model_id: str = "stub",
                         content_type: str | None = None, seed_outputs: tuple[str, ...] = (),
                         available_now: bool = True):
    """Start (and, with ``available_now``, finish) the incremental job.

    ``enrich`` optionally maps the batch's ``url`` frame to the fetcher's
    input (for example joining page content); it must keep ``url``.
    ``seed_outputs`` are earlier outputs whose URLs also count as done.
    ``content_type`` is not needed any more: contents do not leave the task."""
    checkpoint = checkpoint or scratch_path(spark, "annotate-stream")
    lines = spark.readStream.text(url_dir)
    urls = lines.select(strip_ws("value").alias("url")).filter((F.col("url") != "") & contains_http("url"))

    seed_index = os.path.join(output, SEED_INDEX)
    seeds = [p for p in seed_outputs if path_exists(spark, p)]
    if seeds and not path_exists(spark, seed_index):
        # earlier outputs are parsed once
        write_seed_index(processed_urls_from_lines(spark.read.text(seeds)), seed_index)
    seeded = path_exists(spark, seed_index)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # written once: every use of ``batch`` would run the stateful stage again
        new = scratch_path(spark, "stream-urls")
        batch.write.parquet(new)
        todo = spark.read.schema("url string").parquet(new)
        todo = without_seeds(todo, seed_index) if seeded else todo
        out = annotate(enrich(todo) if enrich is not None else todo, annotator, fetcher, model_id=model_id)
        # one folder per micro-batch, overwritten on replay: exactly-once output
        write_jsonl(out.select("url", "timestamp", "model", "error", "prediction"),
                    os.path.join(output, f"batch_id={batch_id}"), mode="overwrite")

    writer = urls.dropDuplicates(["url"]).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    try:  # a stream keeps the settings it is started with
        for name, value in STATE_CONF.items():
            spark.conf.set(name, value)
        query = writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    if available_now:
        query.awaitTermination()
    return query


def read_annotation_output(spark: SparkSession, output: str) -> DataFrame:
    """The appended JSONL with the typed verdict columns."""
    records, _ = parse_annotation_lines(spark.read.text(output).withColumn("seq", F.lit(0).cast("long")))
    return records


def annotate_pages_incrementally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue form: the pages' URLs land as a text folder in the shared
    checkpoint folder, the existing /de/ output is the seed, the stream
    annotates the rest; the result is what the stream appended."""
    from labelforge.plans import derived as D
    base = scratch_path(spark, "incremental")
    url_dir = os.path.join(base, "urls")
    seed = os.path.join(base, "seed")
    output = os.path.join(base, "out")
    pages = D.table(spark, sf_dir, "pages")
    pages.select("url").write.mode("overwrite").text(url_dir)
    D.processed_lines(spark, sf_dir).select("value").write.mode("overwrite").text(seed)

    def enrich(batch: DataFrame) -> DataFrame:
        return batch.join(pages.select("url", "html"), "url")

    annotate_incremental(spark, url_dir, output, D.stub_annotator, D.stub_fetcher,
                         checkpoint=os.path.join(base, "ckpt"), enrich=enrich, content_type="string",
                         seed_outputs=(seed,))
    out = read_annotation_output(spark, output)
    verdict_parsed = ~F.coalesce(F.col("label") == "bad_parse", F.lit(False)) & F.col("error").isNull()
    return out.withColumn("parsed", verdict_parsed)
