"""URL ingest planning (A2 + D4 + I3) and its summary."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelforge.operators.batch import FETCH_BATCH, fetch_part, fetched_schema, in_order, timed
from labelforge.operators.joins import skip_existing
from labelforge.operators.select import union_all
from labelforge.session import materialize, scratch_path
from labelforge.sources.text import parse_labelled_lines, parse_url_lines


def ingest_plan(lines: DataFrame, files: DataFrame, header_lines: int = 1, overwrite: bool = False,
                labelled: bool = False) -> DataFrame:
    """``pos, filename, url, status`` for every valid line: ``exists`` when the
    destination file is present (unless ``overwrite``), else ``fetch``.
    Labelled lines (A1) also carry ``label``."""
    if labelled:
        rows, _ = parse_labelled_lines(lines, header_lines)
    else:
        rows, _ = parse_url_lines(lines, header_lines)
    return skip_existing(rows, files, "filename", overwrite)


def fetch_plan(plan: DataFrame, fetcher, concurrency: int | None = None, content_type="binary",
               timeout: float | None = None, batch_size: int = FETCH_BATCH, name: str = "filename",
               pos: str = "pos") -> DataFrame:
    """I3 + D4 over a whole plan: rows to ``fetch`` become ``ok`` or
    ``error: ...`` (with ``content``), the others pass.

    Of rows with one name the first that succeeds is kept; those after it are
    ``exists``, and one is tried only when all before it failed.  Rows are laid
    out in ranges of (name, position) before anything is fetched, and a task
    goes through its names in order.  The answers are written where they were
    fetched and read back: no URL is fetched twice, and no shuffle carries a
    content.  A range border can cut a name, one name a border; the first
    success of such a name is found without contents and broadcast."""
    at_once = max(1, concurrency or 1)
    laid = plan.repartitionByRange(name, pos).sortWithinPartitions(name, pos)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = timed(fetcher, timeout)
        done: set = set()  # of the current name only: names come in order

        def passed(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.assign(content=None)

        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                pdf = pdf.reset_index(drop=True)
                todo = pdf[pdf["status"] == "fetch"].drop(columns="status")
                if len(todo) < len(pdf):
                    yield passed(pdf[pdf["status"] != "fetch"])
                while len(todo):
                    known = todo[name].isin(done)
                    if known.any():
                        yield passed(todo[known].assign(status="exists"))
                        todo = todo[~known]
                    rows = todo[~todo.duplicated(name)]  # the next row of every name
                    todo = todo.drop(rows.index)
                    parts = [rows.iloc[i:i + batch_size] for i in range(0, len(rows), batch_size)]
                    for out in in_order(pool, lambda part: fetch_part(call, part), parts, at_once):
                        done.update(out.loc[out["status"] == "ok", name])
                        yield out
                done &= set(pdf[name].iloc[-1:])

    schema = fetched_schema(plan.drop("status"), content_type)
    spark, path = plan.sparkSession, scratch_path(plan.sparkSession, "fetched")
    laid.mapInPandas(lambda it: (x[[f.name for f in schema.fields]] for x in run(it)), schema).write.parquet(path)
    fetched = spark.read.schema(schema).parquet(path)
    place, tried = F.col(pos), F.col("status") != "exists"
    cut = materialize(fetched.select(name, pos, "status").groupBy(F.col(name).alias("__lf_name"))
                      .agg(F.min(F.when(F.col("status") == "ok", place)).alias("__lf_first"), F.max(F.when(tried, place)).alias("__lf_last"))
                      .where("__lf_first < __lf_last").drop("__lf_last"))
    joined = fetched.join(F.broadcast(cut), fetched[name] == cut["__lf_name"], "left")
    late = F.coalesce(place > F.col("__lf_first"), F.lit(False))
    return joined.select(*[f.name for f in plan.drop("status").schema.fields], F.when(~late, F.col("content")).alias("content"),
                         F.when(late, F.lit("exists")).otherwise(F.col("status")).alias("status"))


def ingest_failures(lines: DataFrame, header_lines: int = 1, labelled: bool = False) -> DataFrame:
    """The invalid lines of the same scan."""
    if labelled:
        _, bad = parse_labelled_lines(lines, header_lines)
        return bad
    _, bad = parse_url_lines(lines, header_lines)
    return bad


def ingest_summary(lines: DataFrame, outcome: DataFrame, header_lines: int = 1,
                   labelled: bool = False) -> DataFrame:
    """``total`` (every line after the header, blanks included),
    ``downloaded`` (status ok), ``skipped`` (exists) and ``failed`` (invalid
    lines plus fetch errors), and ``kept`` (rows whose image is present after
    the run: what labelled mode reports and writes).  ``outcome`` is the plan
    after fetching."""
    body = lines.filter(F.col("seq") >= header_lines)
    invalid = ingest_failures(lines, header_lines, labelled)
    s = F.col("status")
    tagged = union_all(body.select(F.lit("line").alias("status")), invalid.select(F.lit("failed").alias("status")), outcome.select("status"))
    return tagged.agg(
        F.count_if(s == "line").alias("total"),
        F.count_if(s == "ok").alias("downloaded"),
        F.count_if(s == "exists").alias("skipped"),
        F.count_if((s == "failed") | s.startswith("error")).alias("failed"),
        F.count_if(s.isin("ok", "exists")).alias("kept"),
    )


def labels_output(outcome: DataFrame) -> DataFrame:
    """Labelled mode: existing and fetched rows go to the labels table,
    failed fetches do not."""
    return outcome.filter(F.col("status").isin("ok", "exists")).select("filename", "label")
