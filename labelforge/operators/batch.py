"""Batch jobs around caller-supplied batch functions.

The engine never hosts a model or an HTTP client.  The caller passes plain
batch functions over pandas frames; Spark partitions the rows, ships Arrow
batches to Python workers, and does everything else (anti join, error
routing, parsing, banding, metrics) with native expressions.

* scorer(pdf) -> sequence of logits, one per row
* fetcher(pdf) -> DataFrame with ``content`` (str/bytes or None) and ``error``
  (str or None), one row per input row; a failure is a value, never a crash
* annotator(pdf with ``content``) -> sequence of model texts, one per row

A batch function that raises marks its rows (``error``) instead of failing
the task.  Because an annotator may be non-deterministic, the job writes its
output once and reads it back (``labelforge.api.annotate``), so a retried task or a
second action never calls the model again for the same rows.
"""

from __future__ import annotations

import inspect
import time
import uuid
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from labelforge.functions.labels import sigmoid, uncertainty_band
from labelforge.functions.text import path_basename
from labelforge.functions.verdict import (
    coerce_class_id, fetch_error_verdict, fill_confidence, label_text, with_verdict,
)
from labelforge.operators.joins import pending
from labelforge.sinks.line_log import Journal

from labelforge.fixed import ANNOTATE_BATCH, ANNOTATE_TIMEOUT, SCORE_BATCH, UNCERTAINTY_THRESHOLD

#: Rows that a fetcher is given at once.
FETCH_BATCH = 32


def _chunks(pdf: pd.DataFrame, size: int):
    for start in range(0, len(pdf), max(1, size)):
        yield pdf.iloc[start:start + size]


def _append_field(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType(list(schema.fields) + list(fields))


#: Batch functions that this worker has set up, by the model's key.
_MADE: OrderedDict[str, Callable] = OrderedDict()
#: Models that a worker keeps.
_KEPT = 4


@dataclass(frozen=True)
class Model:
    """A batch function with a set-up.  ``make(weights)`` is called once in
    each Python worker, not in each task or batch, and returns the function;
    ``weights`` is a broadcast that Spark sends to each executor once, or None.
    Takes the place of any scorer, annotator or fetcher.  A set-up that raises
    fails the task."""

    make: Callable[[object], Callable]
    weights: object = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def ready(fn: Callable | Model) -> Callable:
    """The batch function to call in this worker."""
    if not isinstance(fn, Model):
        return fn
    if fn.key not in _MADE:
        _MADE[fn.key] = fn.make(None if fn.weights is None else fn.weights.value)
        while len(_MADE) > _KEPT:
            _MADE.popitem(last=False)
    _MADE.move_to_end(fn.key)
    return _MADE[fn.key]


def score_logits(df: DataFrame, scorer: Callable[[pd.DataFrame], object] | Model,
                 input_cols: list[str], batch_size: int = SCORE_BATCH, failed: str | None = None,
                 prepare: Callable[[pd.DataFrame], pd.DataFrame] | None = None, keep: list[str] | None = None) -> DataFrame:
    """I1 core: add ``logit`` (and ``score_error``) by calling ``scorer`` on
    micro-batches of ``input_cols``; no shuffle.  Rows with a text in the column
    ``failed`` are not scored and keep that text as their error.  ``prepare``
    makes input columns (and errors) in the same Python stage; ``keep`` names
    the columns that go back to the JVM (all of ``df`` if None)."""
    keep = df.columns if keep is None else keep
    out_schema = _append_field(T.StructType([df.schema[c] for c in keep]), T.StructField("logit", T.DoubleType()),
                               T.StructField("score_error", T.StringType()))
    out_cols = [*keep, "logit", "score_error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = ready(scorer)
        for pdf in batches:
            pdf = prepare(pdf) if prepare else pdf
            if failed is not None:
                out = pdf[failed].notna()
                if out.any():
                    yield pdf[out].assign(logit=float("nan"), score_error=pdf.loc[out, failed])[out_cols]
                pdf = pdf[~out]
            for part in _chunks(pdf, batch_size):
                part = part.copy()
                try:
                    logits = pd.Series(list(call(part[input_cols])), index=part.index, dtype="float64")
                    part["logit"] = logits
                    part["score_error"] = None
                except Exception as exc:  # noqa: BLE001 - a failed batch is data
                    part["logit"] = float("nan")
                    part["score_error"] = f"score: {exc}"
                yield part[out_cols]

    return df.mapInPandas(run, out_schema)


def batch_score(df: DataFrame, scorer, input_cols: list[str], key: str = "filename",
                threshold: float = UNCERTAINTY_THRESHOLD, batch_size: int = SCORE_BATCH,
                calibrator=None, failed: str | None = None,
                prepare: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """``filename, prediction, probability, logit`` (+ ``error``).

    Probability is the calibrator's P(1) when one is given (I5), else the
    sigmoid; a row whose scoring failed is banded ``?`` and keeps its error
    (decision: never score a substitute black image silently).  ``prepare``:
    see ``score_logits``."""
    scored = score_logits(df, scorer, input_cols, batch_size, failed, prepare, [key])
    logit = F.when(F.col("score_error").isNull(), F.col("logit"))
    scored = scored.withColumn("logit", logit)
    if calibrator is not None:
        from labelforge.operators.calibrate import apply_calibration
        scored = apply_calibration(scored, calibrator, "logit", "probability")
    else:
        scored = scored.withColumn("probability", sigmoid("logit"))
    band = F.when(F.col("score_error").isNotNull(), F.lit("?")).otherwise(uncertainty_band("probability", threshold))
    return scored.select(F.col(key).alias("filename"), band.alias("prediction"), "probability", "logit",
                         F.col("score_error").alias("error"))


def _accepts_timeout(fn) -> bool:
    try:
        params = inspect.signature(fn).parameters
    except (TypeError, ValueError):
        return False
    return "timeout" in params or any(p.kind == p.VAR_KEYWORD for p in params.values())


def timed(fetcher, timeout: float | None):
    """The fetcher, with the seconds allowed for each URL if it takes them."""
    fetcher = ready(fetcher)
    if timeout is None or not _accepts_timeout(fetcher):
        return fetcher
    return lambda pdf: fetcher(pdf, timeout=timeout)


def fetch_part(call, part: pd.DataFrame) -> pd.DataFrame:
    """``part`` with content and status.  A call that raises (or answers with
    another number of rows) is made again row by row, so that only the rows at
    fault fail."""
    try:
        got = call(part)
        content, errors = list(got["content"]), list(got["error"])
        if len(content) != len(part):
            raise ValueError(f"{len(content)} answers for {len(part)} rows")
    except Exception as exc:  # noqa: BLE001
        if len(part) > 1:
            return pd.concat([fetch_part(call, part.iloc[i:i + 1]) for i in range(len(part))])
        content, errors = [None], [str(exc)]
    out = part.copy()
    status = ["ok" if e is None or (isinstance(e, float) and pd.isna(e)) else f"error: {e}" for e in errors]
    out["content"] = pd.Series([c if s == "ok" else None for c, s in zip(content, status)], index=out.index, dtype="object")
    out["status"] = status
    return out


def in_order(pool: ThreadPoolExecutor, work, parts: Iterator, ahead: int) -> Iterator:
    """``work`` on each part with at most ``ahead`` at once, in order."""
    waiting: deque = deque()
    for part in parts:
        waiting.append(pool.submit(work, part))
        if len(waiting) >= ahead:
            yield waiting.popleft().result()
    while waiting:
        yield waiting.popleft().result()


def fetched_schema(df: DataFrame, content_type: T.DataType | str) -> T.StructType:
    if isinstance(content_type, str):
        content_type = {"binary": T.BinaryType(), "string": T.StringType()}[content_type]
    return _append_field(df.schema, T.StructField("content", content_type), T.StructField("status", T.StringType()))


def fetch(df: DataFrame, fetcher: Callable[[pd.DataFrame], pd.DataFrame], concurrency: int | None = None,
          content_type: T.DataType | str = "binary", timeout: float | None = None,
          batch_size: int = FETCH_BATCH) -> DataFrame:
    """Add ``content`` and ``status`` (``ok`` or ``error: ...``).

    The fetcher is called on at most ``batch_size`` rows and each answer goes
    on at once, so a task holds ``batch_size * concurrency`` contents.  A call
    that raises is made again row by row.  ``concurrency`` is the number of
    calls that a task makes at the same time (the fetcher runs in threads then);
    ``timeout`` (seconds for each URL) is passed to a fetcher that takes a
    ``timeout`` keyword.  A failed row is not tried again."""
    at_once = max(1, concurrency or 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = timed(fetcher, timeout)
        parts = (part for pdf in batches for part in _chunks(pdf, batch_size))
        with ThreadPoolExecutor(at_once) as pool:
            yield from in_order(pool, lambda part: fetch_part(call, part), parts, at_once)

    return df.mapInPandas(run, fetched_schema(df, content_type))


#: What ``answer`` makes of a row, besides its key.
ANSWER = ("status", "model_text", "error", "answered_at")


def answer(df: DataFrame, annotator, fetcher, key: str = "url", batch_size: int = ANNOTATE_BATCH,
           concurrency: int | None = None, timeout: float | None = ANNOTATE_TIMEOUT,
           journal: Callable[[], Journal] | None = None, saved: bool = False) -> DataFrame:
    """I3 + I2 in one Python stage: ``key`` and ANSWER of every row.  Contents
    are fetched, given to the annotator and let go in the task; they never
    reach the JVM.

    A fetch that fails passes with its error; a micro-batch whose annotator
    raises marks its rows.  With a ``journal`` answers are saved as they come,
    and rows whose key an earlier attempt has answered take that answer; with
    ``saved`` rows whose column ``status`` is not null hold one already."""
    at_once = max(1, concurrency or 1)
    names = [f.name for f in df.schema.fields if f.name not in (ANSWER if saved else ())]
    out = [key, *ANSWER]

    def annotated(part: pd.DataFrame, ask: Callable) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        ok = part["status"] == "ok"
        part["model_text"] = None
        part["error"] = part["status"].where(~ok).str.replace(r"^error: ", "", regex=True)
        todo = part[ok]
        if len(todo):
            try:
                texts = list(ask(todo[[*names, "content", "status"]]))
                part.loc[todo.index, "model_text"] = pd.Series(texts, index=todo.index, dtype="object")
            except Exception as exc:  # noqa: BLE001 - a failed batch is data
                part.loc[todo.index, "error"] = f"inference: {exc}"
        part["answered_at"] = time.time()
        return part[out].astype({"model_text": object, "error": object}).where(lambda x: x.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, ask = timed(fetcher, timeout), ready(annotator)
        book = journal() if journal else None
        before = {a[key]: a for a in book.saved()} if book else {}
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                if saved:
                    has = pdf["status"].notna()
                    if has.any():
                        yield pdf.loc[has, out]
                    pdf = pdf.loc[~has, names]
                if before:
                    has = pdf[key].isin(before)
                    if has.any():
                        yield pd.DataFrame([before[k] for k in pdf.loc[has, key]], columns=out)
                    pdf = pdf[~has]
                for fetched in in_order(pool, lambda part: fetch_part(call, part), _chunks(pdf, FETCH_BATCH), at_once):
                    # failed fetches take no place in a micro-batch
                    good = fetched["status"] == "ok"
                    for part in (fetched[~good], *_chunks(fetched[good], batch_size)):
                        if len(part):
                            done = annotated(part, ask)
                            if book:
                                book.add(done.to_dict("records"))
                            yield done
        if book:
            book.flush()

    kinds = {key: df.schema[key].dataType.simpleString(), "answered_at": "double"}
    return df.mapInPandas(run, ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in out))


def call_annotator(df: DataFrame, annotator: Callable[[pd.DataFrame], object],
                   batch_size: int = ANNOTATE_BATCH, status: str | None = None) -> DataFrame:
    """Add ``model_text``, ``error`` and ``answered_at`` (B15: the time of each
    record) by calling ``annotator`` per micro-batch of ``batch_size`` rows; a
    failing batch marks its rows with the error.

    With ``status`` (the fetch status column), only ``ok`` rows are given to
    the annotator; the others pass through with the fetch error, so routing
    needs no second branch over the fetched rows (which would fetch twice)."""
    out_schema = _append_field(df.schema, T.StructField("model_text", T.StringType()),
                               T.StructField("error", T.StringType()), T.StructField("answered_at", T.DoubleType()))
    cols = [f.name for f in df.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = ready(annotator)
        for pdf in batches:
            pdf = pdf[cols].copy()
            pdf["model_text"] = None
            pdf["error"] = None
            pdf["answered_at"] = time.time()
            if status is not None:
                failed = pdf[status] != "ok"
                pdf.loc[failed, "error"] = pdf.loc[failed, status].str.replace(r"^error: ", "", regex=True)
                todo = pdf[~failed]
            else:
                todo = pdf
            for part in _chunks(todo, batch_size):
                try:
                    texts = list(ask(part[cols]))
                    pdf.loc[part.index, "model_text"] = pd.Series(texts, index=part.index, dtype="object")
                except Exception as exc:  # noqa: BLE001
                    pdf.loc[part.index, "error"] = f"inference: {exc}"
                pdf.loc[part.index, "answered_at"] = time.time()
            yield pdf

    return df.mapInPandas(run, out_schema)


def _typed(records: DataFrame) -> DataFrame:
    return records.select(
        "*",
        coerce_class_id("prediction").alias("class_id"),
        label_text("prediction").alias("label"),
        fill_confidence("prediction").alias("confidence"),
    )


def annotate(urls: DataFrame, annotator, fetcher, done: DataFrame | None = None,
             key: str = "url", model_id: str = "stub", batch_size: int = ANNOTATE_BATCH,
             concurrency: int | None = None, content_type: str | None = None,
             timeout: float | None = ANNOTATE_TIMEOUT,
             journal: Callable[[], Journal] | None = None, saved: bool = False) -> DataFrame:
    """I2 (lazy): pending rows (D3) -> fetch (I3), annotator and error routing
    (B16) in one stage -> strict parse (B12) -> lineage (B15).

    Columns: url, timestamp, model, error, prediction (VARIANT), parsed,
    class_id, label, confidence.  ``done`` is the already-written output's
    URL set (A8); a URL whose fetch failed before is in it too, so it is
    not retried (pass a ``done`` without error rows to retry them).
    ``content_type`` is not needed any more: contents do not leave the task.
    ``journal`` and ``saved``: see ``answer``."""
    todo = urls if done is None else pending(urls, done, key)
    answered = answer(todo, annotator, fetcher, key, batch_size, concurrency, timeout, journal, saved)
    answered = with_verdict(answered, "model_text", "__lf_pred", "__lf_parsed")
    annotated_ok = (F.col("status") == "ok") & F.col("error").isNull()
    out = answered.select(
        F.col(key).alias("url"),
        F.col("answered_at").alias("timestamp"),
        F.lit(model_id).alias("model"),
        "error",
        F.when(annotated_ok, F.col("__lf_pred")).otherwise(fetch_error_verdict()).alias("prediction"),
        F.when(annotated_ok, F.col("__lf_parsed")).otherwise(F.lit(False)).alias("parsed"),
    )
    return _typed(out)


def _answered(gt: DataFrame, annotator, fetcher, key: str, batch_size: int, content_type: str, timeout: float | None) -> DataFrame:
    """``key``, gt_label and ANSWER of every row, in one Python stage: contents
    are fetched, given to the annotator (as bytes or text, by ``content_type``)
    and let go in the task, and no wide column returns to the JVM."""
    out = [key, "gt_label", *ANSWER]
    kinds = {key: gt.schema[key].dataType, "gt_label": gt.schema["gt_label"].dataType, "answered_at": T.DoubleType()}

    def typed(content):
        if content_type == "binary" and isinstance(content, str):
            return content.encode()
        return bytes(content).decode() if content_type == "string" and isinstance(content, (bytes, bytearray)) else content

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, ask = timed(fetcher, timeout), ready(annotator)
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            status, texts, errors = ([None] * len(pdf) for _ in range(3))
            times = [time.time()] * len(pdf)

            def asked(part: pd.DataFrame) -> None:
                for group in _chunks(part, batch_size):
                    try:
                        given = pd.Series(list(ask(group)), index=group.index, dtype="object")
                        for i, text in given.items():
                            texts[i] = None if pd.isna(text) else text
                    except Exception as exc:  # noqa: BLE001 - a failed batch is data
                        for i in group.index:
                            errors[i] = f"inference: {exc}"
                    for i in group.index:
                        times[i] = time.time()

            held, n_held = [], 0  # fetched rows that do not fill a micro-batch yet
            for part in _chunks(pdf, FETCH_BATCH):
                fetched = fetch_part(call, part)
                fetched["content"] = pd.Series([typed(c) for c in fetched["content"]], index=fetched.index, dtype="object")
                for i, s in fetched["status"].items():
                    status[i] = s
                    errors[i] = None if s == "ok" else s.removeprefix("error: ")
                good = fetched[fetched["status"] == "ok"]
                held.append(good)
                n_held += len(good)
                if n_held >= batch_size:
                    whole, n_held = pd.concat(held), n_held % max(1, batch_size)
                    asked(whole.iloc[: len(whole) - n_held])
                    held = [whole.iloc[len(whole) - n_held :]]
            asked(pd.concat(held) if held else pdf)
            yield pdf[[key, "gt_label"]].assign(status=status, model_text=pd.Series(texts, dtype="object"),
                                                error=pd.Series(errors, dtype="object"), answered_at=times)[out]

    return gt.mapInPandas(run, T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in out]))


def validate_annotator(gt: DataFrame, annotator, fetcher, key: str = "url",
                       batch_size: int = ANNOTATE_BATCH, content_type: str = "string",
                       timeout: float | None = ANNOTATE_TIMEOUT) -> DataFrame:
    """I4: annotate labelled URLs (no resume), carrying ``gt_label``.

    Fetch, inference and parse failures all count as class 3.  ``written``
    is false for rows whose inference failed: they count in the metrics but
    the reference writes no record for them.  A task holds the contents of one
    call of the fetcher and of one micro-batch."""
    answered = _answered(gt, annotator, fetcher, key, batch_size, content_type, timeout)
    answered = with_verdict(answered, "model_text", "__lf_pred", "__lf_parsed")
    fetched_ok = F.col("status") == "ok"
    inferred = fetched_ok & F.col("error").isNull()
    out = _typed(answered.select(
        F.col(key).alias("url"), F.col("answered_at").alias("timestamp"), "gt_label", "error",
        F.when(inferred, F.col("__lf_pred")).otherwise(fetch_error_verdict()).alias("prediction"),
        F.when(inferred, F.col("__lf_parsed")).otherwise(F.lit(False)).alias("parsed"),
        # a fetch failure is written; an inference failure counts but is not
        (~fetched_ok | inferred).alias("written"),
    ))
    # validation reads the class as int(class_id) of the parsed verdict
    return out.withColumn("pred_class", F.when(F.col("written"), F.col("class_id")).otherwise(F.lit(3)))


def with_lineage(df: DataFrame, model_id: str | None = None, gt_label: str | None = None) -> DataFrame:
    """Processing time (epoch seconds, double; the record's own where it
    has one), model id, truth label."""
    out = df if "timestamp" in df.columns else df.withColumn(
        "timestamp", F.unix_micros(F.current_timestamp()).cast("double") / F.lit(1e6))
    if model_id is not None:
        out = out.withColumn("model", F.lit(model_id))
    if gt_label is not None:
        out = out.withColumn("gt_label", F.col(gt_label))
    return out


def image_names(df: DataFrame, path: str = "path") -> DataFrame:
    """B2 on a listing: add ``filename``."""
    return df.withColumn("filename", path_basename(path))
