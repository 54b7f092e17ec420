"""Substring dedup by level-wise doubling (operator 10).

A window is a run of ``size`` words.  At each length the windows that are still
candidates are tested by one shorter run inside them, the one with the smallest
hash: equal windows choose equal runs.  Where that run occurs in one document
only, the window cannot repeat and is dropped; runs that repeat alone are
extended to twice their length, until the length is the window itself.  Choosing
the smallest run of each window leaves about one key for every ``size / 4``
words to shuffle at the first length.  The last length compares whole windows by
128 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, per_batch
from .sketch import bitmap, signed
from .words import SPACED, Words, slices, window_hashes

#: Words of a window, and of the runs of the first level.
WINDOW, START = 50, 13

SPAN = "struct<first_word:int,last_word:int>"


def levels(size: int, start: int) -> list[int]:
    """Lengths that are tested: doubling from ``start`` to ``size``."""
    out, length = [], max(1, start)
    while length < size:
        out.append(length)
        length *= 2
    return [*out, size]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _row_mark(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """32 bits of each text, to tell rows of the same id apart."""
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(begins, begins[1:], strict=False)], np.int64)


def _candidates(words: Words, hashes: np.ndarray, size: int, done: list[tuple[int, Broadcast]]) -> np.ndarray:
    """Starts of the windows whose runs repeated at every length so far."""
    n = max(0, len(hashes) - size + 1)
    ok = words.window_ok(size)[:n]
    for length, repeated in done:
        if ok.any():
            ok = ok & repeated.value.test(sliding_min(window_hashes(hashes, length), size - length + 1))
    return np.flatnonzero(ok)


def _level_keys(docs: DataFrame, size: int, length: int, done: list[tuple[int, Broadcast]]) -> DataFrame:
    """(key, doc) of the shorter runs that stand for the candidates."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, begins in slices(batch.column(1)):
            words = Words(data, begins, SPACED)
            hashes = words.hashes()
            at = _candidates(words, hashes, size, done)
            if not len(at):
                continue
            key = sliding_min(window_hashes(hashes, length), size - length + 1)[at]
            text = words.text_of()[at]
            new = np.ones(len(at), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            yield pa.record_batch({"key": pa.array(signed(key[new])), "doc": batch.column(0).take(pa.array(row + text[new]))})

    return per_batch(docs, run, f"key bigint, doc {docs.schema['doc'].dataType.simpleString()}")


def _windows(docs: DataFrame, size: int, done: list[tuple[int, Broadcast]]) -> DataFrame:
    """(k1, k2, doc, spot) of the candidates; spot: the row's mark and the
    window's first word."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, begins in slices(batch.column(1)):
            words = Words(data, begins, SPACED)
            hashes = words.hashes()
            at = _candidates(words, hashes, size, done)
            if not len(at):
                continue
            text = words.text_of()[at]
            k1 = window_hashes(hashes, size)[at]
            k2 = window_hashes(words.hashes(1), size, 1)[at]
            mark = _row_mark(data, begins)[text]
            # two halves of a long; the sign bit is part of the mark
            spot = (mark.astype(np.uint64) << np.uint64(32)) | (at - words.first[text]).astype(np.uint64)
            yield pa.record_batch({"k1": pa.array(signed(k1)), "k2": pa.array(signed(k2)),
                                   "doc": batch.column(0).take(pa.array(row + text)), "spot": pa.array(signed(spot))})

    return per_batch(docs, run, f"k1 bigint, k2 bigint, doc {docs.schema['doc'].dataType.simpleString()}, spot bigint")


def repeated_windows(docs: DataFrame, size: int = WINDOW, start: int = START) -> DataFrame:
    """(doc, mark, starts): first words of the windows that also start in a
    document with a smaller id.  ``docs`` has the columns doc and text."""
    done: list[tuple[int, Broadcast]] = []
    for length in levels(size, start)[:-1]:
        keys = _level_keys(docs, size, length, done)
        often = land(keys.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"),
                                             F.max(F.col("doc").isNull()).alias("n"))
                     .where((F.col("a") < F.col("b")) | (F.col("n") & F.col("a").isNotNull())).select("key"), "repeated-runs")
        done.append((length, bitmap(often, "key")))
    windows = _windows(docs, size, done)
    first = (windows.groupBy("k1", "k2").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max(F.col("doc").isNull()).alias("n"))
             .where((F.col("a") < F.col("b")) | (F.col("n") & F.col("a").isNotNull())).select("k1", "k2", "a"))
    later = windows.join(first, ["k1", "k2"]).where((F.col("doc") > F.col("a")) | F.col("doc").isNull())
    mark = F.shiftrightunsigned("spot", 32).alias("mark")
    place = F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return later.select("doc", mark, place.alias("at")).groupBy("doc", "mark").agg(F.collect_list("at").alias("starts"))


def _cut(words: Words, raw: bytes, text: int, starts, size: int) -> tuple[int, list[tuple[int, int]], str]:
    """(words removed, spans, kept words joined by one blank)."""
    a, b = int(words.first[text]), int(words.first[text + 1])
    begin, end = words.start[a:b], words.end[a:b]
    gone = np.zeros(b - a + 1, np.int64)
    if starts is not None and len(starts):
        at = np.unique(np.asarray(starts))
        gone[at] += 1
        np.add.at(gone, at + size, -1)
    out = np.cumsum(gone)[: b - a] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
    spans = [(int(x), int(y) - 1) for x, y in zip(edge[::2], edge[1::2], strict=True)]
    kept = np.flatnonzero(~out)
    text_out = b" ".join([raw[x:y] for x, y in zip(begin[kept].tolist(), end[kept].tolist(), strict=True)]).decode()
    return int(out.sum()), spans, text_out


_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32())]))


def dedup_substrings(df: DataFrame, size: int = WINDOW, start: int = START, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, removed spans, kept text) of every row.

    Windows are judged on the input.  Null and empty texts have no words; a
    text shorter than the window keeps all; rows of one id do not remove each
    other's words; a null id counts as larger than all others.
    """
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = docs.schema["doc"].dataType.simpleString()
    found = land(repeated_windows(docs, size, start), "repeated-windows")
    marked = bitmap(found, "mark")
    schema = f"doc {kind}, n_words bigint, n_removed bigint, removed array<{SPAN}>, kept string"

    def results(doc, words: Words, raw: bytes, rows, starts) -> pa.RecordBatch:
        cut = [_cut(words, raw, i, s, size) for i, s in zip(rows, starts, strict=True)]
        return pa.record_batch({"doc": doc, "n_words": pa.array(words.counts()[rows], pa.int64()),
                                "n_removed": pa.array([c[0] for c in cut], pa.int64()),
                                "removed": pa.array([[{"first_word": a, "last_word": b} for a, b in c[1]] for c in cut], _SPANS),
                                "kept": pa.array([c[2] for c in cut], pa.string())})

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, begins in slices(batch.column(1)):
            rows = np.flatnonzero(~marked.value.test(_row_mark(data, begins).astype(np.uint64)))
            if len(rows):
                words = Words(data, begins, SPACED)
                yield results(batch.column(0).take(pa.array(row + rows)), words, data.tobytes(), rows, [None] * len(rows))

    def chosen(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, begins in slices(batch.column(1)):
            mark = _row_mark(data, begins)
            rows = np.flatnonzero(marked.value.test(mark.astype(np.uint64)))
            if len(rows):
                at = pa.array(row + rows)
                yield pa.record_batch({"doc": batch.column(0).take(at), "mark": pa.array(mark[rows]), "text": batch.column(1).take(at)})

    def trimmed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts = batch.column(2)
        for row, data, begins in slices(batch.column(1)):
            words = Words(data, begins, SPACED)
            rows = np.arange(words.n_texts)
            yield results(batch.column(0).slice(row, len(rows)), words, data.tobytes(), rows,
                          starts.slice(row, len(rows)).to_pylist())

    to_cut = (per_batch(docs, chosen, f"doc {kind}, mark bigint, text string").alias("d")
              .join(found.alias("f"), F.col("d.doc").eqNullSafe(F.col("f.doc")) & (F.col("d.mark") == F.col("f.mark")), "left")
              .select("d.doc", "d.text", "f.starts"))
    out = per_batch(docs, whole, schema).unionByName(per_batch(to_cut, trimmed, schema))
    return out.withColumnRenamed("doc", id_col)
