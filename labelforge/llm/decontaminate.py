"""Benchmark decontamination by a prefix-filtered set join (operator 1).

Every run of ``window`` item words (a shorter item is one run) is taken as a
set of word shingles.  A document run of the same length that contains the item
run contains all its shingles, so for containment 1 the necessary prefix of the
set is one shingle, and the rarest by the corpus counts is the best.  Documents
are joined to the item runs on that shingle alone; the length and place of the
shingle bound where the run can lie, and the words there are compared one by
one.
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
from .words import PLAIN, Words, mix, slices, window_hashes

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 3


def _shingles(words: Words, size: int) -> dict[int, np.ndarray]:
    """Hashes of the runs of 1..size words, by length (shorter ones are for
    items of fewer words than a shingle)."""
    hashes = words.hashes()
    return {k: mix(window_hashes(hashes, k) + np.uint64(k)) for k in range(1, size + 1)}


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, length, words, shingle, offset): the runs of every item with all
    their shingles; one row for each shingle."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, begins in slices(batch.column(1)):
            words = Words(data, begins, PLAIN, lower=True)
            raw = words.data.tobytes()
            hashes = _shingles(words, shingle)
            rows: dict[str, list] = {"item": [], "length": [], "words": [], "shingle": [], "offset": []}
            for text in range(words.n_texts):
                a, b = int(words.first[text]), int(words.first[text + 1])
                spelt = [raw[x:y].decode() for x, y in zip(words.start[a:b], words.end[a:b], strict=True)]
                length = min(window, b - a)
                size = min(shingle, length)
                for first in range(b - a - length + 1) if length else ():
                    for offset in range(length - size + 1):
                        rows["item"].append(row + text)
                        rows["length"].append(length)
                        rows["words"].append(spelt[first : first + length])
                        rows["shingle"].append(int(signed(hashes[size])[a + first + offset]))
                        rows["offset"].append(offset)
            yield pa.record_batch({"item": batch.column(0).take(pa.array(rows["item"], pa.int64())), "length": pa.array(rows["length"], pa.int32()),
                                   "words": pa.array(rows["words"], pa.list_(pa.string())),
                                   "shingle": pa.array(rows["shingle"], pa.int64()), "offset": pa.array(rows["offset"], pa.int32())})

    kind = items.schema["item"].dataType.simpleString()
    return per_batch(items, run, f"item {kind}, length int, words array<string>, shingle bigint, offset int")


def _hits(words: Words, shingle: int, wanted: Broadcast) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shingle length, places, hashes) of the document shingles to look at."""
    for size, hashes in _shingles(words, shingle).items():
        places = np.flatnonzero(words.window_ok(size)[: len(hashes)] & wanted.value.test(hashes))
        if len(places):
            yield size, places, hashes[places]


def shingle_counts(docs: DataFrame, shingle: int, wanted: Broadcast) -> DataFrame:
    """(shingle, n): how often the wanted shingles stand in the documents."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, data, begins in slices(batch.column(1)):
            found = [h for _, _, h in _hits(Words(data, begins, PLAIN, lower=True), shingle, wanted)]
            if found:
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch({"shingle": pa.array(signed(keys)), "n": pa.array(n, pa.int64())})

    return per_batch(docs, run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def _spots(docs: DataFrame, window: int, shingle: int, wanted: Broadcast) -> DataFrame:
    """A row for each document (place null) and one for each place of a wanted
    shingle, with the words around it from word ``base`` on."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, begins in slices(batch.column(1)):
            words = Words(data, begins, PLAIN, lower=True)
            raw, given = words.data.tobytes(), data.tobytes()
            marks = np.array([zlib.crc32(given[a:b]) for a, b in zip(begins, begins[1:], strict=False)], np.int64)
            counts = words.counts()
            texts = [np.arange(words.n_texts)]
            at: list = [None] * words.n_texts
            base: list = [None] * words.n_texts
            keys: list = [None] * words.n_texts
            around: list = [None] * words.n_texts
            owner = words.text_of()
            for size, places, hashes in _hits(words, shingle, wanted):
                own = owner[places]
                texts.append(own)
                low = np.maximum(words.first[own], places + size - window)
                high = np.minimum(words.first[own + 1], places + window)
                at += (places - words.first[own]).tolist()
                base += (low - words.first[own]).tolist()
                keys += signed(hashes).tolist()
                around += [[raw[x:y].decode() for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
                           for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            text = np.concatenate(texts)
            yield pa.record_batch({"doc": batch.column(0).take(pa.array(row + text)), "mark": pa.array(marks[text]),
                                   "n_words": pa.array(counts[text], pa.int64()), "place": pa.array(at, pa.int32()),
                                   "base": pa.array(base, pa.int32()), "shingle": pa.array(keys, pa.int64()),
                                   "around": pa.array(around, pa.list_(pa.string()))})

    kind = docs.schema["doc"].dataType.simpleString()
    return per_batch(docs, run, f"doc {kind}, mark bigint, n_words bigint, place int, base int, shingle bigint, around array<string>")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents with their number of words, verified (doc, mark, item,
    first_word, length) rows).  ``docs``: doc, text; ``items``: item, text."""
    runs = land(item_windows(items, window, shingle), "item-windows")
    counts = shingle_counts(docs, shingle, bitmap(runs, "shingle"))
    # the rarest shingle of each distinct run; a run with a shingle that no
    # document has cannot occur
    rarity = (runs.select("words", "shingle", "offset").distinct()
              .join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    prefix = land(rarity.groupBy("words").agg(F.min(F.struct("n", "shingle", "offset")).alias("p"))
                  .where("p.n > 0").select("words", "p.shingle", "p.offset"), "item-prefixes")
    spots = land(_spots(docs, window, shingle, bitmap(prefix, "shingle")), "document-spots")
    length = F.size("words")
    first = F.col("place") - F.col("offset")
    inside = (first >= 0) & (first + length <= F.col("n_words"))
    same = F.slice("around", F.greatest(first - F.col("base"), F.lit(0)) + 1, length) == F.col("words")
    hits = (spots.where("place IS NOT NULL").join(prefix, "shingle").where(inside & same)
            .select("doc", "mark", first.alias("first_word"), length.alias("length"), "words").distinct())
    return spots.where("place IS NULL").select("doc", "mark", "n_words"), hits


def contamination(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every row: the words that lie in
    an occurrence of an item run, the sorted items (as strings), and the
    merged spans of hit words.

    Null and empty texts have no words, on either side; items of equal text
    are all reported; rows of equal id and text are judged alike; a null item
    id is reported as an empty string.
    """
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    rows, hits = matches(docs, items, window, shingle)
    hits = land(hits, "decontamination-hits")
    owners = item_windows(items, window, shingle).select("item", "words").distinct()
    named = (hits.select("doc", "mark", "words").distinct().join(owners, "words")
             .groupBy("doc", "mark").agg(F.array_sort(F.collect_set("item")).alias("items")))
    spans = (hits.select("doc", "mark", "first_word", "length").distinct()
             .groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("first_word", "length"))).alias("runs")))
    # sorted runs to merged spans
    start = F.expr("CAST(array() AS array<struct<first_word:int,last_word:int>>)")
    merged = F.aggregate("runs", start, lambda done, r: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last_word"] + 1 >= r["first_word"]),
        F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(done, -1)["first_word"].alias("first_word"),
            F.greatest(F.element_at(done, -1)["last_word"], r["first_word"] + r["length"] - 1).alias("last_word")))))
        .otherwise(F.concat(done, F.array(F.struct(r["first_word"].alias("first_word"), (r["first_word"] + r["length"] - 1).alias("last_word"))))))
    found = named.join(spans, [named["doc"].eqNullSafe(spans["doc"]), named["mark"] == spans["mark"]]).select(
        named["doc"].alias("__d"), named["mark"].alias("__m"), "items", merged.alias("spans"))
    joined = rows.join(found, rows["doc"].eqNullSafe(found["__d"]) & (rows["mark"] == found["__m"]), "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return joined.select(F.col("doc").alias(id_col), "n_words", F.coalesce(n_hit, F.lit(0).cast("bigint")).alias("n_hit"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                         F.coalesce("spans", start).alias("spans"))
