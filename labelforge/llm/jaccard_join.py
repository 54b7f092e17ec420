"""N-gram Jaccard join by T-occurrence search (operator 7).

A document is the set of its distinct word shingles.  Two sets of sizes x and y
with similarity t or more share at least T = t (x + y) / (1 + t) shingles.  In
the inverted lists of a set's shingles a partner therefore occurs T times.  As
DivideSkip has it, the L = T - m most common (long) lists are not merged but
probed: a partner must occur at least T - L = m times in the others, the
x - T + m rarest (short) lists (T times if T is smaller).  Those are merged
and the meetings of each pair counted; only pairs that reach the count are
probed, by bisection in the partner's sorted shingles.

Short lists: shingles are ordered by a table of corpus counts (ties by hash).
Spark's sort merge on the shingle is the merge of the lists; the sizes and the
places of a common shingle bound the overlap that is still possible.

Groups of many copies: equal sets are one node.  Nodes that share a smallest
hash are first compared with one hub of theirs, the one whose rarest shingle
is the most common.  Nodes that these links join are not paired with each
other again; only lists that hold two components are merged.  No link between
components is lost.

Before sets are probed, parity bitmaps bound the size of their difference.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, land, per_batch
from .components import components
from .hot import may_hold
from .sketch import bitmap, signed
from .words import SPACED, Words, mix, slices, window_hashes

#: Words of a shingle, and the similarity in percent.
SHINGLE, PERCENT = 4, 85
#: Cells of the table of corpus counts, a byte each (16 MB).  It only orders
#: shingles: any order gives the same links, a finer one shorter lists.
CELLS = 1 << 24
_CHUNK = 1 << 17
#: How often a pair must meet in the short lists.
MEET = 2
#: Smallest hashes of a set that it shares with its possible hubs.
HUB_KEYS = 3
_SEEDS = np.array([0x8CB92BA72F3D8DD7, 0x2D358DCCAA6C78A5, 0xD9B4F4F2C0E1A3B5], np.uint64)


class Sets:
    """Sorted distinct shingle hashes of each text of a slice."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, shingle: int):
        words = Words(data, begins, SPACED, lower=True)
        hashes = words.hashes()
        counts = words.counts()
        owner = words.text_of()
        runs = window_hashes(hashes, shingle)
        at = np.flatnonzero(words.window_ok(shingle)[: len(runs)])
        text, value = [owner[at]], [runs[at]]
        for k in range(1, shingle):  # shorter texts: the whole sequence
            few = np.flatnonzero(counts == k)
            if len(few):
                text.append(few)
                value.append(mix(window_hashes(hashes, k)[words.first[few]] + np.uint64(k)))
        text, value = np.concatenate(text), np.concatenate(value)
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        self.text, self.value = text[new], value[new]
        self.sizes = np.bincount(self.text, minlength=words.n_texts)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def per_text(self, reduce, values: np.ndarray) -> np.ndarray:
        """``reduce`` (a ufunc) over each text's values; 0 for empty sets."""
        out = np.zeros(len(self.sizes), np.uint64)
        some = self.sizes > 0
        if some.any():
            out[some] = reduce.reduceat(values, self.first[:-1][some])
        return out


def _marks(ids: pa.Array, data: np.ndarray, begins: np.ndarray) -> list[int]:
    """32 bits of a row's id and text."""
    raw = data.tobytes()
    return [zlib.crc32(raw[a:b], zlib.crc32(str(i).encode())) for i, a, b in
            zip(ids.to_pylist(), begins, begins[1:], strict=False)]


def corpus_counts(docs: DataFrame, shingle: int) -> Broadcast:
    """How often the shingles of each cell occur in the corpus, as 16 times the
    logarithm (a task counts up to 255 of a cell)."""

    def count(batches):
        cells = np.zeros(CELLS, np.uint8)
        seen = False
        for batch in batches:
            for _, data, begins in slices(batch.column(1)):
                found, times = np.unique((Sets(data, begins, shingle).value & np.uint64(CELLS - 1)).astype(np.int64), return_counts=True)
                cells[found] = np.minimum(cells[found] + times, 255)
                seen = True
        if seen:
            chunks = [zlib.compress(cells[a : a + _CHUNK].tobytes(), 1) for a in range(0, CELLS, _CHUNK)]
            yield pa.record_batch({"chunk": pa.array(range(len(chunks)), pa.int32()), "cells": pa.array(chunks, pa.binary())})
        del cells
        hand_back()

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(cells), np.uint8)
                if chunk not in total:
                    total[chunk] = np.zeros(_CHUNK, np.int64)
                total[chunk] += part
        if total:
            scaled = [np.minimum(np.rint(16 * np.log2(1 + x)), 255).astype(np.uint8) for x in total.values()]
            yield pa.record_batch({"chunk": pa.array(list(total), pa.int32()),
                                   "cells": pa.array([zlib.compress(x.tobytes(), 1) for x in scaled], pa.binary())})

    schema = "chunk int, cells binary"
    table = np.zeros(CELLS, np.uint8)
    for r in docs.mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).toLocalIterator():
        table[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(zlib.decompress(bytes(r["cells"])), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(table)


def _parity(value: np.ndarray) -> bytes:
    """Bit i: whether an odd number of shingles falls to it; half as many bits
    as shingles, a power of two."""
    bits = 64
    while bits < len(value) // 2:
        bits *= 2
    odd = np.bincount((mix(value) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def max_overlap(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """The largest overlap that two parity bitmaps allow.  A longer bitmap
    folds to the shorter by the parity of its halves."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (nx + ny - int(np.bitwise_count(a ^ b).sum())) // 2


def profiles(docs: DataFrame, shingle: int, percent: int, counts: Broadcast, meet: int = MEET) -> DataFrame:
    """A row for each document: its set's size and 128-bit signature, the
    shingles of its short lists (rarest first), hub keys, bitmap and the count
    of its rarest shingle."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, begins in slices(batch.column(1)):
            sets = Sets(data, begins, shingle)
            n = sets.sizes
            seen = counts.value[(sets.value & np.uint64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((sets.value, seen, sets.text))
            ranked = sets.value[order]
            short = np.where(n > 0, np.minimum(n, n - (percent * n + 99) // 100 + meet), 0)
            ends = np.concatenate([[0], np.cumsum(short)])
            place = np.arange(ends[-1]) - np.repeat(ends[:-1], short) + np.repeat(sets.first[:-1], short)
            keys = np.stack([sets.per_text(np.minimum, mix(sets.value ^ s)) + np.uint64(i) for i, s in enumerate(_SEEDS[:HUB_KEYS])], 1)
            rarest = np.zeros(len(n), np.int64)
            rarest[n > 0] = seen[order][sets.first[:-1][n > 0]].astype(np.int64)
            ids = batch.column(0).slice(row, len(n))
            width = pa.array(np.arange(len(n) + 1) * HUB_KEYS, pa.int32())
            yield pa.record_batch({
                "doc": ids, "mark": pa.array(_marks(ids, data, begins), pa.int64()), "n": pa.array(n, pa.int64()),
                "node": pa.array(signed(sets.per_text(np.add, mix(sets.value)))),
                "check": pa.array(signed(sets.per_text(np.add, mix(sets.value ^ np.uint64(0x5851F42D4C957F2D))))),
                "short": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(ranked[place]))),
                "keys": pa.ListArray.from_arrays(width, pa.array(signed(keys.ravel()))),
                "bits": pa.array([_parity(sets.value[a:b]) for a, b in zip(sets.first, sets.first[1:], strict=False)], pa.binary()),
                "rarest": pa.array(rarest)})

    kind = docs.schema["doc"].dataType.simpleString()
    return per_batch(docs, run, f"doc {kind}, mark bigint, n bigint, node bigint, check bigint, short array<bigint>, "
                                "keys array<bigint>, bits binary, rarest bigint")


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, items): the sorted shingles of the ``wanted`` (node, mark)."""
    passing = bitmap(wanted, "mark")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, begins in slices(batch.column(1)):
            marks = np.array(_marks(batch.column(0).slice(row, len(begins) - 1), data, begins), np.uint64)
            rows = np.flatnonzero(passing.value.test(marks))
            if not len(rows):
                continue
            texts = batch.column(1).take(pa.array(row + rows))
            for inner, d, b in slices(texts):
                sets = Sets(d, b, shingle)
                yield pa.record_batch({
                    "node": pa.array(signed(sets.per_text(np.add, mix(sets.value)))),
                    "mark": pa.array(marks[rows[inner : inner + len(b) - 1]].astype(np.int64)),
                    "items": pa.array([sets.value[x:y].tobytes() for x, y in zip(sets.first, sets.first[1:], strict=False)], pa.binary())})

    found = per_batch(docs, run, "node bigint, mark bigint, items binary")
    return found.join(wanted, ["node", "mark"], "leftsemi").dropDuplicates(["node"]).select("node", "items")



def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the overlap."""
    narrow = nodes.select("node", "n", "bits")

    def possible(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
        ok = [(100 + percent) * max_overlap(p, m, q, n) >= percent * (m + n) for p, m, q, n in zip(x, na, y, nb, strict=True)]
        yield pa.record_batch(dict(zip(("a", "b"), batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).columns, strict=True)))

    with_bits = (pairs.join(narrow.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
                 .join(narrow.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")
                 .select("a", "b", "na", "nb", "x", "y"))
    close = land(per_batch(with_bits, possible, "a bigint, b bigint"), "possible-links")
    wanted = land(close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                  .join(nodes.select("node", "mark"), "node"), "wanted-sets")
    sets = land(_sets_of(docs, wanted, shingle), "sets")

    def probe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield pa.record_batch(dict(zip(("a", "b"), batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).columns, strict=True)))

    both = (close.join(sets.select(F.col("node").alias("a"), F.col("items").alias("p")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("q")), "b").select("a", "b", "p", "q"))
    return land(per_batch(both, probe, "a bigint, b bigint"), "links")


def hub_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes and the hubs of their keys."""
    keyed = nodes.select("node", "n", "rarest", F.explode("keys").alias("key"))
    hubs = (keyed.groupBy("key").agg(F.max(F.struct("rarest", (-F.col("n")).alias("m"), "node")).alias("h"), F.count(F.lit(1)).alias("c"))
            .where("c > 1").select("key", F.col("h.node").alias("b"), (-F.col("h.m")).alias("nb")))
    return (keyed.join(hubs, "key").where("node <> b")
            .where((100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))).select(F.col("node").alias("a"), "b").distinct())


def list_pairs(nodes: DataFrame, percent: int, meet: int = MEET) -> DataFrame:
    """(a, b): nodes of two components that meet in the short lists as often as
    they must.  ``nodes`` has the column ``part``, the node's component.

    Lists within one component are not merged.  The i-th meeting of a pair that
    reaches the overlap leaves room for all but i - 1 of it behind its places,
    so meetings with too little room are not counted."""
    # 40 bits of an item: another with the same ones lets more lists through
    listed = land(nodes.select("part", F.explode("short").alias("item")).select("part", F.col("item").bitwiseAND(F.lit((1 << 40) - 1)).alias("item"))
                  .groupBy("item").agg(F.min("part").alias("low"), F.max("part").alias("high"))
                  .where("low < high").select("item"), "merged-lists")
    passing = bitmap(listed, "item")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        short = batch.column(3)
        flat = short.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(short.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(passing.value.test(flat.view(np.uint64))) if len(flat) else np.empty(0, np.int64)
        take = pa.array(row[at])
        yield pa.record_batch({"item": pa.array(flat[at], pa.int64()), "node": batch.column(0).take(take), "part": batch.column(1).take(take),
                               "n": batch.column(2).take(take), "place": pa.array(place[at], pa.int64())})

    lists = per_batch(nodes.select("node", "part", "n", "short"), run, "item bigint, node bigint, part bigint, n bigint, place bigint")
    a, b = lists, lists.select("item", *[F.col(c).alias(f"{c}_b") for c in ("node", "part", "n", "place")])
    need = F.expr(f"({percent} * (n + n_b) + {100 + percent - 1}) div {100 + percent}")
    room = need - (meet - 1)
    return (a.join(b, "item")
            .where("part <> part_b AND (n > n_b OR (n = n_b AND node > node_b))").where(f"100 * n_b >= {percent} * n")
            .where((F.col("n") - F.col("place") >= room) & (F.col("n_b") - F.col("place_b") >= room))
            .groupBy(F.col("node").alias("a"), F.col("node_b").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.min(need).alias("need"))
            .where(F.col("met") >= F.least("need", F.lit(meet))).select("a", "b"))


def similar_groups(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                   text_col: str = "text", meet: int = MEET) -> DataFrame:
    """(id, n_shingles, node, component_id) of every row; ``node`` is the class
    of equal sets.  ``meet`` is how often a pair must meet in the short lists:
    more means longer short lists and fewer pairs to probe, the same links.

    Null and empty texts have an empty set and are linked with nothing (their
    component is their own id); a text of fewer words than a shingle is one
    shingle; repeated rows and ids are equal sets or separate ones as their
    texts say; a null id is never a component's name unless alone.
    """
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = land(profiles(docs, shingle, percent, corpus_counts(docs, shingle), meet), "set-profiles")
    wide = rows.where("n > 0")
    named = wide.groupBy("node").agg(F.min(F.struct("check", "n")).alias("lo"), F.max(F.struct("check", "n")).alias("hi"), F.count(F.lit(1)).alias("c"))
    repeated = land(named.where("c > 1"), "repeated-nodes")
    if repeated.where("lo <> hi").limit(1).count():
        raise RuntimeError("two different sets have the same 64-bit signature")
    # a set that is certainly alone stays in place, with its lists
    tested = may_hold(wide, repeated, ["node"])
    columns = ["mark", "short", "keys", "bits", "rarest"]
    one = (tested.where("__maybe").groupBy("node").agg(F.min("n").alias("n"), F.min_by(F.struct(*columns), F.col("mark")).alias("r"))
           .select("node", "n", "r.*"))
    nodes = land(tested.where("NOT __maybe").select("node", "n", *columns).unionByName(one), "nodes")
    hubs = verified(hub_pairs(nodes, percent), nodes, docs, shingle, percent)
    parts = components(hubs).select("node", F.col("component").alias("part"))
    placed = land(nodes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "placed-nodes")
    links = verified(list_pairs(placed, percent, meet), placed, docs, shingle, percent)
    part = placed.select("node", "part")
    joined = (links.join(part.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a")
              .join(part.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    whole = components(joined).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    groups = land(part.join(whole, "part", "left").select("node", F.coalesce("whole", "part").alias("whole")), "groups")
    named = rows.where("n > 0").select("doc", "n", "node").join(groups, "node")
    least = named.groupBy("whole").agg(F.min("doc").alias("component_id"))
    out = named.join(least, "whole").select("doc", "n", "node", "component_id")
    alone = rows.where("n = 0").select("doc", "n", F.lit(None).cast("bigint").alias("node"), F.col("doc").alias("component_id"))
    return out.unionByName(alone).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "node", "component_id")
