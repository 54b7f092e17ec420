"""Byte-level BPE encoding and decoding over Arrow batches (operator 5).

A rank file (base64 token, rank) becomes a BPE model of the tokenizers
library: every byte is written as one printable character, and each token of
two or more bytes contributes a merge for every way to split it into two known
tokens, in the order of the ranks.  Text is split first, each piece is encoded
on its own, and distinct pieces are encoded once per worker.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import hand_back, per_batch
from .pretokens import splitter
from .token_counts import byte_characters
from .words import slices

#: Pieces whose ids a worker remembers (a memory bound only); above it, those
#: that were needed once go.
REMEMBER = 120_000
#: Pieces that the library encodes at once: its objects are far larger than their ids.
LEARN = 2_048
#: Bytes of text encoded and decoded at once (a longer text makes a larger slice).
SLICE_BYTES = 1 << 18


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the runs start[i] .. start[i] + length[i], one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


class Known:
    """Ids of pieces: a number for each piece, and its run in one array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.used = 0
        self.start = np.empty(1 << 15, np.int64)
        self.length = np.empty(1 << 15, np.int64)
        self.needed = np.zeros(1 << 15, np.int64)

    def add(self, pieces: list[str], ids: list[list[int]]) -> None:
        first, n = len(self.number), len(pieces)
        length = np.fromiter(map(len, ids), np.int64, n)
        total = int(length.sum())
        for name in ("start", "length", "needed"):
            while len(getattr(self, name)) < first + n:
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.start[first : first + n] = self.used + np.cumsum(length) - length
        self.length[first : first + n] = length
        self.needed[first : first + n] = 0
        self.used += total
        self.number.update(zip(pieces, range(first, first + n), strict=True))

    def forget(self) -> None:
        """Only pieces needed twice since the last time stay."""
        keep = [p for p, i in self.number.items() if self.needed[i] > 1]
        at = np.array([self.number[p] for p in keep], np.int64)
        ids, ends = self.ids[ragged(self.start[at], self.length[at])], np.cumsum(self.length[at])
        lists = [x.tolist() for x in np.split(ids, ends[:-1])] if keep else []
        self.__init__()
        self.add(keep, lists)


class ByteBpe:
    """The tokenizers model of a rank file, and the way back."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token_bytes = {i: raw for raw, i in ranks.items()}
        self.to_char = {b: ord(c) for b, c in enumerate(byte_characters())}
        name = {raw: raw.decode("latin-1").translate(self.to_char) for raw in ranks}
        merges = [(name[raw[:k]], name[raw[k:]])
                  for raw in sorted(ranks, key=ranks.__getitem__)
                  for k in range(1, len(raw)) if raw[:k] in ranks and raw[k:] in ranks]
        vocab = {name[raw]: i for raw, i in ranks.items()}
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.split = splitter()
        self.known = Known()
        size = max(self.token_bytes) + 1
        self.width = np.array([len(self.token_bytes.get(i, b"")) for i in range(size)], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.table = np.frombuffer(b"".join(self.token_bytes.get(i, b"") for i in range(size)), np.uint8)

    def learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), LEARN):
            part = pieces[at : at + LEARN]
            written = [p.encode().decode("latin-1").translate(self.to_char) for p in part]
            self.known.add(part, [x.ids for x in self.model.encode_batch_fast(written, add_special_tokens=False)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        known = self.known
        if len(known.number) > REMEMBER:
            known.forget()
        split = [self.split(t) for t in texts]
        pieces = list(chain.from_iterable(split))
        if new := set(pieces).difference(known.number):
            self.learn(list(new))
        number = np.fromiter(map(known.number.__getitem__, pieces), np.int64, len(pieces))
        known.needed += np.bincount(number, minlength=len(known.needed))
        length = known.length[number]
        ids = known.ids[ragged(known.start[number], length)]
        per_text = np.concatenate([[0], np.cumsum(length)])[np.cumsum([len(p) for p in split])]
        return np.split(ids, per_text[:-1]) if len(texts) else []

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The first byte of each token in the UTF-8 text."""
        width = self.width[ids]
        return (np.cumsum(width) - width).astype(np.int32)

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of runs of ``counts`` ids, as a binary array."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.width) or not self.width[ids].all()):
            raise ValueError("an id is not in the rank file")
        width = self.width[ids]
        data = self.table[ragged(self.begin[ids], width)]
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def tokens_as_text(raw_tokens: list[bytes]) -> list[str]:
    """Text of each token; a character cut by token borders appears whole with
    the token that completes it, and bytes that are no UTF-8 become U+FFFD."""
    step = codecs.getincrementaldecoder("utf-8")("replace")
    out = [step.decode(raw) for raw in raw_tokens]
    if out:
        out[-1] += step.decode(b"", True)
    return out


@lru_cache(maxsize=2)
def _bpe(path: str) -> ByteBpe:
    bpe = ByteBpe(path)
    hand_back()  # what only the way to the model needed
    return bpe


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           offsets: bool = False, decoded: bool = False) -> DataFrame:
    """The ``keep`` columns, ``ids`` and (if asked for) ``offsets``, the first
    byte of each token, and ``decoded``, the bytes that ``decode`` makes of the
    ids, without a second worker a task.  A null or empty text has no ids; repeated rows stay;
    an output name that clashes with a kept column is an error."""
    made = ["ids", *["offsets"] * offsets, *["decoded"] * decoded]
    if clash := set(keep) & set(made):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path)
        for at, _, begins in slices(batch.column(len(keep)), SLICE_BYTES):
            part = batch.slice(at, len(begins) - 1)
            ids = bpe.encode([t or "" for t in part.column(len(keep)).to_pylist()])
            columns = {c: part.column(i) for i, c in enumerate(keep)} | {"ids": _lists(ids)}
            if offsets:
                columns["offsets"] = _lists([bpe.offsets(x) for x in ids])
            if decoded:
                columns["decoded"] = bpe.decode_all(np.concatenate(ids).astype(np.int64), np.fromiter(map(len, ids), np.int64, len(ids)))
            yield pa.record_batch(columns)

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{m} {'binary' if m == 'decoded' else 'array<int>'}" for m in made])
    return per_batch(df.select(*keep, df[text_col].alias("__text")), run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded",
           as_text: bool = False) -> DataFrame:
    """All columns and ``out_col``: the bytes of the ids, or with ``as_text``
    the text of every token (see tokens_as_text).  Null ids decode to nothing;
    an unknown id is an error."""
    names = df.columns
    if out_col in names:
        raise ValueError(f"column {out_col} would be overwritten")
    place = names.index(ids_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            lists = part.column(place)
            if as_text:
                out = pa.array([tokens_as_text([bpe.token_bytes[i] for i in x or []]) for x in lists.to_pylist()], pa.list_(pa.string()))
            else:
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                out = bpe.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.record_batch([*part.columns, out], names=[*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return per_batch(df, run, f"{schema}, `{out_col}` {'array<string>' if as_text else 'binary'}")
