"""Token counts by rank-synchronous merging of ragged arrays (operator 4).

The distinct new pre-tokens of an Arrow batch become one ragged array of
symbols.  In each round every sequence finds its own lowest-ranked pair and
applies it to all its places at once; a sequence without a ranked pair is
done.  The symbols that survive are the tokens.  A pair can only be made of
symbols that earlier ranks built, so the order of merges within a sequence is
that of the vocabulary's own greedy rule.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_batch
from .pretokens import splitter

#: Pre-tokens whose counts a worker remembers (memory bound, not a limit on
#: the input: forgotten ones are merged again).
REMEMBER = 400_000
#: Symbols merged in one ragged array.
RAGGED = 1 << 20
_FAR = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for shift, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + shift)
    return [table[b] for b in range(256)]


class RankTable:
    """Merge ranks of a tokenizers JSON file, looked up by pairs of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.size = len(vocab)
        self.byte_id = np.array([vocab[c] for c in byte_characters()], np.int64)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left * (self.size + 1) + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        # strings that the library takes out before the split; each is one token
        added = [t for t in spec.get("added_tokens") or []]
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in added):
            raise ValueError("added tokens with stripping or normalising are not handled")
        if spec.get("normalizer") or model.get("ignore_merges") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("this tokenizer file asks for more than byte-level BPE")
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or far, index) of each pair."""
        key = left * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _FAR), at


def merge_all(table: RankTable, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of symbols left in each sequence after all merges."""
    counts = lengths.astype(np.int64).copy()
    alive = np.flatnonzero(lengths > 1)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    symbols = symbols[np.isin(owner, alive)] if len(alive) < len(lengths) else symbols
    lengths = lengths[alive].astype(np.int64)
    while len(alive):
        first = np.cumsum(lengths) - lengths
        seq = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), _FAR)
        at = np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner], at[inner] = table.find(symbols[inner], symbols[inner + 1])
        lowest = np.minimum.reduceat(rank, first)
        take = (rank == lowest[seq]) & (rank < _FAR)
        # in a run of touching places (aaa) every second one is taken
        spot = np.flatnonzero(take)
        if len(spot):
            fresh = np.r_[True, np.diff(spot) > 1]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
            spot = spot[(np.arange(len(spot)) - begin) % 2 == 0]
            symbols = symbols.copy()
            symbols[spot] = table.made[at[spot]]
            keep = np.ones(len(symbols), bool)
            keep[spot + 1] = False
            lengths = lengths - np.bincount(seq[spot], minlength=len(lengths))
            symbols, seq = symbols[keep], seq[keep]
        going = (lowest < _FAR) & (lengths > 1)
        counts[alive] = lengths
        if not going.all():
            symbols = symbols[going[seq]]
            alive, lengths = alive[going], lengths[going]
    return counts


class Counter:
    """Tokens per text, with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        self.table = RankTable(path)
        self.split = splitter()
        self.cut = regex.compile("|".join(map(regex.escape, self.table.special))).split if self.table.special else None
        self.known: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        batch: list[bytes] = []
        names: list[str] = []
        size = 0
        for i, piece in enumerate(pieces):
            raw = piece.encode()
            batch.append(raw)
            names.append(piece)
            size += len(raw)
            if size >= RAGGED or i == len(pieces) - 1:
                flat = np.frombuffer(b"".join(batch), np.uint8)
                lengths = np.fromiter(map(len, batch), np.int64, len(batch))
                counts = merge_all(self.table, self.table.byte_id[flat], lengths)
                self.known.update(zip(names, counts.tolist(), strict=True))
                batch, names, size = [], [], 0

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many added tokens stood between them."""
        if self.cut is None:
            return self.split(text), 0
        parts = self.cut(text)
        if len(parts) == 1:
            return self.split(text), 0
        return [p for part in parts for p in self.split(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBER:
            self.known.clear()
        split = [self.pieces(t) for t in texts]
        new: set[str] = set()
        for pieces, _ in split:
            new.update(pieces)
        self.learn([p for p in new if p not in self.known])
        known = self.known.__getitem__
        return [sum(map(known, pieces)) + extra for pieces, extra in split]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    ``tokenizer_path`` is a byte-level BPE file of the tokenizers library that
    every executor can open.  A null text counts as empty (0, 0, false); rows
    with equal or null ids stay separate rows; other columns are not looked at.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        texts = batch.column(1)
        sizes: list[int] = []
        tokens: list[int] = []
        for at in range(0, len(texts), 256):
            part = [t or "" for t in texts.slice(at, 256).to_pylist()]
            sizes += [len(t.encode()) for t in part]
            tokens += counter.count(part)
        n = np.array(tokens, np.int64)
        yield pa.record_batch({id_col: batch.column(0), "n_bytes": pa.array(sizes, pa.int64()),
                               "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    kind = df.schema[id_col].dataType.simpleString()
    return per_batch(df.select(id_col, text_col), run,
                     f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
