"""Words of many texts at once, as numpy arrays over UTF-8 bytes.

A word is a maximal run of word bytes.  Both word classes used here are
decided by single bytes (every byte of a non-ASCII character is a word byte),
so whole Arrow batches are split and hashed without a Python loop over words.

Hashes are 64 bits wide and equal for equal words on every machine.  Where
two different texts must not be confused on the strength of one hash, callers
use two lanes (two independent hashes, 128 bits together).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)

#: Words `[^\x20\x09-\x0D]+`.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased.
PLAIN = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_SAME = _BYTES.astype(np.uint8)

#: Odd multipliers of the two lanes.
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}

#: Bytes of text worked on at once (a longer text makes a larger slice).
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hashes(left: np.ndarray, right: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of two neighbouring pieces (order matters)."""
    return mix(left * np.uint64(_BASE[lane]) + right + np.uint64(0x632BE59BD9B4E019))


def _powers(lane: int, n: int) -> np.ndarray:
    have = _POWERS.get(lane)
    if have is None or len(have) < n:
        size = max(1024, n)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = np.uint64(_BASE[lane])
        _POWERS[lane] = have = np.multiply.accumulate(have)
    return have


class Words:
    """Words of the texts that lie one after another in ``data``.

    ``begins[i]:begins[i+1]`` are the bytes of text i; ``start`` and ``end``
    the byte spans of the words; words of text i are ``first[i]:first[i+1]``.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False):
        self.data = (_LOWER if lower else _SAME)[data] if lower else data
        self.begins = begins
        inside = kind[self.data]
        n = len(data)
        new_text = np.zeros(n + 1, bool)
        new_text[begins] = True
        opens = inside.copy()
        closes = inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | new_text[1:n]
            closes[:-1] &= ~inside[1:] | new_text[1:n]
        self.inside = inside
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, begins)

    @property
    def n_texts(self) -> int:
        return len(self.begins) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(self.n_texts), self.counts())

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64-bit hash of every word."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        length = self.end - self.start
        flat = np.flatnonzero(self.inside)
        begin = np.cumsum(length) - length
        place = np.arange(len(flat)) - np.repeat(begin, length)
        powers = _powers(lane, int(length.max()))
        terms = (self.data[flat].astype(np.uint64) + np.uint64(1)) * powers[place]
        return mix(np.add.reduceat(terms, begin) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def window_ok(self, size: int) -> np.ndarray:
        """Whether ``size`` words from here lie in one text (per word)."""
        last = np.repeat(self.first[1:], self.counts())
        return np.arange(len(self.start)) + size <= last


def window_hashes(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` words (runs over the end are cut off the
    result, runs over a text border must be left out by the caller)."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    done, out, part, length, rest = 0, None, hashes, 1, size
    while True:
        if rest & 1:
            piece = part[done:]
            out = piece if out is None else join_hashes(out[: len(piece)], piece[: len(out)], lane)
            done += length
        rest >>= 1
        if not rest:
            return out[: n - size + 1]
        part = join_hashes(part[: len(part) - length], part[length:], lane)
        length *= 2


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, bytes, begins) for runs of whole texts of about
    ``limit`` bytes; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[
        texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        to = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        to = min(max(to, row + 1), len(texts))
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
