import random

import numpy as np
import pyarrow as pa
import pytest
from edge import PLAIN, SPACED, lower, texts

from labelforge.llm import words as W


@pytest.mark.parametrize(("kind", "pattern", "low"), [(W.SPACED, SPACED, False), (W.SPACED, SPACED, True), (W.PLAIN, PLAIN, True)])
def test_words_are_those_of_the_pattern(kind, pattern, low):
    given = [t for _, t in texts()] + ["A\x0bB\x00c\n", "é", " a", "a "]
    got, names = [], {}
    for _, data, begins in W.slices(pa.array(given), 4000):
        words = W.Words(data, begins, kind, low)
        raw = words.data.tobytes()
        hashes, runs = words.hashes(), W.window_hashes(words.hashes(), 5)
        for i in range(words.n_texts):
            span = range(words.first[i], words.first[i + 1])
            own = [raw[words.start[j] : words.end[j]].decode() for j in span]
            got.append(own)
            for j, w in zip(span, own, strict=True):
                assert names.setdefault(w, hashes[j]) == hashes[j]
                if words.window_ok(5)[j]:
                    k = tuple(own[j - words.first[i] : j - words.first[i] + 5])
                    assert names.setdefault(k, runs[j]) == runs[j]
    assert got == [pattern.findall(lower(t) if low else t or "") for t in given]
    assert len(set(map(int, names.values()))) == len(names)


def test_window_hashes_of_every_length():
    x = np.array([random.Random(1).getrandbits(64) for _ in range(40)], np.uint64)
    for size in range(1, 41):
        whole = W.window_hashes(x, size)
        assert len(whole) == 41 - size
        again = [W.window_hashes(x[i : i + size], size)[0] for i in range(41 - size)]
        assert whole.tolist() == [int(v) for v in again]
    assert len(W.window_hashes(x, 41)) == 0


def test_no_texts():
    assert list(W.slices(pa.array([], pa.string()))) == []
    words = W.Words(np.empty(0, np.uint8), np.zeros(3, np.int64))
    assert words.counts().tolist() == [0, 0] and len(words.hashes()) == 0
