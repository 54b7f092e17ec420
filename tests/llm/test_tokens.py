import base64
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from edge import documents, texts
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from labelforge.llm import byte_bpe, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def odd_texts():
    rng = random.Random(3)
    letters = list("ab 'stre\n1é中!") + ["՘", "\U00010940", "<|endoftext|>", "\x85", "‍"]
    return (["a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "aaaaaaaaaa aaaaaaa", "'s'll I'm don't", "՘a1 \U00010940x"]
            + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(400)])


def test_counts_are_those_of_the_library(spark):
    rows = texts() + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(documents(spark, rows), JSON).collect()}
    library = Tokenizer.from_file(JSON)
    want = set()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.add((i, len((t or "").encode()), n, n > 512))
    assert got == want


def test_ids_are_those_of_the_library_and_come_back(spark):
    rows = texts() + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    docs = documents(spark, rows, extra=False)
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, keep=("doc_id", "text"), offsets=True), RANKS).collect()
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        width = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert r["offsets"] == [sum(width[:k]) for k in range(len(ids))] if len(ids) < 500 else True


def test_decoding_beside_encoding_is_decoding(spark):
    rows = texts() + [(1000 + i, t) for i, t in enumerate(odd_texts())] + [(None, None)]
    docs = documents(spark, rows)
    one = byte_bpe.encode(docs, RANKS, offsets=True, decoded=True)
    two = byte_bpe.decode(byte_bpe.encode(docs, RANKS, offsets=True), RANKS)
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert byte_bpe.encode(docs.limit(0), RANKS, decoded=True).collect() == []


def test_characters_cut_by_token_borders():
    assert byte_bpe.tokens_as_text(["é".encode()[:1], "é".encode()[1:] + b"x"]) == ["", "éx"]
    assert byte_bpe.tokens_as_text([b"a", b"\xf0\x9f"]) == ["a", "�"]
    assert byte_bpe.tokens_as_text([]) == []


def test_decoding_to_text(spark):
    ids = byte_bpe.encode(documents(spark, [(1, "日本 é🙂"), (2, None)], extra=False), RANKS)
    got = {r["doc_id"]: r["t"] for r in byte_bpe.decode(ids, RANKS, out_col="t", as_text=True).collect()}
    assert "".join(got[1]) == "日本 é🙂" and got[2] == []


def test_empty_table_and_clashes(spark):
    none = documents(spark, [])
    assert token_counts.count_tokens(none, JSON).collect() == []
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS), RANKS).collect() == []
    with pytest.raises(ValueError, match="overwritten"):
        byte_bpe.encode(none, RANKS, keep=("doc_id", "ids"))


def test_memory_of_pretokens_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBER", 5)
    counter = token_counts.Counter(JSON)
    library = Tokenizer.from_file(JSON)
    for t in odd_texts()[:50]:
        assert counter.count([t]) == [len(library.encode(t, add_special_tokens=False).ids)]


class Recorder:
    """A tokenizers model that notes how many pieces come at once."""

    def __init__(self, model):
        self.model, self.most = model, 0

    def encode_batch_fast(self, written, **options):
        self.most = max(self.most, len(written))
        return self.model.encode_batch_fast(written, **options)


def test_memory_of_encoding_is_bounded(monkeypatch):
    """Rows of any length are encoded and decoded by slices of about
    SLICE_BYTES, their new pieces by LEARN at once."""
    rng = random.Random(8)
    rows = ["".join(rng.choices("abcdefghij klmno", k=20_000)) for _ in range(60)] + [None, "", "a b"]
    bpe = byte_bpe.ByteBpe(RANKS)
    bpe.model = recorder = Recorder(bpe.model)
    size, most = bpe.encode, []
    bpe.encode = lambda part: most.append(sum(map(len, part))) or size(part)
    monkeypatch.setattr(byte_bpe, "_bpe", lambda path: bpe)
    monkeypatch.setattr(byte_bpe, "per_batch", lambda df, run, schema: run)
    batch = pa.record_batch({"doc_id": pa.array(range(len(rows))), "text": pa.array(rows)})
    out = pa.Table.from_batches(byte_bpe.encode(Frame(), RANKS, decoded=True)(batch))
    assert max(most) <= byte_bpe.SLICE_BYTES and len(most) > 3 and recorder.most == byte_bpe.LEARN
    assert out["doc_id"].to_pylist() == list(range(len(rows)))
    assert out["decoded"].to_pylist() == [(t or "").encode() for t in rows]


class Frame:
    """As much of a DataFrame as the plan of ``encode`` asks for."""

    schema = StructType([StructField("doc_id", LongType())])

    def select(self, *columns):
        return self

    def __getitem__(self, name):
        return self

    def alias(self, name):
        return self
