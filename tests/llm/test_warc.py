import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from labelforge.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "own") for r in rows], "page_id bigint, url string, html string, digest string")


ROWS = [(1, "http://a/1", "x" * 120), (2, "http://a/2", "x" * 120), (3, None, "short"), (4, "u\r\nInjected: yes %0A", "short"), (5, "http://a/5", None),
        (6, "", ""), (7, "é", "é" * 60), (8, "q", "é" * 60), (9, "z", "WARC/1.1\r\n\r\n" * 30_000), (0, "first", "é" * 60), (2, "http://a/2", "x" * 120),
        (None, "n", "x" * 120), (10, "m", "y" * 99), (11, "m", "y" * 99), (12, "\x00\x1f", "\x00" * 300)]


def want():
    sized = [(i, u, (h or "").encode()) for i, u, h in ROWS]
    first = {}
    for i, _, b in sized:
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    for i, u, b in sized:
        again = i is not None and len(b) >= 100 and first[b] < i
        yield i, u, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None, b


def test_round_trip(spark):
    out = warc.round_trip(spark, pages(spark, ROWS).repartition(4), payloads=True).collect()
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in out]
    assert sorted(got, key=str) == sorted(want(), key=str)


def test_revisits_of_a_lost_or_other_record_are_found(spark):
    kept = warc.with_first(pages(spark, ROWS))
    folder = warc.scratch_path(spark, "warc-test")
    records = warc.read_archives(warc.write_archives(kept, folder)).cache()
    warc.check_revisits(records)
    lost = records.where("NOT (page_id = 1 AND record_type = 'response')")
    with pytest.raises(ValueError, match="which 2 revisits, was not read"):
        warc.check_revisits(lost)
    other = records.withColumn("payload_digest", F.when(F.expr("page_id = 0 AND record_type = 'response'"), "0" * 64).otherwise(F.col("payload_digest")))
    with pytest.raises(ValueError, match="record 0 of digest"):
        warc.check_revisits(other)
    longer = records.withColumn("payload_bytes", F.when(F.expr("page_id = 8"), F.lit(5)).otherwise(F.col("payload_bytes")))
    with pytest.raises(ValueError, match="which 8 revisits"):
        warc.check_revisits(longer)
    records.unpersist()


def test_empty_table(spark):
    assert warc.round_trip(spark, pages(spark, []).limit(0)).collect() == []


def test_archives_are_a_member_per_record(spark, tmp_path):
    names = warc.write_archives(warc.with_first(pages(spark, ROWS).coalesce(1)), str(tmp_path / "out"))
    for r in names.collect():
        with open(r["path"], "rb") as f:
            raw = f.read()
        assert sum(1 for chunks in warc.members(io.BytesIO(raw).read) if list(chunks)) == r["n_records"]
        small = io.BytesIO(raw)
        assert len(list(warc.records(lambda n: small.read(7)))) == r["n_records"]  # any chunking


def test_damage_is_found(spark, tmp_path):
    record = warc.record_bytes(1, "u", b"payload", None, hashlib.sha256(b"payload").hexdigest())
    good = warc.deflated(record)
    assert [b for _, b in warc.records(io.BytesIO(good + good).read)] == [b"payload"] * 2
    for broken in (record.replace(b"payload\r", b"paylooad\r"), record.replace(b"payload\r", b"Payload\r"), record.replace(b"WARC/1.1", b"WERC/1.1"),
                   record[:-2], record.replace(b"\r\n\r\n", b"\r\n")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(warc.deflated(broken)).read))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(good[:-9]).read))
    folder = str(tmp_path / "out")
    names = warc.write_archives(warc.with_first(pages(spark, ROWS[:3])), folder)
    wrong = names.withColumn("n_records", F.col("n_records") + 1)
    with pytest.raises(Exception, match="records, not"):
        warc.read_archives(wrong).collect()
    assert os.listdir(folder)
