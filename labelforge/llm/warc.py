"""WARC archives: a writer and a sequential reader (operator 6).

Each task writes its rows to one archive, a gzip member per record, and
returns the archive's name; names of lost attempts are never read.  The reader
opens an archive as a stream, inflates it member by member, frames every block
by its Content-Length and verifies the digests.  Equal payloads are kept once:
later records of the same payload are revisits of the first, and a revisit is
only as good as the record it names: one of this digest and length must have
been read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from .common import land
from .hot import with_few

#: Bytes read, inflated or written at once.
CHUNK = 1 << 18
#: Pages that a writer holds as Python objects.
ROWS = 64
#: Payloads below this size are always stored (a revisit would save nothing).
MIN_REVISIT = 100
#: gzip level of the records.
LEVEL = 3

RECORD = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
          "payload_digest string, block_bytes bigint, payload binary")


def _open(path: str):
    """(file system, path) of a folder or file by its URI; a bare path is local."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _escaped(value: str) -> str:
    """One header line's worth of any text (line breaks and % as %XX)."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page_id, url, payload: bytes, refers_to, digest: str) -> bytes:
    """One WARC record; a revisit has the headers and no block."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def deflated(record: bytes, level: int = LEVEL) -> bytes:
    """One gzip member."""
    step = zlib.compressobj(level, zlib.DEFLATED, 31)
    return step.compress(record) + step.flush()


def members(read) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each an iterator of inflated chunks that
    has to be used up before the next member is asked for."""
    left = b""
    while True:
        left = left or read(CHUNK)
        if not left:
            return
        step = zlib.decompressobj(31)

        def chunks(step=step):
            nonlocal left
            while not step.eof:
                if not left and not step.unconsumed_tail:
                    left = read(CHUNK)
                    if not left:
                        raise ValueError("archive ends within a member")
                given = step.unconsumed_tail + left
                left = b""
                if out := step.decompress(given, CHUNK):
                    yield out
            left = step.unused_data

        yield chunks()


def records(read) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; wrong framing or digests are errors."""
    for chunks in members(read):
        buffer = bytearray()
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            piece = next(chunks, None)
            if piece is None:
                raise ValueError("record without an end of its headers")
            buffer += piece
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        del buffer[: end + 4]
        for piece in chunks:
            buffer += piece
        if len(buffer) != size + 4 or buffer[size:] != b"\r\n\r\n":
            raise ValueError(f"block of {head['WARC-Record-ID']} is not {size} bytes")
        block = bytes(buffer[:size])
        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
        if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != head["WARC-Block-Digest"]:
            raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
        yield head, block


def with_first(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of each row.  Only digests
    and ids are grouped; payloads of pages that a bitmap shows to be no revisits
    are not shuffled, the others by page, so that a payload of many pages does
    not meet in one task.  Rows that share their page_id and
    payload have the same role; a null page_id is never a revisit."""
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    hashed = sized.withColumn("digest", F.sha2("payload", 256))
    known = land(hashed.where(F.length("payload") >= min_bytes).where("page_id IS NOT NULL")
                 .select("page_id", F.unhex("digest").alias("d")), "warc-digests")
    first = known.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    again = (known.join(first.drop("last"), "d").where("page_id > refers_to").distinct()
             .select("page_id", F.lower(F.hex("d")).alias("digest"), "refers_to"))
    return with_few(hashed, land(again, "warc-revisits"), ["page_id", "digest"])


def write_archives(rows: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """One archive for each partition of ``with_first`` rows; returns the names
    (path, n_records) as a landed table."""

    def run(batches):
        where, base = _open(folder)
        name, out, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                for r in (r for at in range(0, batch.num_rows, ROWS) for r in batch.slice(at, ROWS).to_pylist()):
                    if out is None:
                        where.create_dir(base, recursive=True)
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(deflated(record_bytes(r["page_id"], r["url"], r["payload"], r["refers_to"], r["digest"]), level))
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.record_batch({"path": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

    return land(rows.select("page_id", "url", "payload", "digest", "refers_to")
                .mapInArrow(run, "path string, n_records bigint"), "warc-names")


def _id(value: str | None):
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(names: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the named archives (``RECORD``; without ``payloads`` that
    column is null).  An archive with another number of records than was
    written is an error.  Archives are dealt out by name, one after another in
    a task."""
    schema = StructType.fromDDL(RECORD)
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, inner = _open(path)
                rows: list[dict] = []
                held = n = 0
                with where.open_input_stream(inner, compression=None) as f:
                    for head, block in records(f.read):
                        url = head.get("WARC-Target-URI")
                        rows.append({"page_id": _id(head["WARC-Record-ID"]), "url": None if url is None else _plain(url),
                                     "record_type": head["WARC-Type"], "refers_to": _id(head.get("WARC-Refers-To")),
                                     "payload_bytes": int(head["X-Payload-Length"]),
                                     "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"),
                                     "block_bytes": len(block), "payload": block if payloads else None})
                        n += 1
                        held += len(block) if payloads else 0
                        if held >= 16 * CHUNK or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{path} holds {n} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    # one archive to a task (a small table would be read by a single one)
    return names.repartition(max(1, names.count())).mapInArrow(run, schema)


def check_revisits(records: DataFrame) -> None:
    """Stop if a revisit names no response that was read, or one of another
    digest or length.  Each record that revisits name is looked up once, by id,
    digest and length."""
    named = (records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes")
             .agg(F.min("page_id").alias("by")))
    kept = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("block_bytes").alias("payload_bytes"))
    if lost := named.join(kept, ["refers_to", "payload_digest", "payload_bytes"], "leftanti").orderBy("by").limit(1).collect():
        raise ValueError(f"record {lost[0]['refers_to']} of digest {lost[0]['payload_digest']}, which {lost[0]['by']} revisits, was not read")


def with_payloads(records: DataFrame) -> DataFrame:
    """``records`` read with payloads, revisits with that of their response."""
    named = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    origin = (records.where("record_type = 'response'").join(named, ["page_id", "payload_digest"], "leftsemi")
              .select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("__own"))
              .dropDuplicates(["refers_to", "payload_digest"]))
    filled = records.where("record_type = 'revisit'").join(origin, ["refers_to", "payload_digest"])
    names = records.columns
    return (records.where("record_type = 'response'")
            .unionByName(filled.select(*[F.col("__own").alias(c) if c == "payload" else F.col(c) for c in names])))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder
    (or ``folder``), read them back and check the revisits; with ``payloads``
    every record has its payload, revisits too.  A null html is an empty
    payload; a long page is one long record; an empty table makes no archive
    and no rows."""
    folder = folder or scratch_path(spark, "warc")
    records = land(read_archives(write_archives(with_first(pages), folder), payloads), "warc-records")
    check_revisits(records)
    return with_payloads(records) if payloads else records
