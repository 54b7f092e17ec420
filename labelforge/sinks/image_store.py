"""A folder of Parquet files with one row a name (K4, D4): appending, and
replacing rows by name.

To replace, new rows are written beside the store; the files that hold replaced
names are found by a join of names (contents are not read), and each is
rewritten without them in one task, row group by row group.  A swap note that
lists the files to bring in and to take out makes the change final: it is
carried out after every new file is whole, and again (``settle``) if the driver
dies in between, with the same outcome.  No shuffle carries contents.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelforge.errors import path_exists
from labelforge.files import listed, open_folder, write_whole

NOTES, STAGED = "_swaps", "_staged"


def settle(path: str) -> None:
    """Carry out swaps that a driver that died has begun."""
    store, root = open_folder(path)
    for note in listed(store, f"{root}/{NOTES}"):
        if not note.base_name.startswith("."):
            with store.open_input_stream(note.path) as f:
                _swap(store, root, json.loads(f.read()))
            store.delete_file(note.path)


def _swap(store, root: str, note: dict) -> None:
    staged = f"{root}/{STAGED}/{note['job']}"
    for f in listed(store, staged, recursive=True):
        if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith("."):
            store.move(f.path, f"{root}/{f.base_name}")
    for old in note["out"]:
        if store.get_file_info(old).is_file:
            store.delete_file(old)
    if store.get_file_info(staged).type.name == "Directory":
        store.delete_dir(staged)


def _rewritten(files: DataFrame, target: str) -> DataFrame:
    """Rewrite every file (``file``, ``rows``: numbers of the rows to leave out)
    into ``target``; the names of the files taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, name = file.rsplit("/", 1)
                store, root = open_folder(folder)
                to, to_root = open_folder(target)
                gone, at = set(rows), 0
                with store.open_input_file(f"{root}/{name}") as f:
                    source = pq.ParquetFile(f)
                    if len(gone) < source.metadata.num_rows:
                        kept = f"{to_root}/part-kept-{uuid.uuid5(uuid.NAMESPACE_URL, file).hex}.parquet"
                        begun = f"{to_root}/.{uuid.uuid4().hex}.begun"
                        with to.open_output_stream(begun) as out, pq.ParquetWriter(out, source.schema_arrow) as writer:
                            for part in source.iter_batches(batch_size=64):
                                stay = pa.array([at + i not in gone for i in range(part.num_rows)])
                                at += part.num_rows
                                writer.write_batch(part.filter(stay))
                        to.move(begun, kept)
                yield pa.record_batch({"file": pa.array([file])})

    return files.mapInArrow(run, "file string")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str, name: str = "filename") -> None:
    """Add ``rows`` (one a name) to the store; rows that have their names go."""
    spark = rows.sparkSession
    settle(path)
    if not path_exists(spark, path):
        append(rows, path)
        return
    store, root = open_folder(path)
    job = uuid.uuid4().hex
    staged = f"{path.rstrip('/')}/{STAGED}/{job}"
    store.create_dir(f"{root}/{STAGED}/{job}", recursive=True)
    rows.write.mode("append").parquet(f"{staged}/new")
    new = spark.read.schema(rows.schema).parquet(f"{staged}/new").select(name).distinct()
    held = spark.read.parquet(path).select(name, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # numbers of the rows of one file: no more than the file has
    touched = held.join(new, name, "leftsemi").groupBy("file").agg(F.collect_list("row").alias("rows"))
    out = [r["file"] for r in _rewritten(touched, staged).collect()]  # names of files, as every listing holds them
    note = {"job": job, "out": [open_folder(f)[1] for f in out]}
    write_whole(store, f"{root}/{NOTES}/{job}.json", [json.dumps(note).encode()])
    settle(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    settle(path)
    return spark.read.parquet(path)
