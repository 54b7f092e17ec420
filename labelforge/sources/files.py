"""Files as rows (A9, E11): a Python Data Source that lists folders, with names
that begin with ``_`` or ``.`` (Spark's own file sources leave those out), and
reading of contents in the task that needs them (D6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from labelforge.files import full_path, listed, open_folder

FORMAT = "file_listing"
SCHEMA = "path string, filename string, length bigint"
#: Rows of one Arrow batch of a listing.
_ROWS = 10_000


@dataclass
class Folder(InputPartition):
    """One folder for one task: its files, or all below it."""

    path: str
    recursive: bool


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """The folder itself, and (recursive) everything below each folder in
        it; the driver looks at one level only."""
        store, root = open_folder(self.path)
        below = [f.path for f in listed(store, root) if f.type == pafs.FileType.Directory] if self.recursive else []
        return [Folder(root, False), *[Folder(p, True) for p in below]]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(self.path)
        files = [f for f in listed(store, partition.path, partition.recursive) if f.type == pafs.FileType.File]
        for at in range(0, len(files), _ROWS):
            part = files[at : at + _ROWS]
            yield pa.record_batch({"path": pa.array([full_path(self.path, f.path) for f in part]), "filename": pa.array([f.base_name for f in part]),
                                   "length": pa.array([f.size for f in part], pa.int64())})


class FileListing(DataSource):
    """``spark.read.format("file_listing").load(folder)``, option recursive."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ListingReader:
        return ListingReader(dict(self.options))


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, filename, length`` of the regular files in ``folder`` (and, if
    ``recursive``, below it), whatever their names; contents are not read."""
    spark.dataSource.register(FileListing)
    return spark.read.format(FORMAT).option("recursive", str(recursive).lower()).load(folder)


def with_content(df: DataFrame, path: str = "path", content: str = "content", error: str = "error") -> DataFrame:
    """``df`` with the bytes of the file ``path`` names, read in the task; null
    for a null path, and for a file that cannot be read, whose reason goes to
    ``error`` (an earlier error stays).  Nothing is shuffled."""
    names = [c for c in df.columns if c not in (content, error)]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(content, T.BinaryType()), T.StructField(error, T.StringType())])
    earlier = error in df.columns

    def one(place: str | None) -> tuple[bytes | None, str | None]:
        if place is None:
            return None, None
        try:
            folder, name = place.rsplit("/", 1)
            store, root = open_folder(folder)
            with store.open_input_stream(f"{root}/{name}") as f:
                return f.read(), None
        except OSError as exc:
            return None, f"read: {type(exc).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 32):  # contents of so many files at once
                part = pdf.iloc[at : at + 32]
                got = [one(p) for p in part[path]]
                before = part[error].tolist() if earlier else [None] * len(part)
                yield part[names].assign(**{content: [c for c, _ in got], error: [b or e for b, (_, e) in zip(before, got, strict=True)]})

    return df.mapInPandas(run, schema)
