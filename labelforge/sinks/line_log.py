"""Durable answers and lines for jobs whose rows are dear to make.

* ``Journal``: a task saves its answers every few rows as whole files (pieces)
  under ``<path>/_open/<job>/<task>/``, which readers of the folder do not see.
* ``append_lines``: a Python Data Source; each task writes one visible file
  ``part-<job>-<task>.jsonl``, whole or not at all, and its commit message names
  it.  The files of tasks that ended stay when the job is aborted.

A task that is tried again (its executor was lost) finds the answers of the
attempt before; a later job finds those of jobs that died (``unfinished``) and
takes them instead of asking again.  They are forgotten only when a job has
written everything, and by then their keys are in the output, so a crash in
between repeats nothing.  One job at a time writes to a folder, without
speculative tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from labelforge.files import listed, open_folder, write_whole

OPEN = "_open"
FORMAT = "line_log"


def _task_folder(root: str, job: str, task: int) -> str:
    return f"{root}/{OPEN}/{job}/{task:06d}"


class Journal:
    """The saved answers (JSON objects) of the task that runs it."""

    def __init__(self, path: str, job: str, flush_rows: int):
        self.store, self.root = open_folder(path)
        self.folder = _task_folder(self.root, job, TaskContext.get().partitionId())
        self.flush_rows = flush_rows
        self.pieces = [f.path for f in listed(self.store, self.folder) if f.base_name.startswith("piece-")]
        self.waiting: list[bytes] = []

    def saved(self) -> list[dict]:
        """What earlier attempts of the task saved."""
        out = []
        for piece in self.pieces:
            with self.store.open_input_stream(piece) as begun:
                out += [json.loads(line) for line in begun.read().splitlines()]
        return out

    def add(self, answers: list[dict]) -> None:
        self.waiting += [json.dumps(a).encode() + b"\n" for a in answers]
        if len(self.waiting) >= self.flush_rows:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            piece = f"{self.folder}/piece-{len(self.pieces):06d}.jsonl"
            write_whole(self.store, piece, self.waiting)
            self.pieces.append(piece)
            self.waiting = []


@dataclass
class PartWritten(WriterCommitMessage):
    """What one task wrote: its file (none for no lines) and number of lines."""

    file: str | None
    lines: int


class LineLogWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"], options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = open_folder(self.path)
        target = f"{root}/part-{self.job}-{TaskContext.get().partitionId():06d}.jsonl"
        lines = 0

        def every() -> Iterator[bytes]:
            nonlocal lines
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    if line is not None:
                        lines += 1
                        yield line.encode() + b"\n"

        wanted = every()
        first = next(wanted, None)
        if first is None:
            return PartWritten(None, 0)
        write_whole(store, target, chain([first], wanted))
        return PartWritten(target, lines)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Every file is in place by then."""

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing is taken back: files of tasks that ended count as done."""


class LineLog(DataSource):
    """``df.write.format("line_log")`` with the options path and job; the frame
    has one text column."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> LineLogWriter:
        return LineLogWriter(dict(self.options))


def append_lines(lines: DataFrame, path: str, job: str) -> None:
    """Append the one text column of ``lines`` to the folder ``path``."""
    lines.sparkSession.dataSource.register(LineLog)
    lines.write.format(FORMAT).mode("append").option("path", path).option("job", job).save()


def unfinished(path: str) -> list[str]:
    """Folders with the saved answers of tasks that did not end: those that were
    running when their jobs died, so there are few.  For ``spark.read.json``."""
    store, root = open_folder(path)
    done = {f.base_name for f in listed(store, root)}
    return [task.path for job in listed(store, f"{root}/{OPEN}") for task in listed(store, job.path)
            if f"part-{job.base_name}-{task.base_name}.jsonl" not in done and listed(store, task.path)]


def forget(path: str) -> None:
    """Drop all saved answers (the output has their keys)."""
    store, root = open_folder(path)
    if store.get_file_info(f"{root}/{OPEN}").type.name == "Directory":
        store.delete_dir(f"{root}/{OPEN}")
