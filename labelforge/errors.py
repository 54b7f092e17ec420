"""Typed errors and the missing-input guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class LabelforgeError(Exception):
    """Base error of the engine."""


class MissingInputError(LabelforgeError, FileNotFoundError):
    """An input file or folder does not exist."""


class EmptyInputError(LabelforgeError):
    """An input exists but holds no rows where rows are required."""


def _fs_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` (a file, folder or glob) exists, through the public
    reader: resolving a file source lists the path and raises PATH_NOT_FOUND
    when it is absent; no file content is read."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return False
        raise
    return True


def require_path(spark: SparkSession, path: str) -> str:
    """Stop with a typed error when the input is absent."""
    if not _fs_exists(spark, path):
        raise MissingInputError(f"input not found: {path}")
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    return _fs_exists(spark, path)


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Raise ``EmptyInputError`` when ``df`` has no row (one-row probe)."""
    if df.isEmpty():
        raise EmptyInputError(f"{what} has no rows")
    return df
