"""File sinks (K1-K3).

Writers are Spark writers: one file per task, no driver-side collection.
JSONL lines are rendered with ``to_json`` (VARIANT values stay JSON, null
fields are left out, non-ASCII text is kept) and written as text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """K1: header CSV with a fixed column order."""
    out = df.select(*columns) if columns else df
    out.write.mode(mode).option("header", True).csv(path)


def to_jsonl(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON object per row as a ``value`` text column."""
    cols = list(columns) if columns else df.columns
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", columns: Sequence[str] | None = None) -> None:
    """K2: JSON lines; ``append`` for the resumable annotation output."""
    to_jsonl(df, columns).write.mode(mode).text(path)


def write_uncertain(predictions: DataFrame, path: str, prediction: str = "prediction",
                    columns: Sequence[str] = ("filename", "prediction", "probability", "logit")) -> bool:
    """K3: only the ``?`` rows, and only when there are any (one-row probe)."""
    unsure = predictions.filter(F.col(prediction) == "?")
    if unsure.isEmpty():
        return False
    write_csv(unsure, path, list(columns))
    return True
