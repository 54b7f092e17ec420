"""Header CSV tables with explicit schemas (A5) and the missing-input guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labelforge import schemas
from labelforge.errors import require_path


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A5: header CSV; the columns of ``schema`` are found by their names, in
    any order and beside others, and cast (a value that does not fit is null).
    A missing column is an error; A11 on absence."""
    require_path(spark, path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if missing := [f.name for f in wanted.fields if f.name not in raw.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(raw.columns)}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_table_csv(spark, path, schemas.LABELS)


def read_predictions(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A predictions file, or only the named columns of it (the others may be
    missing then)."""
    fields = [f for f in schemas.PREDICTIONS.fields if not columns or f.name in columns]
    return read_table_csv(spark, path, T.StructType(fields))
