"""Exact dedup by two-pass Bloom filtering (operator 11).

First pass: every row adds one to the cell of its hash in a filter that is
spread over the cluster (cell numbers and counts only, summed before they are
shuffled, so a text that fills a third of the table costs one cell a task).
Cells counted twice or more make the second filter, a bitmap.  Second pass:
rows whose bit is not set are alone and go straight through; only the others
are shuffled, as digests and ids, and grouped by the SHA-256 of their text.

Everything is DataFrame functions.  Filters let too much through at most, so
results do not depend on their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land
from .hot import join_groups, in_bitmap

#: Cells for each row: one lone row in so many is looked at again.
CELLS_PER_ROW = 64
MIN_CELLS = 1 << 20
#: A second filter of up to so many cells (64 MB) is broadcast; a larger one is
#: joined on the cell.
BROADCAST_CELLS = 1 << 29


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of a text with every run of white space as one space;
    null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def cells_for(n_rows: int) -> int:
    """Size of the filters, a power of two."""
    return max(MIN_CELLS, 1 << (max(1, n_rows) * CELLS_PER_ROW - 1).bit_length())


def repeated_cells(prints: DataFrame, cells: int) -> DataFrame:
    """First pass: (cell, times) of the cells that two or more rows share."""
    return prints.groupBy(_cell(cells).alias("__cell")).agg(F.count(F.lit(1)).alias("__times")).where("__times > 1")


def _cell(cells: int) -> Column:
    return F.xxhash64("__sha").bitwiseAND(F.lit(cells - 1))


def mark_possible(rows: DataFrame, repeated: DataFrame, cells: int, n_rows: int,
                  broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Second pass: ``rows`` (with ``__sha``) and ``__maybe``, false for rows
    whose text is certainly alone."""
    if cells <= broadcast_cells:
        return in_bitmap(rows, _cell(cells), repeated, "__maybe")
    tested = join_groups(rows.withColumn("__cell", _cell(cells)), repeated, "__cell", "__times", n_rows, "left")
    return tested.withColumn("__maybe", F.col("__times").isNotNull()).drop("__cell", "__times")


def mark_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Of equal texts the row with the smallest id stays (rows without an id come
    last; of repeated rows with that id one stays); ``keep_id`` is its id and
    ``group_size`` counts the rows of the text.  A null text counts as empty,
    so null, empty texts are one group, and texts of white space alone another.
    Whole texts are compared, however long.  Other columns are not looked at;
    an empty table gives an empty result.
    """
    prints = land(df.select(df[id_col].alias("__id"), text_digest(df[text_col]).alias("__sha"),
                            F.monotonically_increasing_id().alias("__row")), "fingerprints")
    n_rows = prints.count()
    cells = cells_for(n_rows)
    repeated = land(repeated_cells(prints, cells), "repeated-cells")
    marked = mark_possible(prints, repeated, cells, n_rows, broadcast_cells)
    possible = land(marked.where("__maybe").drop("__maybe"), "possible-copies")
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    groups = land(possible.groupBy("__sha").agg(F.count(F.lit(1)).alias("__size"), first.alias("__first"))
                  .select("__sha", "__size", F.col("__first.id").alias("__keep"), F.col("__first.row").alias("__stays")), "copy-groups")
    resolved = join_groups(possible, groups, "__sha", "__size", possible.count())
    alone = marked.where("NOT __maybe").select(
        "__id", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__size"), F.lit(True).alias("__kept"), "__sha")
    out = alone.unionByName(resolved.select("__id", "__keep", "__size", (F.col("__row") == F.col("__stays")).alias("__kept"), "__sha"))
    return out.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
                      F.col("__kept").alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """``df`` without the rows that ``mark_copies`` does not keep, all columns.

    Rows that the second filter lets go are not shuffled; of the others those
    stay whose digest and id are the ones kept, one for each digest.
    """
    source = df.withColumn("__sha", text_digest(df[text_col]))
    prints = land(source.select(F.col(id_col).alias("__id"), "__sha"), "fingerprints")
    n_rows = prints.count()
    cells = cells_for(n_rows)
    repeated = land(repeated_cells(prints, cells), "repeated-cells")
    least = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id")))
    stays = land(mark_possible(prints, repeated, cells, n_rows, broadcast_cells).where("__maybe")
                 .groupBy("__sha").agg(least.alias("__first")).select(F.col("__sha").alias("__s"), F.col("__first.id").alias("__k")), "copies-kept")
    marked = mark_possible(source, repeated, cells, n_rows, broadcast_cells)
    same = (F.col("__sha") == F.col("__s")) & F.col(id_col).eqNullSafe(F.col("__k"))
    first = marked.where("__maybe").join(stays, same, "leftsemi").dropDuplicates(["__sha"])
    return marked.where("NOT __maybe").unionByName(first).select(*[F.col(f"`{c}`") for c in df.columns])
