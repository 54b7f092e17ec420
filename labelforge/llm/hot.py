"""Joins of many narrow rows with one row for each key, where a few keys may
hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land

#: Bits of the largest bitmap that is broadcast (64 MB), and for each key.
BITMAP_BITS = 1 << 29
BITS_PER_KEY = 64
_BLOCK = 1 << 15  # bits of one row of bitmap_construct_agg
#: Groups that are broadcast at most.
BROADCAST_GROUPS = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, n_rows: int, how: str = "inner",
                limit: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row for each
    ``key`` (a column or several) and in ``size`` the number of rows that hold it (``n_rows`` in all).

    Keys held by at least ``n_rows / limit`` rows, of which there can be only
    ``limit``, are broadcast; the others are joined by a shuffle, in which no
    key has more rows than that.  ``rows`` is read twice, so it should be a
    written table.  ``how`` is inner or left; a null key finds nothing.
    """
    limit = BROADCAST_GROUPS if limit is None else limit
    least = max(1, -(-n_rows // limit))
    if least == 1 or groups.count() <= limit:
        return rows.join(F.broadcast(groups), key, how)
    hot = groups.where(F.col(size) >= least)
    found = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "leftanti").select(*rows.columns)
    return found.unionByName(others.join(groups.where(F.col(size) < least), key, how))


def words_of(packed: Column) -> Column:
    """A binary column of bitmap_construct_agg as an array of 32-bit numbers."""
    # four bytes are cut out before they are written as text, so a word costs the same wherever it stands
    at = lambda i: F.conv(F.hex(F.substring(packed, (4 * i + 1).cast("int"), F.lit(4))), 16, 10).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(packed) / 4).cast("int") - 1),
                       lambda i: (at(i) - F.when(at(i) >= 1 << 31, 1 << 32).otherwise(0)).cast("int"))


def bit_of(words: Column, position: Column) -> Column:
    """Whether a bit is set in a column of ``words_of``: bit 0 is the lowest of the first byte."""
    place = position.cast("int")
    inner = place.bitwiseXOR(F.lit(24)).bitwiseAND(F.lit(31))  # bytes come high ones first
    return F.call_function("shiftright", F.get(words, F.call_function("shiftright", place, F.lit(5))), inner).bitwiseAND(F.lit(1)) == 1


def in_bitmap(rows: DataFrame, cell: Column, cells: DataFrame, name: str) -> DataFrame:
    """``rows`` and the boolean ``name``: whether the number ``cell`` is among
    those of ``cells`` (column ``__cell``, not negative), by a broadcast bitmap.
    The caller bounds the numbers, and so the size of the bitmap."""
    at = F.col("__cell") + 1
    blocks = cells.groupBy(F.bitmap_bucket_number(at).alias("__block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits")).withColumn("__bits", words_of(F.col("__bits")))
    tested = rows.withColumn("__block", F.bitmap_bucket_number(cell + 1)).join(F.broadcast(land(blocks, "bitmap")), "__block", "left")
    found = F.coalesce(bit_of(F.col("__bits"), cell.bitwiseAND(F.lit(_BLOCK - 1))), F.lit(False))
    return tested.withColumn(name, found).drop("__block", "__bits")


def bitmap_bits(n_keys: int) -> int:
    """Size of a bitmap for so many keys, a power of two."""
    return 1 << max(20, min(BITMAP_BITS, max(1, n_keys) * BITS_PER_KEY).bit_length() - 1)


def may_hold(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` and ``__maybe``, false where ``names`` are certainly no row of
    ``keys``.  With more keys than the bitmap has room for, more rows may be."""
    bits = bitmap_bits(keys.count())
    cell = F.xxhash64(*names).bitwiseAND(F.lit(bits - 1))
    return in_bitmap(rows, cell, keys.select(cell.alias("__cell")), "__maybe")


def without_keys(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` whose ``names`` are not a row of ``keys`` (no nulls in either).
    Rows that a bitmap of the keys lets pass stay in place; the others are
    anti-joined."""
    tested = may_hold(rows, keys, names)
    checked = tested.where("__maybe").join(keys, names, "leftanti").select(*tested.columns)
    return tested.where("NOT __maybe").unionByName(checked).drop("__maybe")


def with_few(rows: DataFrame, few: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` left-joined to ``few`` (one row a key ``names``, other columns
    new), where most rows find nothing: those that a bitmap of the keys lets
    pass stay in place, with nulls, and only the others are shuffled."""
    tested = may_hold(rows, few, names)
    added = [f for f in few.schema.fields if f.name not in names]
    found = tested.where("__maybe").drop("__maybe").join(few, names, "left").select(*rows.columns, *[f.name for f in added])
    others = tested.where("NOT __maybe").select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return others.unionByName(found)
