"""Exact positions and ranks without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY, or partitioned by a
two-valued label, funnels every row through one task.  Both helpers here keep
the work spread over all partitions:

* ``with_line_position`` numbers the lines of a file scan in file order
  (a DataFrame form of zipWithIndex): one pass counts rows per input split,
  a tiny prefix sum over the splits gives offsets, and the offsets are
  broadcast back (their size is the number of input splits, checked).
* ``with_rank`` ranks rows by a total order, optionally within groups: a range
  shuffle spreads even a single huge group over many partitions, rows are
  numbered inside each partition, the rows are written to the shared
  checkpoint folder (so both uses see the same numbering and a lost executor
  cannot renumber them), and per-(partition, group) offsets finish the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from labelforge.session import materialize

# An offsets table is broadcast while its counted rows fit this many bytes
# (numbers only, under 64 bytes a row: four million splits, 500 TB of input at
# 128 MB each); beyond that it is joined with a shuffle.
OFFSETS_BROADCAST_BYTES = 256 << 20
OFFSETS_ROW_BYTES = 64

_PID = "__lf_pid"
_MID = "__lf_mid"
_FILE = "__lf_file"
_BLOCK = "__lf_block"


def _bounded_broadcast(small: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(small) if n_rows * OFFSETS_ROW_BYTES <= OFFSETS_BROADCAST_BYTES else small


def with_line_position(scan: DataFrame, position_col: str = "seq") -> DataFrame:
    """Attach the 0-based position of each row in file order.

    ``scan`` must come straight from a file source (``spark.read.text`` etc.),
    so its input splits and their order within a file are stable: a split's
    rows are contiguous inside a partition and in file order.  Files are
    ordered by path."""
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("__lf_path"),
        F.xxhash64("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.spark_partition_id().alias(_PID),
        F.monotonically_increasing_id().alias(_MID),
    )
    # the split's number tells it apart already, the file's hash is the check
    splits = tagged.groupBy(_PID, _FILE, _BLOCK).agg(
        F.count(F.lit(1)).alias("__lf_n"), F.min(_MID).alias("__lf_base"), F.min("__lf_path").alias("__lf_path"))
    order = Window.orderBy("__lf_path", _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # one row per input split: a small table, ranked in one task on purpose
    offsets = splits.select(
        _PID, _FILE, _BLOCK, "__lf_base",
        F.coalesce(F.sum("__lf_n").over(order), F.lit(0)).alias("__lf_offset"),
    )
    offsets = materialize(offsets)
    joined = tagged.join(_bounded_broadcast(offsets, offsets.count()), [_PID, _FILE, _BLOCK])
    return joined.select(
        *[F.col(c) for c in scan.columns],
        (F.col("__lf_offset") + F.col(_MID) - F.col("__lf_base")).alias(position_col),
    )


def with_rank(df: DataFrame, order_by: Sequence, group_by: Sequence[str] = (),
              rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Attach an exact 0-based rank of each row within ``group_by`` groups by
    ``order_by``, which must be a total order (end it with a unique key).

    ``order_by`` holds column names or ascending/descending Column sort
    expressions over existing columns."""
    group_by = list(group_by)
    sort_keys = [F.col(g) for g in group_by] + [F.col(c) if isinstance(c, str) else c for c in order_by]
    # without an explicit count AQE may coalesce adjacent range partitions
    # (small inputs); ranges stay contiguous and ordered, so ranks stay exact
    ranged = (df.repartitionByRange(num_partitions, *sort_keys) if num_partitions
              else df.repartitionByRange(*sort_keys))
    numbered = (
        ranged
        .sortWithinPartitions(*sort_keys)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
    )
    numbered = materialize(numbered)
    keys = [_PID] + group_by
    blocks = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("__lf_n"), F.min(_MID).alias("__lf_base"))
    window = (Window.partitionBy(*group_by) if group_by else Window).orderBy(_PID) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *keys, "__lf_base",
        F.coalesce(F.sum("__lf_n").over(window), F.lit(0)).alias("__lf_offset"),
    )
    # derived from the checkpointed rows: recomputing it is deterministic and cheap
    offsets = offsets.select(*[F.col(k).alias(f"__lf_o{i}") for i, k in enumerate(keys)],
                             F.col("__lf_base").alias("__lf_obase"), "__lf_offset")
    n_blocks = offsets.count()
    # null-safe equality so a null group key still finds its own offsets
    cond = [F.col(k).eqNullSafe(F.col(f"__lf_o{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(_bounded_broadcast(offsets, n_blocks), cond)
    return joined.select(
        *[F.col(c) for c in df.columns],
        (F.col("__lf_offset") + F.col(_MID) - F.col("__lf_obase")).alias(rank_col),
    )
