"""Parallelism for per-row Python stages.

A Python batch stage (strict JSON guard, caller batch functions) runs once
per input partition.  A small input stored as one file / one row group would
run it in a single task; ``spread_scan`` round-robins such a *scan* over the
cluster's default parallelism.  The check reads the scan's planned split
count (file listing only, no job); on a large input, which already has more
splits than cores, it is a no-op and adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_scan(scan: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """``scan`` must be a file scan (plus narrow projections / filters)."""
    target = min_partitions or scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= target:
        return scan
    return scan.repartition(target)
