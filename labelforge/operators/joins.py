"""Join operators (D1, D3-D6) and the resume summary.

All are plain equi-joins; Catalyst/AQE pick the strategy from measured
sizes (no unconditional broadcast hint on a side that grows with the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelforge.functions.text import path_basename


def join_truth(predictions: DataFrame, labels: DataFrame, key: str = "filename") -> DataFrame:
    """Inner equi-join on the key; duplicate keys multiply."""
    return predictions.join(labels, key, "inner")


def counted_truth(predictions: DataFrame, labels: DataFrame, key: str = "filename",
                  prediction: str | list[str] = "prediction", label: str = "label") -> DataFrame:
    """D1 for reports: distinct (key, prediction) and (key, label) joined on
    the key, with ``n_rows``, the rows that the pair has in the plain join.
    A key repeated on both sides is summed before the join."""
    cols = [prediction] if isinstance(prediction, str) else list(prediction)
    p = predictions.groupBy(key, *cols).agg(F.count(F.lit(1)).alias("__lf_np"))
    y = labels.groupBy(key, label).agg(F.count(F.lit(1)).alias("__lf_ny"))
    return join_truth(p, y, key).withColumn("n_rows", F.col("__lf_np") * F.col("__lf_ny")).drop("__lf_np", "__lf_ny")


def pending(urls: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """D3: input rows whose key is not yet in the output (left anti join).
    Duplicate pending rows are kept."""
    return urls.join(done.select(key), key, "left_anti")


def resume_summary(urls: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Total input rows, processed keys (the distinct output set), and
    rows still to do.

    One tagged union grouped by key (map-side combined, so a URL repeated in
    a third of the list arrives as one partial row per task), then one
    global aggregate: the done set is read once and no anti join is needed."""
    tagged = (urls.select(F.col(key), F.lit(1).alias("n_in"), F.lit(0).alias("in_done"))
              .unionByName(done.select(F.col(key), F.lit(0).alias("n_in"), F.lit(1).alias("in_done"))))
    per_key = tagged.groupBy(key).agg(F.sum("n_in").alias("n_in"), F.max("in_done").alias("in_done"))
    # a null key never matches the output, as in the anti join
    is_done = (F.col("in_done") == 1) & F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n_in"), F.lit(0)).cast("long").alias("total"),
        F.count_if(is_done).alias("processed"),
        F.coalesce(F.sum(F.when(~is_done, F.col("n_in"))), F.lit(0)).cast("long").alias("to_do"),
    )


def skip_existing(targets: DataFrame, files: DataFrame, key: str = "filename",
                  overwrite: bool = False) -> DataFrame:
    """Tag each target ``exists`` when its destination file is present
    (unless ``overwrite``), else ``fetch``.  A left join against the distinct
    file names, so a listing with repeats cannot multiply targets."""
    if overwrite:
        return targets.withColumn("status", F.lit("fetch"))
    present = files.select(F.col(key)).distinct().withColumn("__lf_present", F.lit(True))
    joined = targets.join(present, key, "left")
    return (joined.withColumn("status", F.when(F.col("__lf_present"), F.lit("exists")).otherwise(F.lit("fetch")))
            .drop("__lf_present"))


def restrict_to_keys(df: DataFrame, keys: DataFrame, key: str = "filename") -> DataFrame:
    """Left semi join (keep rows whose key is in ``keys``)."""
    return df.join(keys.select(key), key, "left_semi")


def attach_images(labels: DataFrame, images: DataFrame, key: str = "filename",
                  path: str = "path", strict: bool = False) -> DataFrame:
    """Give each label row its image by file name (left join); a row
    without an image gets ``error``; ``strict`` fails the job on the first
    such row, as training does when a file is missing."""
    named = images.withColumn(key, path_basename(path))
    joined = labels.join(named, key, "left")
    missing = F.col(path).isNull()
    err = F.when(missing, F.concat(F.lit("image not found: "), F.col(key)))
    if strict:
        err = F.when(missing, F.raise_error(F.concat(F.lit("image not found: "), F.col(key))))
    return joined.withColumn("error", err)
