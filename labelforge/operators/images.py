"""Image operators (A9, A10, B20, E10, E11, I8, I9, K4) and the vector form of
the channel statistics.

Spark's ``image`` source decodes files into ``struct<origin, height, width,
nChannels, mode, data>`` with BGR byte order; undecodable files arrive with
``height = -1`` when ``dropInvalid`` is off.  ``decoded_images`` keeps them so,
without a Python stage; every kernel (resize, statistics, upscaling, pixels)
takes such rows or those of ``load_images`` and brings them to RGB itself, so
bytes go to Python once.  Images of one size are one 4-D array.  The averages
across images are native aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labelforge.errors import require_path
from labelforge.files import full_path, open_folder, write_whole
from labelforge.functions.text import has_image_extension, path_basename
from labelforge.session import scratch_path
from labelforge.sources.files import list_files, with_content

from labelforge.fixed import IMAGE_EXTENSIONS, IMG_SIZE, NORM_MEAN, NORM_STD, UPSCALE_FACTOR, UPSCALE_METHODS


# ---------------------------------------------------------------- listing

def list_images(spark: SparkSession, folder: str, extensions: Sequence[str] = IMAGE_EXTENSIONS,
                case_sensitive: bool = False, recursive: bool = False) -> DataFrame:
    """``path, filename, length`` of image files (content never read)."""
    require_path(spark, folder)
    files = list_files(spark, folder, recursive)
    if case_sensitive:
        alternatives = "|".join(e.lstrip(".") for e in extensions)
        return files.filter(F.col("path").rlike(rf"\.({alternatives})$")).select("path", "length", "filename")
    return files.filter(has_image_extension("path", extensions)).select("path", "length", "filename")


def count_files(spark: SparkSession, folder: str) -> int:
    """Regular files directly in ``folder``."""
    require_path(spark, folder)
    return list_files(spark, folder).count()


#: Files and bytes that a task decodes, where there are more.
TASK_FILES, TASK_BYTES = 2000, 128 << 20


def _tasks(spark: SparkSession, n_files: int, n_bytes: int) -> int:
    """Tasks for so many files: of TASK_FILES or TASK_BYTES, and no fewer than cores."""
    return max(spark.sparkContext.defaultParallelism, -(-n_files // TASK_FILES), -(-n_bytes // TASK_BYTES))


def _unseen(spark: SparkSession, folder: str, hidden: DataFrame, tasks: int) -> DataFrame:
    """The images ``hidden``, whose names Spark's image source leaves out,
    decoded by it from copies with other names in the shared folder; ``path``
    is the image's own.  ``tasks`` tasks copy, and so many decode."""
    target = scratch_path(spark, "unseen-images")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            store, root = open_folder(target)
            for name, content in zip(pdf["filename"], pdf["content"], strict=True):
                write_whole(store, f"{root}/seen{name}", [content or b""])
            yield pdf[["filename"]]

    # a folder is listed by one task; the files are dealt to all
    with_content(hidden.repartition(tasks)).mapInPandas(run, "filename string").count()
    name = F.substr(path_basename("path"), F.lit(len("seen") + 1))
    return _decoded(spark, target, tasks).withColumn("path", F.concat(F.lit(full_path(folder, open_folder(folder)[1]) + "/"), name))


def _decoded(spark: SparkSession, folder: str, tasks: int) -> DataFrame:
    # the source plans a task for every few dozen files, however small they are
    raw = spark.read.format("image").option("dropInvalid", False).load(folder).coalesce(tasks)
    return raw.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                      F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """A10 as Spark decodes it: ``path, filename, height, width, n_channels,
    data, error, bgr``; images whose names begin with ``_`` or ``.`` too.  An
    undecodable file keeps its row with ``error`` set (decision: never a silent
    black substitute)."""
    require_path(spark, folder)
    listing = scratch_path(spark, "image-listing")
    list_files(spark, folder).write.parquet(listing)
    files = spark.read.schema("path string, filename string, length bigint").parquet(listing)
    hides = F.col("filename").rlike(r"^[_.]")
    hidden = files.filter(hides & has_image_extension("path", IMAGE_EXTENSIONS))
    known = {r["h"]: (r["n"], r["b"]) for r in files.filter(~hides).withColumn("h", F.lit(False)).unionByName(hidden.withColumn("h", F.lit(True)))
             .groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b")).collect()}
    seen = _decoded(spark, folder, _tasks(spark, *known.get(False, (0, 0))))
    return as_bgr(seen.unionByName(_unseen(spark, folder, hidden, _tasks(spark, *known[True]))) if True in known else seen)


def as_bgr(images: DataFrame) -> DataFrame:
    """Rows of the image source (``path, height, width, n_channels, data``) with
    the columns that kernels take."""
    ok = F.coalesce(F.col("height") > 0, F.lit(False))
    shape = [F.when(ok, F.col(c)).alias(c) for c in ("height", "width", "n_channels", "data")]
    return images.select("path", path_basename(F.regexp_replace("path", "/+$", "")).alias("filename"), *shape,
                         F.when(~ok, F.lit("undecodable image")).alias("error"), F.lit(True).alias("bgr"))


def load_images(spark: SparkSession, folder: str) -> DataFrame:
    """A10: decoded images as ``path, filename, height, width, n_channels,
    data (RGB bytes, row-major H x W x 3), error``.

    Grey images are expanded to three channels and alpha is dropped; an
    undecodable file keeps its row with ``error`` set."""
    return to_rgb(decoded_images(spark, folder))


_RGB_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("filename", T.StringType()),
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("n_channels", T.IntegerType()), T.StructField("data", T.BinaryType()),
    T.StructField("error", T.StringType()),
])


#: Pixels of input that a kernel works on at once (one image at least).
STACK_PIXELS = 1 << 20


def stacks(pdf: pd.DataFrame) -> tuple[list[str | None], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(errors, stacks) of a batch of images: an error or none for each row, and
    (rows, N x H x W x 3 RGB array) for runs of images of one size."""
    errors: list[str | None] = [None if e is None or e != e else str(e) for e in pdf["error"]]
    bgr = bool(pdf["bgr"].iloc[0]) if "bgr" in pdf.columns and len(pdf) else False
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i, (h, w, c, data) in enumerate(zip(pdf["height"], pdf["width"], pdf["n_channels"], pdf["data"], strict=True)):
        if errors[i] is None:
            if data is None or len(data) != int(h) * int(w) * int(c):
                errors[i] = f"decode: {0 if data is None else len(data)} bytes for {h} x {w} x {c}"
            else:
                groups.setdefault((int(h), int(w), int(c)), []).append(i)
    datas = pdf["data"].to_numpy()

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for (h, w, c), rows in groups.items():
            step = max(1, STACK_PIXELS // max(1, h * w))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                stack = np.frombuffer(b"".join(datas[part]), np.uint8).reshape(len(part), h, w, c)
                if c == 1:
                    stack = np.repeat(stack, 3, axis=3)
                elif bgr:
                    stack = stack[..., :3][..., ::-1]  # BGR(A) -> RGB, alpha dropped
                yield np.array(part), stack

    return errors, each()


def to_rgb(images: DataFrame) -> DataFrame:
    """Rows of the image source, or of ``decoded_images``, as RGB rows."""
    images = images if "bgr" in images.columns else as_bgr(images)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors, found = stacks(pdf)
            out = pdf[["path", "filename"]].assign(height=None, width=None, n_channels=None, data=None).astype(object)
            for rows, stack in found:
                out.loc[out.index[rows], ["height", "width", "n_channels"]] = [stack.shape[1], stack.shape[2], 3]
                datas = out["data"].to_numpy(copy=True)
                datas[rows] = [x.tobytes() for x in stack]
                out["data"] = datas
            yield out.assign(error=errors)[[f.name for f in _RGB_SCHEMA.fields]]

    return images.mapInPandas(run, _RGB_SCHEMA)


# ------------------------------------------------------------- resampling

def _cubic(x: np.ndarray) -> np.ndarray:
    """Keys' cubic with a = -0.5."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


#: Half width and shape of the filters that are widened when shrinking.
_FILTERS = {
    "bilinear": (1.0, lambda x: np.clip(1.0 - np.abs(x), 0.0, None)),
    "bicubic": (2.0, _cubic),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)),
}
#: ``plain``: bilinear between the two nearest pixels, without widening.
METHODS = (*_FILTERS, "plain")


@lru_cache(maxsize=256)
def taps(n_in: int, n_out: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight), each (n_out, taps): the few input pixels of every
    output pixel.  Pixel centres are aligned."""
    scale = n_in / n_out
    centre = (np.arange(n_out) + 0.5) * scale
    if method == "plain":
        low = np.floor(centre - 0.5)
        share = centre - 0.5 - low
        index = np.clip(np.stack([low, low + 1], 1).astype(np.int64), 0, n_in - 1)
        return index, np.stack([1 - share, share], 1)
    if method not in _FILTERS:
        raise ValueError(f"no resampling method {method!r}; there are {', '.join(METHODS)}")
    half, shape = _FILTERS[method]
    wide = max(scale, 1.0)
    begin = np.maximum(np.floor(centre - half * wide + 0.5), 0).astype(np.int64)
    end = np.minimum(np.floor(centre + half * wide + 0.5), n_in).astype(np.int64)
    index = begin[:, None] + np.arange(int((end - begin).max()))
    weight = np.where(index < end[:, None], shape((index + 0.5 - centre[:, None]) / wide), 0.0)
    return np.minimum(index, n_in - 1), weight / weight.sum(1, keepdims=True)


def _along(x: np.ndarray, n_out: int, method: str) -> np.ndarray:
    """Resample the first axis."""
    index, weight = taps(x.shape[0], n_out, method)
    out = np.zeros((n_out, *x.shape[1:]))
    for k in range(index.shape[1]):
        out += weight[:, k].reshape(-1, *[1] * (x.ndim - 1)) * x[index[:, k]]
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(x, 0.0, 255.0) + 0.5)


def resize_array(rgb: np.ndarray, height: int, width: int, method: str = "bilinear") -> np.ndarray:
    """Separable resampling of an H x W x C array, or of a stack of them, to
    whole values 0..255 (as float64).  The filters work on the rows first and
    keep whole values between the two passes, as 8-bit image libraries do;
    ``plain`` rounds once."""
    high, wide = rgb.ndim - 3, rgb.ndim - 2
    across = np.moveaxis(_along(np.moveaxis(rgb.astype(np.float64), wide, 0), width, method), 0, wide)
    across = across if method == "plain" else _whole(across)
    return _whole(np.moveaxis(_along(np.moveaxis(across, high, 0), height, method), 0, high))


# ------------------------------------------------------------ statistics

_STATS_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mean", T.ArrayType(T.DoubleType())),
    T.StructField("std", T.ArrayType(T.DoubleType())),
    T.StructField("error", T.StringType()),
])


def _listed(rows: np.ndarray) -> np.ndarray:
    """The rows of a 2-D array as objects."""
    out = np.empty(len(rows), object)
    out[:] = list(rows)
    return out


def image_channel_stats(rgb_images: DataFrame, size: int = IMG_SIZE) -> DataFrame:
    """Per image (I9 + E10 step): bicubic resize to ``size`` x ``size`` whole
    values, scale /255, per-channel mean and population std."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors, found = stacks(pdf)
            mean, std = np.empty(len(pdf), object), np.empty(len(pdf), object)
            for rows, stack in found:
                small = resize_array(stack, size, size, "bicubic") / 255.0
                mean[rows], std[rows] = _listed(small.mean(axis=(1, 2))), _listed(small.std(axis=(1, 2)))
            yield pd.DataFrame({"path": pdf["path"].to_numpy(), "mean": mean, "std": std, "error": errors})

    return rgb_images.mapInPandas(run, _STATS_SCHEMA)


def channel_stats(per_image: DataFrame, digits: int = 3) -> DataFrame:
    """Plain average of per-image means and of per-image stds (not a
    pooled std), over readable images, rounded to ``digits``."""
    ok = per_image.filter(F.col("error").isNull())
    aggs = []
    for i, ch in enumerate("rgb"):
        aggs.append(F.round(F.avg(F.col("mean")[i]), digits).alias(f"mean_{ch}"))
    for i, ch in enumerate("rgb"):
        aggs.append(F.round(F.avg(F.col("std")[i]), digits).alias(f"std_{ch}"))
    aggs.append(F.count(F.lit(1)).alias("n_images"))
    return ok.agg(*aggs)


def vector_channel_stats(df: DataFrame, vector: str = "embedding", group_by: str | None = None) -> DataFrame:
    """E10 in vector form: each row is one single-channel "image"; its mean
    and population std are computed with native higher-order functions, then
    averaged (per group)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
    per_row = df.select(*([group_by] if group_by else []), v.alias("__v"), mean.alias("__m"))
    var = F.aggregate(F.col("__v"), F.lit(0.0), lambda acc, x: acc + (x - F.col("__m")) * (x - F.col("__m"))) \
        / F.size("__v").cast("double")
    per_row = per_row.select(*([group_by] if group_by else []), "__m", F.sqrt(var).alias("__s"))
    grouped = per_row.groupBy(group_by) if group_by else per_row
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("__m").alias("mean"), F.avg("__s").alias("std"))


def normalise_pixels(rgb_images: DataFrame, size: int = IMG_SIZE, mean: Sequence[float] = NORM_MEAN,
                     std: Sequence[float] = NORM_STD) -> DataFrame:
    """Plain bilinear resize (no widening), /255, then (x - mean) / std
    per channel; the tensor is returned as a flat ``array<float>`` in H x W x C order."""
    schema = T.StructType([T.StructField("path", T.StringType()),
                           T.StructField("pixels", T.ArrayType(T.FloatType())),
                           T.StructField("error", T.StringType())])
    fill = with_pixels(size, mean, std)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fill(pdf)[["path", "pixels", "error"]]

    return rgb_images.mapInPandas(run, schema)


def with_pixels(size: int = IMG_SIZE, mean: Sequence[float] = NORM_MEAN, std: Sequence[float] = NORM_STD):
    """B20 as a function of a batch of images, for use inside another Python
    stage: the batch with ``pixels`` (and ``error`` where there are none)."""
    m, s = np.asarray(mean, dtype=np.float64), np.asarray(std, dtype=np.float64)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        errors, found = stacks(pdf)
        pixels = np.empty(len(pdf), object)
        for rows, stack in found:
            x = (resize_array(stack, size, size, "plain") / 255.0 - m) / s
            pixels[rows] = _listed(x.astype(np.float32).reshape(len(rows), -1))
        return pdf.assign(pixels=pixels, error=errors)

    return fill


# -------------------------------------------------------------- upscaling

_UPSCALED = T.StructType([
    T.StructField("method", T.StringType()), T.StructField("filename", T.StringType()),
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType()),
])


def upscale(rgb_images: DataFrame, scale: int = UPSCALE_FACTOR,
            methods: Sequence[str] = UPSCALE_METHODS) -> DataFrame:
    """I8: every readable image resized by ``scale`` with every method.
    An unknown method fails at once; a failing image/method pair is a row
    with ``error`` (reported and skipped by the writer)."""
    for m in methods:
        if m not in METHODS:
            raise ValueError(f"no resampling method {m!r}; there are {', '.join(METHODS)}")
    readable = rgb_images.filter(F.col("error").isNull())
    columns = [f.name for f in _UPSCALED.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors, found = stacks(pdf)
            names = pdf["filename"].to_numpy()
            bad = [i for i, e in enumerate(errors) if e is not None]
            for m in methods if bad else ():
                yield pd.DataFrame([(m, names[i], None, None, None, f"upscale: {errors[i]}") for i in bad], columns=columns)
            for rows, stack in found:
                for m in methods:
                    big = np.rint(resize_array(stack, stack.shape[1] * scale, stack.shape[2] * scale, m)).astype(np.uint8)
                    yield pd.DataFrame([(m, n, big.shape[1], big.shape[2], x.tobytes(), None) for n, x in zip(names[rows], big, strict=True)], columns=columns)

    return readable.mapInPandas(run, _UPSCALED)


def write_image_table(upscaled: DataFrame, path: str) -> None:
    """K4: pixel table partitioned by method (``<path>/method=<m>/``)."""
    (upscaled.filter(F.col("error").isNull()).write.mode("overwrite")
     .partitionBy("method").parquet(path))
