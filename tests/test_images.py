import os
import struct
import zlib

import numpy as np
import pytest

from labelforge.operators.images import (
    channel_stats, count_files, image_channel_stats, list_images, load_images, normalise_pixels, resize_array,
    upscale, vector_channel_stats, write_image_table,
)


def _png(path, arr):
    """Write an 8-bit PNG (grey, RGB or RGBA by the last axis) with zlib."""
    arr = np.asarray(arr, dtype=np.uint8)
    if arr.ndim == 2:
        arr = arr[:, :, None]
    h, w, c = arr.shape
    color = {1: 0, 3: 2, 4: 6}[c]
    raw = b"".join(b"\x00" + arr[y].tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    png = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
           + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    with open(path, "wb") as f:
        f.write(png)


@pytest.fixture()
def image_dir(tmp_dir):
    d = os.path.join(tmp_dir, "imgs")
    os.makedirs(d)
    red = np.zeros((128, 128, 3), np.uint8)
    red[:, :, 0] = 255
    _png(os.path.join(d, "red.png"), red)
    half = np.zeros((128, 128, 3), np.uint8)
    half[64:] = 255
    _png(os.path.join(d, "half.PNG"), half)
    with open(os.path.join(d, "broken.jpg"), "wb") as f:
        f.write(b"not an image")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("x")
    return d


def test_listing_and_count(spark, image_dir):
    names = sorted(r.filename for r in list_images(spark, image_dir).collect())
    assert names == ["broken.jpg", "half.PNG", "red.png"]
    assert sorted(r.filename for r in list_images(spark, image_dir, ("png",), case_sensitive=True).collect()) == \
        ["red.png"]
    assert count_files(spark, image_dir) == 4


def test_channel_stats_fixture(spark, image_dir):
    rgb = load_images(spark, image_dir)
    errors = {r.filename: r.error for r in rgb.collect()}
    assert errors["red.png"] is None and errors["broken.jpg"] is not None
    stats = channel_stats(image_channel_stats(rgb)).first()
    assert (stats.mean_r, stats.mean_g, stats.mean_b) == (0.75, 0.25, 0.25)
    assert (stats.std_r, stats.std_g, stats.std_b) == (0.25, 0.25, 0.25)
    assert stats.n_images == 2


def test_grey_and_alpha_become_rgb(spark, tmp_dir):
    d = os.path.join(tmp_dir, "ga")
    os.makedirs(d)
    _png(os.path.join(d, "grey.png"), np.full((4, 4), 100, np.uint8))
    rgba = np.zeros((4, 4, 4), np.uint8)
    rgba[..., 0], rgba[..., 1], rgba[..., 2], rgba[..., 3] = 10, 20, 30, 255
    _png(os.path.join(d, "rgba.png"), rgba)
    rows = {r.filename: r for r in load_images(spark, d).collect()}
    g = np.frombuffer(rows["grey.png"].data, np.uint8).reshape(4, 4, 3)
    assert (g == 100).all()
    c = np.frombuffer(rows["rgba.png"].data, np.uint8).reshape(4, 4, 3)
    assert tuple(c[0, 0]) == (10, 20, 30)


def test_resize_kernels():
    const = np.full((10, 10, 3), 77, np.uint8)
    for m in ("bilinear", "lanczos"):
        assert np.allclose(resize_array(const, 20, 20, m), 77)
    ramp = np.tile(np.arange(16, dtype=np.uint8)[None, :, None] * 10, (4, 1, 3))
    up = resize_array(ramp, 4, 32, "bilinear")
    assert np.all(np.diff(up[0, 1:-1, 0]) >= 0)  # a ramp stays monotone
    with pytest.raises(ValueError):
        resize_array(const, 2, 2, "nearest")


def test_upscale_and_write(spark, image_dir, tmp_dir):
    rgb = load_images(spark, image_dir)
    up = upscale(rgb, 2).collect()
    assert sorted((r.method, r.filename, r.height, r.width) for r in up) == [
        ("bilinear", "half.PNG", 256, 256), ("bilinear", "red.png", 256, 256),
        ("lanczos", "half.PNG", 256, 256), ("lanczos", "red.png", 256, 256)]
    out = os.path.join(tmp_dir, "up")
    write_image_table(upscale(rgb, 2), out)
    assert {"method=bilinear", "method=lanczos"} <= set(os.listdir(out))
    assert spark.read.parquet(out).filter("method = 'lanczos'").count() == 2
    with pytest.raises(ValueError):
        upscale(rgb, 2, ("nearest",))


def test_normalise_pixels(spark, image_dir):
    rgb = load_images(spark, image_dir).filter("filename = 'red.png'")
    px = np.array(normalise_pixels(rgb, size=8).first().pixels).reshape(8, 8, 3)
    assert px[0, 0, 0] == pytest.approx((1.0 - 0.273) / 0.131, rel=1e-5)
    assert px[0, 0, 1] == pytest.approx((0.0 - 0.337) / 0.124, rel=1e-5)


def test_vector_channel_stats(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([2.0, 2.0],)], "v array<double>")
    r = vector_channel_stats(df, "v").first()
    assert (r.n, r.mean, r.std) == (2, 2.0, 0.5)


def test_attach_images(spark, image_dir):
    from labelforge.operators.joins import attach_images
    labels = spark.createDataFrame([("red.png", 1), ("gone.jpg", 0)], "filename string, label int")
    images = list_images(spark, image_dir).select("path")
    got = {r.filename: r.error for r in attach_images(labels, images).collect()}
    assert got["red.png"] is None and got["gone.jpg"] == "image not found: gone.jpg"
    with pytest.raises(Exception):
        attach_images(labels, images, strict=True).collect()


def test_stacks_of_sizes_give_what_single_images_give():
    """Images of several sizes and channels in one batch, and broken rows."""
    import pandas as pd

    from labelforge.operators.images import resize_array, stacks

    rng = np.random.default_rng(1)
    rows, want = [], {}
    for i in range(40):
        h, w, c = ((5, 7, 3), (4, 4, 1), (5, 7, 4), (9, 2, 3))[i % 4]
        x = rng.integers(0, 256, (h, w, c), dtype=np.uint8)
        rows.append((f"p{i}", h, w, c, x.tobytes(), None, True))
        want[i] = np.repeat(x, 3, 2) if c == 1 else x[..., 2::-1]
    rows += [("cut", 4, 4, 3, b"123", None, True), ("none", None, None, None, None, "undecodable image", True)]
    pdf = pd.DataFrame(rows, columns=["path", "height", "width", "n_channels", "data", "error", "bgr"])
    errors, found = stacks(pdf)
    got = {}
    for at, stack in found:
        for method in ("bilinear", "bicubic", "lanczos", "plain"):
            big = resize_array(stack, 6, 8, method)
            for i, x in zip(at, big, strict=True):
                assert np.array_equal(x, resize_array(want[i], 6, 8, method))
        got |= dict(zip(at.tolist(), stack, strict=True))
    assert sorted(got) == list(range(40)) and all(np.array_equal(got[i], want[i]) for i in got)
    assert errors[:40] == [None] * 40 and errors[40].startswith("decode: 3 bytes") and errors[41] == "undecodable image"


def test_inference_has_one_python_stage(spark, image_dir):
    from labelforge.operators.batch import batch_score
    from labelforge.operators.images import decoded_images, with_pixels

    scored = batch_score(decoded_images(spark, image_dir), lambda pdf: [float(p[0]) for p in pdf["pixels"]], ["pixels"], key="path",
                         failed="error", prepare=with_pixels(8))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "MapInArrow" not in plan and "EvalPython" not in plan
    got = {r.filename.rsplit("/", 1)[1]: (r.logit, r.error) for r in scored.collect()}
    assert got["red.png"][0] == pytest.approx((1.0 - 0.273) / 0.131, rel=1e-5) and got["broken.jpg"] == (None, "undecodable image")
