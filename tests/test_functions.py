import math

import pytest

from labelforge.functions.labels import (
    class_name, label_from_text, percent_of_total, prediction_to_num, safe_ratio, sigmoid, to_int_label,
    uncertainty_band,
)
from labelforge.functions.losses import bce_with_logits, focal_loss
from labelforge.functions.text import (
    has_image_extension, normalise_key, path_basename, positional_name, strip_ws, url_basename,
)


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_band_boundaries(spark):
    rows = [(0.2499,), (0.25,), (0.75,), (0.7501,), (None,)]
    assert _one(spark, uncertainty_band("p", 0.25), rows, "p double") == ["FALSE", "?", "?", "TRUE", None]
    assert _one(spark, uncertainty_band("p", 0.5), [(0.5,)], "p double") == ["?"]
    # with t > 0.5 the FALSE test comes first and wins
    assert _one(spark, uncertainty_band("p", 0.6), [(0.5,)], "p double") == ["FALSE"]


def test_prediction_to_num(spark):
    rows = [("TRUE",), ("True",), ("FALSE",), ("False",), ("?",), ("true",), (None,)]
    assert _one(spark, prediction_to_num("p"), rows, "p string") == [1, 1, 0, 0, None, None, None]
    assert _one(spark, prediction_to_num("p", boolean=True), [(True,), (False,), (None,)], "p boolean") == [1, 0, None]


def test_label_from_text(spark):
    rows = [("TRUE",), ("FALSE",), ("true",), ("",)]
    assert _one(spark, label_from_text("t", "binary"), rows, "t string") == [1, 0, 0, 0]
    assert _one(spark, label_from_text("t", "verdict"), rows, "t string") == [1, 2, None, None]


def test_to_int_label_truncates_and_raises(spark):
    assert _one(spark, to_int_label("x"), [("1.0",), ("0",), ("1",)], "x string") == [1, 0, 1]
    with pytest.raises(Exception):
        spark.createDataFrame([("abc",)], "x string").select(to_int_label("x")).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([(None,)], "x string").select(to_int_label("x")).collect()


def test_sigmoid_and_losses(spark):
    df = spark.createDataFrame([(0.0, 1)], "z double, y int")
    r = df.select(sigmoid("z").alias("p"), bce_with_logits("z", "y").alias("b"),
                  focal_loss("z", "y").alias("f")).first()
    assert r.p == pytest.approx(0.5)
    assert r.b == pytest.approx(math.log(2), abs=1e-6)
    assert r.f == pytest.approx(0.67 * 0.25 * math.log(2), abs=1e-6)
    big = spark.createDataFrame([(50.0, 0), (-50.0, 1)], "z double, y int")
    vals = [r[0] for r in big.select(bce_with_logits("z", "y")).collect()]
    assert vals == [pytest.approx(50.0), pytest.approx(50.0)]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "a int, b int")
    assert [r[0] for r in df.select(safe_ratio("a", "b")).collect()] == [0.0, pytest.approx(1 / 3)]
    assert [r[0] for r in df.select(percent_of_total("a", "b")).collect()] == [0.0, 33.3]


def test_class_name(spark):
    assert _one(spark, class_name("c"), [(1,), (2,), (3,), (4,)], "c int") == ["Coniferous", "Deciduous", "Bad", None]


def test_text_functions(spark):
    rows = [(" a.jpg\t",), ("\r\nb ",), ("",)]
    assert _one(spark, strip_ws("s"), rows, "s string") == ["a.jpg", "b", ""]
    assert _one(spark, normalise_key("s"), [(12,)], "s int") == ["12"]
    urls = [("http://x/a/b.jpg",), ("http://x/a/",), ("http://x/q?v=1",)]
    assert _one(spark, url_basename("u"), urls, "u string") == ["b.jpg", "a", "q?v=1"]
    assert _one(spark, path_basename("u"), [("/d/e/f.png",)], "u string") == ["f.png"]
    assert _one(spark, positional_name("n", 3), [(7,), (1234,)], "n int") == ["007.jpg", "1234.jpg"]
    assert _one(spark, positional_name("n", 6), [(3,)], "n int") == ["000003.jpg"]
    exts = [("a.JPG",), ("b.jpeg",), ("c.png",), ("d.gif",), ("e.jpg.txt",)]
    assert _one(spark, has_image_extension("p"), exts, "p string") == [True, True, True, False, False]


def test_int_labels_fail_whatever_the_cast_rules(spark):
    import pytest
    from pyspark.sql import functions as F

    from labelforge.functions.labels import to_int_label

    df = spark.createDataFrame([("1.0",), ("0",), ("-2.9",)], "t string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            assert [r[0] for r in df.select(to_int_label("t")).collect()] == [1, 0, -2]
            for bad in ("x", "", "NaN", None):
                with pytest.raises(Exception, match="integer column|no integer"):
                    spark.createDataFrame([(bad,)], "t string").select(to_int_label(F.col("t"))).collect()
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)
