import os

import pytest
from pyspark.sql import functions as F

from labelforge.operators.batch import image_names, with_lineage
from labelforge.operators.metrics import reduce_loss, split_sizes
from labelforge.operators.select import bounded_error_log, distinct_keys, head, sorted_listing, union_all
from labelforge.sources.text import read_lines


def test_line_positions_over_several_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    for name, n in (("b.txt", 3), ("a.txt", 2), ("c.txt", 4)):
        with open(os.path.join(d, name), "w") as f:
            f.write("".join(f"{name}-{i}\n" for i in range(n)))
    got = [r.value for r in read_lines(spark, d).orderBy("seq").collect()]
    assert got == [f"a.txt-{i}" for i in range(2)] + [f"b.txt-{i}" for i in range(3)] + \
        [f"c.txt-{i}" for i in range(4)]


def test_head_and_error_log(spark):
    df = spark.createDataFrame([(i, f"u{i}") for i in range(30, 0, -1)], "pos long, url string")
    assert [r.pos for r in head(df, 5, "pos").collect()] == [1, 2, 3, 4, 5]
    first, rest = bounded_error_log(df, 10)
    assert [r.pos for r in first.collect()] == list(range(1, 11)) and rest.first().suppressed == 20
    assert [r.pos for r in sorted_listing(df, "pos").limit(3).collect()] == [1, 2, 3]


def test_union_and_distinct(spark):
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    b = spark.createDataFrame([("y",), (None,), ("x",)], "k string")
    u = union_all(a, b)
    assert u.count() == 4 and set(u.columns) == {"k", "v"}
    assert sorted(r.k for r in distinct_keys(u, "k").collect()) == ["x", "y"]


def test_reduce_loss_and_split_sizes(spark):
    df = spark.createDataFrame([(1.0, "train", 1), (3.0, "train", 0), (2.0, "test", 1)],
                               "loss double, split string, label int")
    r = df.agg(reduce_loss(F.col("loss"), "mean").alias("m"), reduce_loss(F.col("loss"), "sum").alias("s")).first()
    assert (r.m, r.s) == (2.0, 6.0)
    assert reduce_loss(F.col("loss"), "none") is not None
    with pytest.raises(ValueError):
        reduce_loss(F.col("loss"), "max")
    sizes = {r.split: (r.n_rows, r.n_positive) for r in split_sizes(df).collect()}
    assert sizes == {"train": (2, 1), "test": (1, 1)}


def test_lineage_and_names(spark):
    df = spark.createDataFrame([("/a/b/c.jpg", 2)], "path string, g int")
    out = with_lineage(image_names(df), model_id="m", gt_label="g").first()
    assert out.filename == "c.jpg" and out.model == "m" and out.gt_label == 2 and out.timestamp > 1.6e9


def test_scale_conf():
    from labelforge.session import scale_conf
    conf = scale_conf(100 * (1 << 40), 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 819200
    assert conf["spark.sql.adaptive.enabled"] == "true"
    assert int(scale_conf(1 << 20, 64)["spark.sql.shuffle.partitions"]) == 192
