from labelforge.operators.fusion import fuse_labels, fusion_stats


def _frames(spark):
    crowd = spark.createDataFrame(
        [(" a.jpg\t", "1"), ("b.jpg", "1.0"), ("c.jpg", "0"), ("d.jpg", "0"), ("e.jpg", "1"), ("f.jpg", "2")],
        "filename string, label string")
    model = spark.createDataFrame([("a.jpg", 0), ("b.jpg", 1), ("c.jpg", 0), ("d.jpg", 1), ("f.jpg", 0)],
                                  "filename string, label int")
    return crowd, model


def test_fusion_fixture(spark):
    crowd, model = _frames(spark)
    got = sorted(tuple(r) for r in fuse_labels(crowd, model).collect())
    assert got == [("a.jpg", 1), ("b.jpg", 1), ("c.jpg", 0)]
    s = fusion_stats(crowd, model).first().asDict()
    assert s == {"crowd": 6, "model": 5, "merged": 5, "final": 3, "positives": 2, "negatives": 1,
                 "discarded": 2, "risk": 1, "null_keys": 0}


def test_null_keys_never_match(spark):
    crowd = spark.createDataFrame([(None, 1), ("x", 1)], "filename string, label int")
    model = spark.createDataFrame([(None, 0), ("x", 0)], "filename string, label int")
    assert fusion_stats(crowd, model).first().merged == 1


def test_fusion_on_driver_table(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    crowd = labels.selectExpr("doc_id as filename", "quality as label")
    model = labels.selectExpr("doc_id as filename", "toxic as label")
    s = fusion_stats(crowd, model).first()
    assert (s.merged, s.positives, s.negatives, s.risk) == (399, 341, 49, 9)


def test_duplicate_keys_multiply_like_an_inner_merge(spark):
    crowd = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 0)], "filename string, label int")
    model = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 1)], "filename string, label int")
    rows = sorted(tuple(r) for r in fuse_labels(crowd, model).collect())
    assert rows == [("a", 1)] * 4 + [("b", 0)] * 2
    s = fusion_stats(crowd, model).first()
    assert (s.merged, s.final, s.positives, s.negatives, s.risk, s.discarded) == (10, 6, 4, 2, 4, 4)
