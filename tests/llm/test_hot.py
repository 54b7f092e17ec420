import pytest

from labelforge.llm import hot


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i % 7, f"v{i % 5}", i) for i in range(300)] + [(None, "v1", 300), (1, None, 301)], "a int, b string, own int").repartition(3)


def test_rows_without_keys(spark, rows):
    keys = spark.createDataFrame([(1, "v1"), (2, "v0"), (9, "v9")], "a int, b string")
    gone = {(1, "v1"), (2, "v0")}
    got = hot.without_keys(rows, keys, ["a", "b"])
    assert got.columns == rows.columns
    assert sorted(r["own"] for r in got.collect()) == sorted(r["own"] for r in rows.collect() if (r["a"], r["b"]) not in gone)
    assert hot.without_keys(rows, keys.limit(0), ["a", "b"]).count() == 302
    assert hot.without_keys(rows.limit(0), keys, ["a", "b"]).collect() == []


def test_rows_with_few(spark, rows):
    few = spark.createDataFrame([(1, "v1", 10, "x"), (2, "v0", None, "y"), (9, "v9", 3, "z")], "a int, b string, n long, w string")
    table = {(1, "v1"): (10, "x"), (2, "v0"): (None, "y")}
    got = hot.with_few(rows, few, ["a", "b"])
    assert got.columns == ["a", "b", "own", "n", "w"]
    assert {r["own"]: (r["n"], r["w"]) for r in got.collect()} == {r["own"]: table.get((r["a"], r["b"]), (None, None)) for r in rows.collect()}


def test_full_bitmaps_only_let_more_through(spark, rows, monkeypatch):
    """A bitmap in which every bit is set: all rows go the exact way."""
    monkeypatch.setattr(hot, "in_bitmap", lambda df, cell, cells, name: df.selectExpr("*", f"true AS {name}"))
    keys = spark.createDataFrame([(1, "v1")], "a int, b string")
    assert hot.without_keys(rows, keys, ["a", "b"]).count() == sum((r["a"], r["b"]) != (1, "v1") for r in rows.collect())


def test_bits_of_a_bitmap(spark):
    cells = [0, 1, 7, 8, 32767, 32768, 40000, 65535, 1 << 19]
    df = spark.createDataFrame([(c,) for c in range(0, 1 << 20, 997)] + [(c + d,) for c in cells for d in (-1, 0, 1) if c + d >= 0] + [(None,)], "c long")
    from pyspark.sql import functions as F

    got = hot.in_bitmap(df, F.col("c"), spark.createDataFrame([(c,) for c in cells], "__cell long"), "hit").collect()
    assert all(r["hit"] == (r["c"] in cells) for r in got) and sum(r["hit"] for r in got) >= len(cells)


def test_sizes_of_bitmaps():
    assert hot.bitmap_bits(0) == 1 << 20 == hot.bitmap_bits(10)
    assert hot.bitmap_bits(10**6) <= 64 * 10**6 <= 2 * hot.bitmap_bits(10**6)
    assert hot.bitmap_bits(10**12) == hot.BITMAP_BITS


def test_every_bit_of_a_word(spark):
    from pyspark.sql import functions as F

    df = spark.range(128).select(F.col("id").alias("c"))
    for step in (1, 3, 31, 32):
        got = hot.in_bitmap(df, F.col("c"), spark.range(0, 128, step).select(F.col("id").alias("__cell")), "hit").collect()
        assert sorted(r["c"] for r in got if r["hit"]) == list(range(0, 128, step))
