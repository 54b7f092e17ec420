"""Hot keys: one key / stratum holding most rows must not land in one task."""

from pyspark.sql import functions as F

from labelforge.operators.fusion import fusion_stats
from labelforge.operators.joins import pending
from labelforge.operators.ordering import with_rank
from labelforge.operators.split import stratified_split


def test_rank_spreads_a_dominant_group(spark):
    n = 40000
    df = spark.range(n).select(F.col("id").alias("k"),
                               F.when(F.col("id") % 10 < 9, F.lit(1)).otherwise(F.lit(0)).alias("g"))
    ranked = with_rank(df, ["k"], group_by=["g"], num_partitions=8)
    sizes = [r["n"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
             .collect()]
    # 90% of the rows share one group, yet no partition holds more than a third of them
    assert max(sizes) < n / 3
    top = ranked.filter("g = 1").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"),
                                     F.countDistinct("rank").alias("d")).first()
    assert (top.lo, top.hi, top.d) == (0, 35999, 36000)


def test_split_with_a_dominant_stratum(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("filename"),
                                   F.when(F.col("id") < 19000, F.lit(1)).otherwise(F.lit(0)).alias("label"))
    sizes = {(r.label, r.split): r["count"] for r in stratified_split(df).groupBy("label", "split").count().collect()}
    assert sizes[(1, "train")] == 13300 and sizes[(1, "val")] == 2850 and sizes[(1, "test")] == 2850
    assert sizes[(0, "train")] == 700


def test_fusion_with_a_hot_duplicated_key(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("filename"), F.lit(0).alias("label"))
    rest = spark.range(6000).select(F.col("id").cast("string").alias("filename"), F.lit(1).alias("label"))
    crowd = hot.unionByName(rest)
    model = spark.createDataFrame([("hot", 0), ("hot", 0)], "filename string, label int").unionByName(rest)
    s = fusion_stats(crowd, model).first()
    # 3000 x 2 pairs for the hot key come from one aggregated row, not 6000 joined rows
    assert (s.merged, s.negatives, s.positives) == (6000 + 6000, 6000, 6000)


def test_anti_join_keeps_duplicate_hot_urls(spark):
    urls = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("u-hot"))
                                    .otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("url"))
    done = spark.createDataFrame([("u1",), ("u2",)], "url string")
    assert pending(urls, done).filter("url = 'u-hot'").count() == 3000


def test_a_key_hot_on_both_sides_is_expanded_in_chunks(spark):
    """50,000 x 50,000 rows of one key: counted, and cut into chunks of bounded
    size, without a row that holds them all."""
    from pyspark.sql import functions as F

    from labelforge.operators import fusion

    side = spark.range(50_000).select(F.lit("k").alias("filename"), F.lit(1).alias("label"))
    s = fusion.fusion_stats(side, side).first()
    assert s.merged == s.positives == 2_500_000_000
    small = spark.range(600).select(F.lit("k").alias("filename"), F.lit(1).alias("label"))
    assert fusion.fuse_labels(small, small).count() == 360_000 > fusion.EXPAND_ROWS


def test_reports_of_a_hot_key_do_not_pair_its_rows(spark):
    from pyspark.sql import functions as F

    from labelforge.operators.metrics import binary_report

    preds = spark.range(40_000).select(F.lit("k").alias("filename"), F.when(F.col("id") % 2 == 0, "TRUE").otherwise("?").alias("prediction"))
    truth = spark.range(40_000).select(F.lit("k").alias("filename"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    r = binary_report(preds, truth).first()
    assert (r.total, r.confident_total, r.tp, r.fp) == (1_600_000_000, 800_000_000, 200_000_000, 600_000_000)
