"""Local scale trial of the hot paths on rows generated with spark.range.

Not part of the query catalogue (its inputs are generated, not the driver's
tables): it only checks that skewed keys and large fills stay spread over
tasks.  Usage: python tools/scale_trial.py
"""
import os
import sys, time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F
from labelforge.session import local_session
from labelforge.operators.fusion import fusion_stats, fuse_labels
from labelforge.operators.split import stratified_split
from labelforge.operators.select import quota_fill
spark = local_session(8, shuffle_partitions=16, memory="8g")
N = 5_000_000
def t(name, fn):
    t0 = time.perf_counter(); out = fn(); print(f"{name}: {time.perf_counter()-t0:.1f}s {out}", flush=True)
base = spark.range(N)
# a third of the rows share one key
crowd = base.select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("filename"),
                    (F.col("id") % 2).cast("int").alias("label"))
model = base.select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("filename"),
                    (F.col("id") % 5 == 0).cast("int").alias("label"))
t("fusion_stats", lambda: fusion_stats(crowd.filter("filename <> 'hot'").unionByName(crowd.filter("filename = 'hot'").limit(1000)),
                                       model.filter("filename <> 'hot'").unionByName(model.filter("filename = 'hot'").limit(1000))).first().asDict())
t("fuse_labels count (hot key 1000x1000)", lambda: fuse_labels(crowd.filter("filename <> 'hot'").unionByName(crowd.filter("filename = 'hot'").limit(1000)),
                                       model.filter("filename <> 'hot'").unionByName(model.filter("filename = 'hot'").limit(1000))).count())
lab = base.select(F.col("id").cast("string").alias("filename"), (F.col("id") % 10 < 9).cast("int").alias("label"))
t("split 90% stratum", lambda: sorted(tuple(r) for r in stratified_split(lab).groupBy("split").count().collect()))
rec = base.select(F.col("id").alias("seq"), F.col("id").cast("string").alias("url"),
                  (F.col("id") % 3 == 0).alias("is_bad"), ((F.col("id") * 7919) % 1000 / 1000.0).alias("confidence"))
t("quota_fill target 3.5M (exact-rank path)", lambda: quota_fill(rec, 3_500_000).groupBy("bucket").count().collect())
