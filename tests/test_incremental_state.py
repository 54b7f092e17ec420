"""Bytes that a micro-batch reads do not grow with the batches before it."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import os, sys
import pandas as pd
from pyspark.sql import SparkSession
from labelforge.session import DEFAULT_CONF, ensure_checkpoint_dir, ship_package
from labelforge.streaming.incremental import annotate_incremental

base, batches = sys.argv[1], int(sys.argv[2])
b = SparkSession.builder.master("local[2]").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file:" + base + "/log")
b = b.config("spark.sql.shuffle.partitions", "2").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
for k, v in DEFAULT_CONF.items():
    b = b.config(k, v)
spark = b.getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
ensure_checkpoint_dir(spark); ship_package(spark)
os.makedirs(base + "/urls")
with open(base + "/seed.jsonl", "w") as f:
    f.writelines('{"url": "http://x/%d"}\\n' % i for i in range(40))
fetch = lambda pdf: pd.DataFrame({"content": [b"x"] * len(pdf), "error": [None] * len(pdf)})
answer = lambda pdf: ['{"class_id": 1}'] * len(pdf)
for n in range(batches):
    # each list repeats some URLs of the ones before, and of the seed
    with open(base + f"/urls/{n}.txt", "w") as f:
        f.writelines(f"http://x/{i}\\n" for i in range(n * 300, n * 300 + 400))
    annotate_incremental(spark, "file:" + base + "/urls", base + "/out", answer, fetch, checkpoint=base + "/ckpt", seed_outputs=(base + "/seed.jsonl",))
print(spark.read.text(base + "/out").count())
spark.stop()
"""


def test_bytes_read_do_not_grow_with_the_batches(tmp_path):
    base, batches = str(tmp_path), 6
    os.mkdir(os.path.join(base, "log"))
    script = os.path.join(base, "job.py")
    with open(script, "w", encoding="utf-8") as f:
        f.write(SCRIPT)
    env = dict(os.environ, PYTHONPATH=ROOT)
    run = subprocess.run([sys.executable, script, base, str(batches)], env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert int(run.stdout.split()[-1]) == batches * 300 + 100 - 40
    state = [f for _, _, files in os.walk(os.path.join(base, "ckpt", "state")) for f in files]
    assert any(f.endswith(".changelog") for f in state)  # changes of the keyed state, not copies of it
    batch_of, read = {}, {}
    (log,) = [os.path.join(base, "log", x) for x in os.listdir(os.path.join(base, "log"))]
    with open(log, encoding="utf-8") as f:
        for event in map(json.loads, f):
            if event["Event"] == "SparkListenerJobStart":
                number = (event.get("Properties") or {}).get("streaming.sql.batchId")
                batch_of |= {s: int(number) for s in event["Stage IDs"] if number is not None}
            elif event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in batch_of:
                got = event["Task Metrics"]["Input Metrics"]["Bytes Read"]
                read[batch_of[event["Stage ID"]]] = read.get(batch_of[event["Stage ID"]], 0) + got
    assert sorted(read) == list(range(batches)) and all(read.values())
    # the last batches read no more than the second one
    assert max(read[n] for n in range(2, batches)) <= 1.1 * read[1], read
