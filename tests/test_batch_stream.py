import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from labelforge.operators.batch import annotate, batch_score, fetch, validate_annotator
from labelforge.operators.metrics import confusion_matrix
from labelforge.sinks.files import write_csv, write_jsonl, write_uncertain
from labelforge.sources.annotations import read_annotations
from labelforge.streaming.incremental import annotate_incremental, read_annotation_output


def scorer(pdf):
    return pdf["x"].to_numpy() * 2.0


def failing_scorer(pdf):
    raise RuntimeError("gpu gone")


def test_batch_score(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", -3.0), ("c", 0.0)], "filename string, x double")
    got = {r.filename: r.prediction for r in batch_score(df, scorer, ["x"]).collect()}
    assert got == {"a": "TRUE", "b": "FALSE", "c": "?"}
    failed = batch_score(df, failing_scorer, ["x"]).collect()
    assert all(r.prediction == "?" and r.error.startswith("score:") for r in failed)


def fetcher(pdf):
    bad = pdf["url"].str.contains("dead")
    return pd.DataFrame({"content": np.where(bad, None, pdf["url"].str.upper()),
                         "error": np.where(bad, "404", None)})


def annotator(pdf):
    out = []
    for c in pdf["content"]:
        if "PROSE" in c:
            out.append("looks like a pine")
        elif "BOOM" in c:
            raise RuntimeError("oom")
        else:
            out.append('```json\n{"class_id": 1, "label": "coniferous", "confidence": 0.9}\n```')
    return out


def test_annotate_routes_errors(spark):
    urls = spark.createDataFrame([("http://x/ok",), ("http://x/dead",), ("http://x/prose",), ("http://x/done",)],
                                 "url string")
    done = spark.createDataFrame([("http://x/done",)], "url string")
    out = {r.url: r for r in annotate(urls, annotator, fetcher, done=done, content_type="string").collect()}
    assert set(out) == {"http://x/ok", "http://x/dead", "http://x/prose"}
    assert out["http://x/ok"].class_id == 1 and out["http://x/ok"].parsed
    assert out["http://x/dead"].class_id == 3 and out["http://x/dead"].error == "404"
    assert out["http://x/dead"].label == "bad"
    assert out["http://x/prose"].label == "bad_parse" and out["http://x/prose"].class_id == 3


def test_validate_counts_inference_failure_without_record(spark):
    gt = spark.createDataFrame([("http://x/a", 1), ("http://x/boom", 2), ("http://x/dead", 1)],
                               "url string, gt_label int")
    out = {r.url: r for r in validate_annotator(gt, annotator, fetcher, batch_size=1).collect()}
    assert out["http://x/boom"].pred_class == 3 and not out["http://x/boom"].written
    assert out["http://x/dead"].pred_class == 3 and out["http://x/dead"].written
    m = {r.truth: (r.pred_1, r.pred_3) for r in
         confusion_matrix(validate_annotator(gt, annotator, fetcher, batch_size=1), "gt_label", "pred_class")
         .collect()}
    assert m[1] == (1, 1) and m[2] == (0, 1)


def test_fetch_concurrency_bound(spark):
    urls = spark.range(100).select(F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("url"))
    out = fetch(urls, fetcher, concurrency=4, content_type="string")
    assert out.rdd.getNumPartitions() == 4 and out.filter("status = 'ok'").count() == 100


def test_sinks(spark, tmp_dir):
    preds = spark.createDataFrame([("a", "TRUE", 0.9, 2.0), ("b", "?", 0.5, 0.0)],
                                  "filename string, prediction string, probability double, logit double")
    assert write_uncertain(preds, os.path.join(tmp_dir, "unc"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "unc")).count() == 1
    assert not write_uncertain(preds.filter("prediction = 'TRUE'"), os.path.join(tmp_dir, "none"))
    assert not os.path.exists(os.path.join(tmp_dir, "none"))
    write_csv(preds, os.path.join(tmp_dir, "p"), ["filename", "prediction"])
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "p")).columns == ["filename", "prediction"]
    write_jsonl(preds.select("filename", F.lit("é").alias("t")), os.path.join(tmp_dir, "j"))
    txt = "".join(open(os.path.join(tmp_dir, "j", f), encoding="utf-8").read()
                  for f in os.listdir(os.path.join(tmp_dir, "j")) if f.startswith("part"))
    assert '"t":"é"' in txt


def test_incremental_stream_resumes(spark, tmp_dir):
    url_dir = os.path.join(tmp_dir, "in")
    os.makedirs(url_dir)
    with open(os.path.join(url_dir, "a.txt"), "w") as f:
        f.write("http://x/1\nhttp://x/2\n")
    out = os.path.join(tmp_dir, "out")
    ckpt = os.path.join(tmp_dir, "ckpt")
    annotate_incremental(spark, url_dir, out, annotator, fetcher, checkpoint=ckpt, content_type="string")
    assert read_annotation_output(spark, out).count() == 2
    with open(os.path.join(url_dir, "b.txt"), "w") as f:
        f.write("http://x/2\nhttp://x/3\n")  # x/2 is already in the output
    annotate_incremental(spark, url_dir, out, annotator, fetcher, checkpoint=ckpt, content_type="string")
    got = sorted(r.url for r in read_annotation_output(spark, out).collect())
    assert got == ["http://x/1", "http://x/2", "http://x/3"]
    records, rejects = read_annotations(spark, out)
    assert records.count() == 3 and rejects.count() == 0


def test_each_url_is_fetched_and_annotated_once(spark):
    fetch_calls = spark.sparkContext.accumulator(0)
    model_calls = spark.sparkContext.accumulator(0)

    def counting_fetcher(pdf):
        fetch_calls.add(len(pdf))
        return fetcher(pdf)

    def counting_annotator(pdf):
        model_calls.add(len(pdf))
        return annotator(pdf)

    urls = spark.createDataFrame([(f"http://x/{i}",) for i in range(40)] + [("http://x/dead",)], "url string")
    out = annotate(urls, counting_annotator, counting_fetcher, content_type="string").collect()
    assert len(out) == 41
    assert fetch_calls.value == 41  # no second branch re-fetches the rows
    assert model_calls.value == 40  # the failed fetch never reaches the annotator


def test_fetch_passes_timeout_when_accepted(spark):
    seen = spark.sparkContext.accumulator(0)

    def timed_fetcher(pdf, timeout):
        seen.add(int(timeout))
        return fetcher(pdf)

    urls = spark.createDataFrame([("http://x/a",)], "url string")
    assert fetch(urls, timed_fetcher, timeout=7, content_type="string").count() == 1
    assert seen.value == 7
    # a fetcher without the keyword is called as is
    assert fetch(urls, fetcher, timeout=7, content_type="string").filter("status = 'ok'").count() == 1


def test_fetch_calls_are_small_and_isolated(spark):
    """At most FETCH_BATCH rows a call; a raising call costs only its bad rows."""
    import pandas as pd
    from pyspark.sql import functions as F

    from labelforge.operators import batch

    def fetcher(pdf):
        if len(pdf) > batch.FETCH_BATCH:
            raise AssertionError("too many rows in a call")
        if (pdf["id"] % 50 == 0).any():
            raise RuntimeError("boom")
        return pd.DataFrame({"content": [str(len(pdf)).encode()] * len(pdf), "error": None})

    for at_once in (None, 4):
        got = batch.fetch(spark.range(5_000), fetcher, concurrency=at_once).collect()
        assert sorted(r.id for r in got) == list(range(5_000))
        assert {r.id for r in got if r.status != "ok"} == set(range(0, 5_000, 50))
        assert all(r.status == "error: boom" and r.content is None for r in got if r.id % 50 == 0)
    assert batch.fetch(spark.range(0), fetcher).agg(F.count("id")).first()[0] == 0


def test_wrong_number_of_answers_is_an_error(spark):
    import pandas as pd

    from labelforge.operators import batch

    out = batch.fetch(spark.range(3), lambda pdf: pd.DataFrame({"content": [], "error": []})).collect()
    assert all(r.status.startswith("error: 0 answers") for r in out)


def _made_once(weights):
    """Set-up that leaves a mark for each call."""
    folder, value = weights
    with open(os.path.join(folder, str(os.getpid())), "a", encoding="utf-8") as f:
        f.write("made\n")
    return lambda pdf: [value * x for x in pdf["x"]]


def test_a_model_is_set_up_once_in_a_worker(spark, tmp_dir):
    from labelforge.operators.batch import Model, answer, batch_score

    df = spark.range(4000, numPartitions=16).selectExpr("cast(id AS string) filename", "cast(id AS double) x")
    model = Model(_made_once, spark.sparkContext.broadcast((tmp_dir, 2.0)))
    for _ in range(3):  # several jobs, and many batches a task
        got = {r.filename: r.logit for r in batch_score(df, model, ["x"], batch_size=10).collect()}
        assert got == {str(i): 2.0 * i for i in range(4000)}
    marks = [open(os.path.join(tmp_dir, n), encoding="utf-8").read().count("made") for n in os.listdir(tmp_dir)]
    assert marks and set(marks) == {1}
    # annotators and fetchers are models as well as functions
    fetcher = Model(lambda _: lambda pdf: pd.DataFrame({"content": pdf["url"], "error": None}))
    asks = Model(lambda w: lambda pdf: [w + c for c in pdf["content"]], spark.sparkContext.broadcast("said "))
    urls = spark.createDataFrame([("a",), ("b",)], "url string")
    assert {r.url: r.model_text for r in answer(urls, asks, fetcher).collect()} == {"a": "said a", "b": "said b"}


def test_validation_is_one_python_stage_with_full_micro_batches(spark):
    """Micro-batches run over the fetcher's calls; contents do not leave the task."""
    gt = spark.range(100).select(F.concat(F.lit("http://x/"), F.when(F.col("id") % 10 == 0, "dead").otherwise("ok"), "id").alias("url"),
                                 F.lit(1).alias("gt_label")).coalesce(1)
    out = validate_annotator(gt, lambda part: [f"{len(part)} {type(part['content'].iloc[0]).__name__}"] * len(part), fetcher, batch_size=40, content_type="binary")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    got = out.collect()
    assert sorted(r["error"] or "" for r in got) == [""] * 90 + ["404"] * 10 and all(r["written"] for r in got)

    def few(part):
        if len(part) != 40:
            raise RuntimeError(f"{len(part)} {type(part['content'].iloc[0]).__name__}")
        return ["x"] * 40

    left = [r["error"] for r in validate_annotator(gt, few, fetcher, batch_size=40, content_type="binary").collect() if r["error"] not in (None, "404")]
    assert left == ["inference: 10 bytes"] * 10
