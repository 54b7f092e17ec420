import json
import os
import zlib

import pandas as pd
import pytest

from labelforge import api
from labelforge.operators import batch
from labelforge.sinks import line_log


def lines_of(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out += [json.loads(x) for x in f]
    return out


class Lost(BaseException):
    pass


def fetch_ok(pdf):
    return pd.DataFrame({"content": [b"x"] * len(pdf), "error": [None] * len(pdf)})


def annotator(calls, dies):
    def run(pdf):
        if dies and zlib.crc32(pdf["url"].iloc[0].encode()) % 7 == 0:
            raise Lost
        with open(os.path.join(calls, f"{os.getpid()}"), "a", encoding="utf-8") as f:
            f.writelines(f"{u}\n" for u in pdf["url"])
        return ['{"class_id": 1}'] * len(pdf)

    return run


def called(folder):
    return [u.strip() for name in os.listdir(folder) for u in open(os.path.join(folder, name), encoding="utf-8")]


def test_a_job_that_dies_keeps_what_it_made(spark, tmp_path):
    urls = [f"http://x/{i}" for i in range(600)] + ["http://x/7"] * 3
    (tmp_path / "urls.txt").write_text("\n".join(urls))
    out, calls = str(tmp_path / "out"), str(tmp_path / "calls")
    os.mkdir(calls)
    inp = str(tmp_path / "urls.txt")
    with pytest.raises(Exception, match="Lost"):
        api.annotate(spark, inp, out, annotator(calls, True), fetch_ok, flush_rows=8)
    made = len(called(calls))
    assert made
    api.annotate(spark, inp, out, annotator(calls, False), fetch_ok)
    records = lines_of(out)
    assert sorted(r["url"] for r in records) == sorted(urls)
    # at most the micro-batches of the running tasks were asked again
    assert len(called(calls)) <= len(urls) + 4 * 8 < len(urls) + made
    assert not line_log.unfinished(out)
    assert api.annotate(spark, inp, out, annotator(calls, False), fetch_ok).first()["to_do"] == 0
    assert lines_of(out) == records


def answer_of(url, error=None):
    return {"url": url, "status": "ok" if error is None else f"error: {error}", "model_text": '{"class_id": 2}', "error": error, "answered_at": 1.5}


def test_a_task_takes_the_answers_of_its_last_attempt(spark, tmp_path):
    """As after a lost executor: pieces of this job and task are there."""
    out, calls = str(tmp_path / "out"), str(tmp_path / "calls")
    os.mkdir(calls)
    begun = os.path.join(out, "_open", "job", "000000")
    os.makedirs(begun)
    with open(os.path.join(begun, "piece-000000.jsonl"), "w", encoding="utf-8") as f:
        f.writelines(json.dumps(a) + "\n" for a in (answer_of("a"), answer_of("b", "gone")))
    with open(os.path.join(begun, ".piece-000001.jsonl.1.begun"), "w", encoding="utf-8") as f:
        f.write('{"url": "c"')  # never finished
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string").coalesce(1)
    got = {r["url"]: r for r in batch.answer(df, annotator(calls, False), fetch_ok, journal=lambda: line_log.Journal(out, "job", 1)).collect()}
    assert sorted(called(calls)) == ["c", "d"] and sorted(got) == ["a", "b", "c", "d"]
    assert (got["a"]["model_text"], got["a"]["answered_at"]) == ('{"class_id": 2}', 1.5) and got["b"]["error"] == "gone"
    again = batch.answer(df, annotator(calls, True), fetch_ok, journal=lambda: line_log.Journal(out, "job", 1)).collect()
    assert len(again) == 4 and len(called(calls)) == 2


def test_answers_of_dead_jobs_count_unless_their_task_ended(spark, tmp_path):
    out, calls = tmp_path / "out", str(tmp_path / "calls")
    os.mkdir(calls)
    for job, task, answer in (("one", "000000", answer_of("http://a")), ("one", "000003", answer_of("http://b")), ("two", "000001", answer_of("http://c", "gone"))):
        folder = out / "_open" / job / task
        folder.mkdir(parents=True)
        (folder / "piece-000000.jsonl").write_text(json.dumps(answer) + "\n")
    (out / "part-one-000003.jsonl").write_text('{"url": "http://b", "prediction": {"class_id": 1}}\n')
    assert len(line_log.unfinished(str(out))) == 2
    (tmp_path / "urls.txt").write_text("http://a\nhttp://b\nhttp://c\nhttp://d\n")
    api.annotate(spark, str(tmp_path / "urls.txt"), str(out), annotator(calls, False), fetch_ok)
    assert called(calls) == ["http://d"]
    assert sorted((r["url"], r.get("error")) for r in lines_of(out)) == [("http://a", None), ("http://b", None), ("http://c", "gone"), ("http://d", None)]
    assert line_log.unfinished(str(out)) == [] == line_log.unfinished(str(tmp_path / "none"))


def test_files_are_whole_and_empty_tasks_write_none(spark, tmp_path):
    out = str(tmp_path / "out")
    line_log.append_lines(spark.createDataFrame([], "value string"), out, "none")
    assert not os.path.exists(out) or os.listdir(out) == []
    df = spark.range(40, numPartitions=3).selectExpr("to_json(struct(id)) value")
    line_log.append_lines(df, out, "job")
    assert sorted(os.listdir(out)) == [f"part-job-{i:06d}.jsonl" for i in range(3)]
    assert sorted(r["id"] for r in lines_of(out)) == list(range(40))
