import json
import os
import time

import numpy as np
import pandas as pd
import pytest

from labelforge import api
from test_images import _png


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def _read_dir_lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part"):
            with open(os.path.join(path, name), encoding="utf-8") as f:
                out.extend(line.rstrip("\n") for line in f if line.strip())
    return out


def test_fuse(spark, tmp_dir):
    c = _write(os.path.join(tmp_dir, "crowd.csv"), "filename,label\na.jpg,1\nb.jpg,0\nc.jpg,0\n")
    m = _write(os.path.join(tmp_dir, "model.csv"), "filename,label\na.jpg,0.0\nb.jpg,0\nc.jpg,1\n")
    fused, stats = api.fuse(spark, c, m, os.path.join(tmp_dir, "out"))
    assert sorted(tuple(r) for r in fused.collect()) == [("a.jpg", 1), ("b.jpg", 0)]
    assert stats.first().risk == 1


def test_evaluate_and_calibrate(spark, tmp_dir):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 200)
    y = (rng.random(200) < 1 / (1 + np.exp(-z))).astype(int)
    p = 1 / (1 + np.exp(-z))
    band = np.where(p < 0.25, "FALSE", np.where(p > 0.75, "TRUE", "?"))
    names = [f"{i:03d}.jpg" for i in range(200)]
    pd.DataFrame({"filename": names, "prediction": band, "probability": p, "logit": z}).to_csv(
        os.path.join(tmp_dir, "preds.csv"), index=False)
    pd.DataFrame({"filename": names, "label": y}).to_csv(os.path.join(tmp_dir, "labels.csv"), index=False)
    rep = api.evaluate(spark, os.path.join(tmp_dir, "preds.csv"), os.path.join(tmp_dir, "labels.csv")).first()
    assert rep.total == 200 and rep.uncertain_count == int((band == "?").sum())
    test = api.evaluate(spark, os.path.join(tmp_dir, "preds.csv"), os.path.join(tmp_dir, "labels.csv"),
                        subset="test").first()
    assert test.total == 30
    cal = api.calibrate(spark, os.path.join(tmp_dir, "preds.csv"), os.path.join(tmp_dir, "labels.csv"),
                        os.path.join(tmp_dir, "calib")).first()
    assert cal.n == 200 and cal.brier_cal <= cal.brier_raw + 1e-9


def fetch_ok(pdf):
    return pd.DataFrame({"content": [u.encode() for u in pdf["url"]], "error": [None] * len(pdf)})


def verdicts(pdf):
    return ['{"class_id": 2, "label": "deciduous", "confidence": 0.3}' if bytes(c).endswith(b"/b") else "??"
            for c in pdf["content"]]


def test_annotate_resume_then_select(spark, tmp_dir):
    inp = _write(os.path.join(tmp_dir, "urls.txt"), "http://x/a\nhttp://x/b\n\nhttp://x/b\n")
    out = os.path.join(tmp_dir, "ann")
    s1 = api.annotate(spark, inp, out, verdicts, fetch_ok).first()
    assert (s1.total, s1.processed, s1.to_do) == (3, 0, 3)
    s2 = api.annotate(spark, inp, out, verdicts, fetch_ok).first()
    assert (s2.total, s2.processed, s2.to_do) == (3, 2, 0)
    assert len(_read_dir_lines(out)) == 3
    sel_out = os.path.join(tmp_dir, "sel")
    api.select(spark, out, sel_out, target=2)
    lines = [json.loads(x) for x in _read_dir_lines(sel_out)]
    assert lines[0]["prediction"]["label"] == "bad_parse"  # bad rows first
    assert [x["prediction"].get("confidence") for x in lines[1:]] == [0.3]


def test_validate(spark, tmp_dir):
    inp = _write(os.path.join(tmp_dir, "gt.txt"), "is_conifer downloadUrl\nTRUE http://x/a\nFALSE http://x/b\n")
    matrix, report = api.validate(spark, inp, os.path.join(tmp_dir, "val"), verdicts, fetch_ok)
    m = {r.truth: (r.pred_1, r.pred_2, r.pred_3) for r in matrix.collect()}
    assert m == {1: (0, 0, 1), 2: (0, 1, 0), 3: (0, 0, 0)}
    assert len(_read_dir_lines(os.path.join(tmp_dir, "val"))) == 2


def test_ingest_no_markup_and_markup(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    inp = _write(os.path.join(tmp_dir, "list.txt"), "url\nhttp://x/a.jpg\nftp://bad\n\nhttp://x/q?id=1\n")
    s = api.ingest(spark, inp, store, fetch_ok, type="no_markup").first()
    assert (s.total, s.downloaded, s.skipped, s.failed) == (4, 2, 0, 1)
    s = api.ingest(spark, inp, store, fetch_ok, type="no_markup").first()
    assert (s.downloaded, s.skipped) == (0, 2)
    more = _write(os.path.join(tmp_dir, "list2.txt"), "url\nhttp://x/a.jpg\nhttp://x/new.jpg\n")
    s = api.ingest(spark, more, store, fetch_ok, type="no_markup").first()
    assert (s.total, s.downloaded, s.skipped, s.failed) == (2, 1, 1, 0)
    assert spark.read.parquet(store).count() == 3
    tsv = _write(os.path.join(tmp_dir, "m.tsv"),
                 "is_conifer\tdownloadUrl\nTRUE\thttp://x/1\nFALSE\thttp://x/2\nTRUE http://x/3\n")
    labels = os.path.join(tmp_dir, "labels")
    s = api.ingest(spark, tsv, os.path.join(tmp_dir, "store2"), fetch_ok, type="markup", labels_path=labels).first()
    assert (s.total, s.downloaded, s.failed, s.kept, s.unknown_labels) == (3, 2, 1, 2, 0)
    odd = _write(os.path.join(tmp_dir, "odd.tsv"), "is_conifer\tdownloadUrl\nTRUE\thttp://x/1\ntrue\thttp://x/2\n?\thttp://x/3\n?\thttp://x/4\n")
    assert api.ingest(spark, odd, os.path.join(tmp_dir, "store3"), fetch_ok, type="markup").first().unknown_labels == 3
    got = sorted(tuple(r) for r in spark.read.option("header", True).csv(labels).collect())
    assert got == [("000.jpg", "1"), ("001.jpg", "0")]


def scorer(pdf):
    return [float(np.mean(p)) * 10 for p in pdf["pixels"]]


def test_infer_and_image_jobs(spark, tmp_dir):
    d = os.path.join(tmp_dir, "imgs")
    os.makedirs(d)
    _png(os.path.join(d, "a.png"), np.full((8, 8, 3), 255, np.uint8))
    _png(os.path.join(d, "b.png"), np.zeros((8, 8, 3), np.uint8))
    with open(os.path.join(d, "c.jpg"), "wb") as f:
        f.write(b"junk")
    out_csv = os.path.join(tmp_dir, "pred", "predictions.csv")
    summary = api.infer(spark, d, out_csv, scorer, img_size=8).first()
    assert summary.total == 3 and summary.n_uncertain == 1
    preds = {r.filename: r.prediction for r in spark.read.option("header", True).csv(out_csv).collect()}
    assert preds == {"a.png": "TRUE", "b.png": "FALSE", "c.jpg": "?"}
    assert os.path.exists(os.path.join(tmp_dir, "pred", "uncertain.csv"))
    stats = api.image_statistics(spark, d, img_size=8).first()
    assert stats.n_images == 2 and stats.mean_r == 0.5
    fails = api.upscale_directory(spark, d, os.path.join(tmp_dir, "up"))
    assert fails.count() == 0
    with pytest.raises(ValueError):
        api.ingest(spark, out_csv, tmp_dir, fetch_ok, type="other")


def test_infer_with_calibrator(spark, tmp_dir):
    from labelforge.operators.calibrate import fit_platt, save_calibrator
    d = os.path.join(tmp_dir, "imgs2")
    os.makedirs(d)
    _png(os.path.join(d, "a.png"), np.full((8, 8, 3), 255, np.uint8))
    _png(os.path.join(d, "b.png"), np.zeros((8, 8, 3), np.uint8))
    # a calibrator that flips the sign of the logit
    rows = [(float(x), int(x < 0)) for x in np.linspace(-5, 5, 101)]
    model = fit_platt(spark.createDataFrame(rows, "logit double, label int"))
    path = os.path.join(tmp_dir, "cal")
    save_calibrator(model, path)
    out_csv = os.path.join(tmp_dir, "pred2", "predictions.csv")
    api.infer(spark, d, out_csv, scorer, img_size=8, use_calibrated=True, calibrator_path=path)
    preds = {r.filename: r.prediction for r in spark.read.option("header", True).csv(out_csv).collect()}
    assert preds == {"a.png": "FALSE", "b.png": "TRUE"}
    # a missing calibrator falls back to the raw sigmoid with a warning
    with pytest.warns(UserWarning):
        api.infer(spark, d, os.path.join(tmp_dir, "pred3", "p.csv"), scorer, img_size=8, use_calibrated=True,
                  calibrator_path=os.path.join(tmp_dir, "nope"))


def test_annotate_saves_pieces_and_retries_errors(spark, tmp_dir):
    inp = _write(os.path.join(tmp_dir, "urls.txt"), "".join(f"http://x/{i}\n" for i in range(200)))
    out = os.path.join(tmp_dir, "ann")

    def fails_on_third(pdf):
        n = pdf["url"].str.rsplit("/", n=1).str[-1].astype(int)
        return pd.DataFrame({"content": [b"/b"] * len(pdf), "error": ["gone" if i % 3 == 0 else None for i in n]})

    s = api.annotate(spark, inp, out, verdicts, fails_on_third, flush_rows=16).first()
    assert (s.total, s.to_do) == (200, 200) and len(_read_dir_lines(out)) == 200
    records = [json.loads(x) for x in _read_dir_lines(out)]
    assert sum(r.get("error") == "gone" for r in records) == 67
    assert all(time.time() - 600 < r["timestamp"] <= time.time() for r in records)
    assert len({r["timestamp"] for r in records}) > 1  # a time for each record, not for the run
    assert api.annotate(spark, inp, out, verdicts, fetch_ok).first().to_do == 0
    assert api.annotate(spark, inp, out, verdicts, fetch_ok, retry_errors=True).first().to_do == 67
    assert api.annotate(spark, inp, out, verdicts, fetch_ok, retry_errors=True).first().to_do == 0
    assert len(_read_dir_lines(out)) == 267


def test_evaluate_reads_numeric_predictions(spark, tmp_dir):
    preds = _write(os.path.join(tmp_dir, "p.csv"), "label,prediction,filename\nx,1,a\nx,0.0,b\nx,1.0,c\n")
    truth = _write(os.path.join(tmp_dir, "t.csv"), "filename,label\na,1\nb,0\nc,0\n")
    r = api.evaluate(spark, preds, truth).first()
    assert (r.total, r.confident_total, r.tp, r.tn, r.fp) == (3, 3, 1, 1, 1)
