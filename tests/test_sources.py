import os

import pytest

from labelforge.errors import MissingInputError
from labelforge.operators.joins import pending, resume_summary
from labelforge.sources.annotations import read_annotations, read_processed_urls
from labelforge.sources.tables import read_predictions
from labelforge.sources.text import (
    read_gt_tokens, read_http_lines, read_labelled_urls, read_lines, read_tsv, read_url_list,
)


def _write(path, text, newline="\n"):
    with open(path, "w", newline="") as f:
        f.write(text.replace("\n", newline))
    return path


def test_labelled_urls_fixture(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "m.tsv"),
               "1is_conifer\tdownloadUrl\nTRUE\thttp://x/a.jpg\n\nTRUE http://x/b.jpg\ntrue\thttp://x/c.jpg\n"
               "FALSE\thttp://x/d.jpg\n", newline="\r\n")
    rows, rejects = read_labelled_urls(spark, p)
    got = sorted((r.filename, r.label, r.url) for r in rows.collect())
    assert got == [("000.jpg", 1, "http://x/a.jpg"), ("003.jpg", 0, "http://x/c.jpg"),
                   ("004.jpg", 0, "http://x/d.jpg")]
    assert [r.pos for r in rejects.collect()] == [2]


def test_url_list_fixture(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "u.txt"),
               "url\nhttp://x/a.jpg\nftp://x/b.jpg\n\nhttp://x/c.png\nhttp://x/d.jpg?v=1\n")
    rows, failed = read_url_list(spark, p)
    assert sorted(r.filename for r in rows.collect()) == ["000003.jpg", "000004.jpg", "a.jpg"]
    assert failed.count() == 1
    assert read_lines(spark, p).filter("seq >= 1").count() == 5  # total after the header, blanks included


def test_gt_tokens_fixture(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "g.txt"),
               "is_conifer downloadUrl\nFALSE  http://x/a http://x/b TRUE\nhttp://x/c maybe\n")
    assert [(r.url, r.gt_label) for r in read_gt_tokens(spark, p).collect()] == [("http://x/b", 1)]


def test_http_lines_keep_duplicates(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "h.txt"), "http://a\n\nnot a url\n  http://a  \nftp://x http\n")
    assert [r.url for r in read_http_lines(spark, p).orderBy("seq").collect()] == ["http://a", "http://a",
                                                                                   "ftp://x http"]


def test_line_positions_across_many_splits(spark, tmp_dir):
    lines = [f"line-{i}" for i in range(20000)]
    p = _write(os.path.join(tmp_dir, "big.txt"), "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = read_lines(spark, p)
        assert df.rdd.getNumPartitions() > 5
        got = {r.value: r.seq for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {v: i for i, v in enumerate(lines)}


def test_tsv_drop_last(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "t.tsv"), "a\tb\n1\tx\n2\ty\n3\tz\n")
    assert sorted(r.a for r in read_tsv(spark, p, drop_last=1).collect()) == ["1", "2"]
    assert read_tsv(spark, p).count() == 3


def test_predictions_schema_is_explicit(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "p.csv"), "filename,prediction,probability,logit\na,TRUE,0.9,2.1\n")
    df = read_predictions(spark, p)
    assert dict(df.dtypes)["prediction"] == "string"


def test_missing_input(spark, tmp_dir):
    with pytest.raises(MissingInputError):
        read_lines(spark, os.path.join(tmp_dir, "nope.txt"))


def test_resume_fixture(spark, tmp_dir):
    out = _write(os.path.join(tmp_dir, "out.jsonl"),
                 '{"url": "u1", "prediction": {}}\n{"url": "u3", "error": "boom"}\n{"url": "u2"\n')
    done = read_processed_urls(spark, out)
    urls = spark.createDataFrame([(0, "u1"), (1, "u2"), (2, "u2"), (3, "u3")], "seq long, url string")
    assert [r.url for r in pending(urls, done).orderBy("seq").collect()] == ["u2", "u2"]
    s = resume_summary(urls, done).first()
    assert (s.total, s.processed, s.to_do) == (4, 2, 2)
    assert read_processed_urls(spark, os.path.join(tmp_dir, "absent")).count() == 0


def test_annotations_reader(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "a.jsonl"),
               '{"url": "a", "prediction": {"class_id": 1, "confidence": 0.2}}\n\nnot json\n'
               '{"url": "b"}\n{"url": "c", "prediction": "oops"}\n[1]\n')
    records, rejects = read_annotations(spark, p)
    got = {r.url: (r.class_id, r.confidence, r.is_bad) for r in records.collect()}
    assert got == {"a": (1, 0.2, False), "b": (3, 0.0, False), "c": (3, 0.0, True)}
    assert sorted(r.seq for r in rejects.collect()) == [2, 5]


def test_tsv_drop_last_across_splits(spark, tmp_dir):
    p = os.path.join(tmp_dir, "big.tsv")
    with open(p, "w") as f:
        f.write("a\tb\n" + "".join(f"{i}\tv{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_tsv(spark, p, drop_last=3)
        got = sorted(int(r.a) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(4997))


def test_csv_columns_are_found_by_name(spark, tmp_dir):
    import os

    import pytest

    from labelforge.sources.tables import read_labels

    path = os.path.join(tmp_dir, "labels.csv")
    with open(path, "w") as f:
        f.write("id,label,filename\n7,1,a.jpg\n8,0,b.jpg\n")
    assert [(r.filename, int(float(r.label))) for r in read_labels(spark, path).orderBy("filename").collect()] == [("a.jpg", 1), ("b.jpg", 0)]
    with open(path, "w") as f:
        f.write("name,label\na.jpg,1\n")
    with pytest.raises(ValueError, match="filename"):
        read_labels(spark, path)
