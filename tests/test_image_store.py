import json
import os

import pandas as pd
import pytest
from test_images import _png

from labelforge import api
from labelforge.operators.images import count_files, list_images, load_images
from labelforge.operators.ingest import fetch_plan
from labelforge.operators.joins import attach_images
from labelforge.sinks import image_store
from labelforge.sources.files import list_files, with_content


def rows(spark, pairs, parts=3):
    return spark.createDataFrame([(n, c.encode()) for n, c in pairs], "filename string, content binary").repartition(parts)


def content(spark, store):
    got = [(r["filename"], bytes(r["content"]).decode()) for r in image_store.read_store(spark, store).collect()]
    assert len(got) == len({n for n, _ in got})
    return dict(got)


def test_replacing_leaves_one_row_a_name(spark, tmp_path):
    store = str(tmp_path / "store")
    image_store.replace(rows(spark, [(f"{i}.jpg", f"old {i}") for i in range(500)]), store)
    for version in ("new", "newer"):
        image_store.replace(rows(spark, [(f"{i}.jpg", f"{version} {i}") for i in range(0, 700, 7)]), store)
        assert content(spark, store) == {f"{i}.jpg": f"{version} {i}" if i % 7 == 0 else f"old {i}" for i in range(700) if i < 500 or i % 7 == 0}
    image_store.replace(rows(spark, [("new.jpg", "x")]), store)  # nothing to take out
    image_store.replace(rows(spark, [(f"{i}.jpg", "all") for i in range(700)]), store)  # whole files go
    assert set(content(spark, store).values()) == {"all", "x"}
    image_store.replace(rows(spark, []), store)
    assert len(content(spark, store)) == 701


def test_a_swap_is_finished_after_the_driver_died(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    image_store.append(rows(spark, [("a", "1"), ("b", "1")]), store)
    with monkeypatch.context() as m:
        m.setattr(image_store, "_swap", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            image_store.replace(rows(spark, [("b", "2"), ("c", "2")]), store)
    assert {r["filename"]: bytes(r["content"]) for r in spark.read.parquet(store).collect()} == {"a": b"1", "b": b"1"}  # not begun: the old state
    assert content(spark, store) == {"a": "1", "b": "2", "c": "2"}
    assert os.listdir(os.path.join(store, "_swaps")) == [] and os.listdir(os.path.join(store, "_staged")) == []
    # a note whose files are in place already changes nothing
    (tmp_path / "store" / "_swaps" / "again.json").write_text(json.dumps({"job": "none", "out": [os.path.join(store, "gone.parquet")]}))
    assert content(spark, store) == {"a": "1", "b": "2", "c": "2"}


def fetcher(word, bad):
    def run(pdf):
        return pd.DataFrame({"content": [f"{word} {u}".encode() for u in pdf["url"]], "error": ["gone" if bad in u else None for u in pdf["url"]]})

    return run


def test_ingest_with_overwrite_replaces_what_it_fetched(spark, tmp_path):
    urls = tmp_path / "urls.txt"
    urls.write_text("\n".join(["header", *[f"http://x/{i}.jpg" for i in range(50)], "http://y/3.jpg"]))
    store = str(tmp_path / "store")
    first = api.ingest(spark, str(urls), store, fetcher("one", "/1.jpg"), type="no_markup").first()
    assert (first["downloaded"], first["failed"]) == (49, 1)
    again = api.ingest(spark, str(urls), store, fetcher("two", "/2.jpg"), type="no_markup", overwrite=True).first()
    assert (again["downloaded"], again["failed"]) == (49, 1)
    want = {f"{i}.jpg": f"{'one' if i == 2 else 'two'} http://x/{i}.jpg" for i in range(50)}
    assert content(spark, store) == want


def exchanges_with_binary(df):
    """Exchange nodes of the executed plan whose output has a binary column."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    tree = df._jdf.queryExecution().executedPlan()
    found = []

    def visit(node):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            visit(node.executedPlan())
            return
        if "QueryStage" in name:
            visit(node.plan())
            return
        if "Exchange" in name and "binary" in node.schema().simpleString():
            found.append(name)
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(tree)
    assert "Exchange" in plan or not found
    return found


def test_no_exchange_carries_contents(spark, tmp_path):
    plan = spark.createDataFrame([(i, f"{i % 40}.jpg", f"http://x/{i}", "fetch") for i in range(400)], "pos long, filename string, url string, status string")
    fetched = fetch_plan(plan, fetcher("c", "/3"))
    assert exchanges_with_binary(fetched) == []
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(30):
        (folder / f"{i}.png").write_bytes(b"x" * i)
    labels = spark.createDataFrame([(f"{i}.png", 1) for i in range(35)], "filename string, label int").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = with_content(attach_images(labels, list_images(spark, str(folder)).select("path")))
        assert exchanges_with_binary(found) == []
        got = {r["filename"]: (None if r["content"] is None else len(r["content"]), r["error"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"{i}.png": (i, None) if i < 30 else (None, f"image not found: {i}.png") for i in range(35)}


def test_names_of_all_kinds_are_listed_loaded_and_counted(spark, tmp_path):
    folder = tmp_path / "imgs"
    (folder / "_below" / ".deep").mkdir(parents=True)
    colour = [[[10, 20, 30], [40, 50, 60]]]
    for name in ("a.png", "_x.png", ".y.png", "_below/z.png", "_below/.deep/q.png"):
        _png(str(folder / name), colour)
    (folder / "_broken.jpg").write_bytes(b"no")
    (folder / "_notes.txt").write_text("x")
    assert sorted(r["filename"] for r in list_images(spark, str(folder)).collect()) == [".y.png", "_broken.jpg", "_x.png", "a.png"]
    assert count_files(spark, str(folder)) == 5
    assert sorted(r["filename"] for r in list_files(spark, "file://" + str(folder), recursive=True).collect()) == [
        ".y.png", "_broken.jpg", "_notes.txt", "_x.png", "a.png", "q.png", "z.png"]
    got = {r["filename"]: r for r in load_images(spark, str(folder)).collect()}
    assert set(got) == {"a.png", "_x.png", ".y.png", "_broken.jpg"} and got["_broken.jpg"]["error"]
    for name in ("a.png", "_x.png", ".y.png"):
        assert bytes(got[name]["data"]) == bytes([10, 20, 30, 40, 50, 60]) and got[name]["path"].endswith(f"imgs/{name}")


def test_contents_that_cannot_be_read(spark, tmp_path):
    df = spark.createDataFrame([("file:" + str(tmp_path / "none"), None), (None, "before")], "path string, error string")
    got = [(r["content"], r["error"]) for r in with_content(df).collect()]
    assert got == [(None, "read: FileNotFoundError"), (None, "before")]


def test_many_small_images_are_few_tasks(spark, tmp_path):
    from labelforge.operators.images import decoded_images

    for i in range(300):
        (tmp_path / f"p{i}.png").write_bytes(b"no")
    for i in range(40):
        (tmp_path / f"_p{i}.png").write_bytes(b"no")
    found = decoded_images(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r["filename"] for r in found.collect()) == sorted([f"p{i}.png" for i in range(300)] + [f"_p{i}.png" for i in range(40)])
