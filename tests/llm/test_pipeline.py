import public_tokenizers as P
from edge import by_key, documents, prose, texts
from test_dedup import groups
from test_filters import base_counts, contaminated, templates

import __spark_entry__ as E
import corpus_pipeline
from labelforge.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones_and_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_against_brute_force(spark):
    """Every stage on its predecessor's rows, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    passed = stages["quality_rules"](spark, docs, SF).cache()
    assert not any(base_counts(t)["base_failed"] for _, t in rows(passed))
    deduped = stages["line_dedup"](spark, passed, SF).cache()
    gone = templates(rows(passed), 10)
    cut = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, t, n) not in gone)) for i, t in rows(passed)]
    assert sorted(rows(deduped)) == sorted((i, t) for i, t in cut if t.strip(" \t\n\r\x0b\x0c"))
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.collect())
    alone = stages["jaccard_join"](spark, deduped, SF).cache()
    assert sorted(i for i, _ in rows(alone)) == sorted(g["doc_id"] for g in groups(rows(deduped), 5, 80) if g["doc_id"] == g["component_id"])
    clean = stages["decontaminate"](spark, alone, SF).cache()
    assert sorted(i for i, _ in rows(clean)) == sorted(r["doc_id"] for r in contaminated(rows(alone), items, 10) if not r["n_hit"])
    bpe = byte_bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"))
    want = {i: bpe.encode([t])[0].tolist() for i, t in rows(clean)}
    assert {r["doc_id"]: r["ids"] for r in stages["byte_bpe"](spark, clean, SF).collect()} == want
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_awkward_documents_pass_through(spark):
    """Nulls, empty and long texts, repeated rows and columns of any name, which
    stay as they are."""
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in texts() if i is not None]
    names = ("distance", "n_lines", "n_dropped", "base_failed", "line", "drop", "component_id", "n_hit", "leaf", "text_sha256")
    docs = documents(spark, rows).withColumns({c: F.lit("own") for c in names})
    own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).collect() == []
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert all(r[c] == "own" for r in out.collect() for c in own), name
        assert 0 < out.count() <= len(rows)


def test_one_row_stays_of_repeated_ones(spark):
    import random

    text = prose(random.Random(1), 60)
    docs = documents(spark, [(1, text), (1, text), (2, text), (3, None), (None, "x y"), (1, "other words")], extra=False)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert by_key(kept, "doc_id", "text") == by_key([{"doc_id": i, "text": t} for i, t in [(1, text), (3, None), (None, "x y"), (1, "other words")]], "doc_id", "text")


def test_every_operator_has_one_query():
    names = [q for q in E.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_texts_that_stay_are_not_shuffled(spark):
    import corpus_pipeline

    same = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, same), (2, same), (3, "a b c d e f g"), (None, "h i j k l m n"), (4, None), (5, same)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, "")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" not in plan and "LeftAnti" in plan
        assert {r["doc_id"] for r in out.collect()} == {1, 3, 4, None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
