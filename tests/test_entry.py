import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["filename", "final_label"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    rows_only = set(E.queries()) - set(E.oracle_sql()) - set(E.LLM_QUERIES)
    assert rows_only == set()


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPEAT="1",
               BENCH_QUERIES="label_encoding,url_names")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout
    lines = [line for line in out.splitlines() if line.strip()]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert result["unit"] == "sec" and result["sf"] == 0.001
    assert set(result["queries"]) == {"label_encoding", "url_names"}
    assert abs(result["value"] - sum(result["queries"].values())) < 0.01


def test_text_queries_are_left_out_without_their_libraries():
    """The other queries do not depend on libraries that only the text operators need."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    want = sorted(set(E.queries()) - set(E.LLM_QUERIES))
    for name in ("regex", "public_tokenizers", "tokenizers", "labelforge.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as E; print(*sorted(E.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True).stdout
        assert set(out.split()) >= set(want), name
