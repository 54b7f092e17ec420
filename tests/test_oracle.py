"""The oracle contract inside the suite: a few catalogue queries against
their DuckDB SQL on the sf0.001 tables (full comparison: tools/oracle_check.py)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from labelforge.plans.derived import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["label_fusion", "fusion_stats", "prediction_summary", "parse_verdicts", "select_uncertain",
         "classification_report", "resume_summary", "platt_calibration"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, df.collect()) == _rows(dcols, res.fetchall())
