import json

from pyspark.sql import functions as F

from labelforge.functions.verdict import (
    coerce_class_id, fill_confidence, is_bad, label_text, parse_strict, parse_verdict,
)

FENCED = '```json\n{"class_id":1,"label":"coniferous"}\n```'
CASES = [
    (FENCED, 1, "coniferous", True),
    ('{"class_id":"2"}', 2, None, True),
    ('{"class_id":1.9}', 1, None, True),
    ('{"class_id":"1.9"}', 3, None, True),
    ('{"label":"bad"}', 3, "bad", True),
    ("not json", 3, "bad_parse", False),
    ('{"class_id":1} extra', 3, "bad_parse", False),
    ("[1]", 3, "bad_parse", False),
    ('{"class_id": NaN}', 3, None, True),
    ('{"class_id": 1, "label": "\\ud83d"}', 1, "\ufffd" * 3, True),
    ('{"class_id": "99999999999"}', None, None, True),
    ('{"class_id": 99999999999}', None, None, True),
    ('{"class_id": true}', 1, None, True),
    ('{"class_id": -2.7}', -2, None, True),
    ('{"class_id": " 2 "}', 2, None, True),
    ('{"class_id": null}', 3, None, True),
    ('{"class_id": [1]}', 3, None, True),
    ('{"class_id": 1, "class_id": 2}', 2, None, True),
]


def test_parse_verdict_fixture(spark):
    df = spark.createDataFrame([(t,) for t, *_ in CASES], "t string")
    v = parse_verdict("t")
    rows = df.select(v["parsed"].alias("ok"), coerce_class_id(v["prediction"]).alias("c"),
                     label_text(v["prediction"]).alias("l"),
                     F.try_variant_get(v["prediction"], "$.raw_text", "string").alias("raw")).collect()
    for (text, cls, label, ok), r in zip(CASES, rows):
        assert (r.ok, r.c, r.l) == (ok, cls, label), text
        if not ok:
            assert r.raw == text  # the uncleaned text is kept


def test_is_bad_fixture(spark):
    preds = [
        {"class_id": 3},
        {"class_id": 3.0},
        {"class_id": "3", "label": "deciduous"},
        {"class_id": 1, "label": "BAD_parse"},
        {"class_id": 1, "label": "coniferous"},
        {"class_id": True},
        {},
    ]
    df = spark.createDataFrame([(json.dumps(p),) for p in preds], "t string")
    got = [r[0] for r in df.select(is_bad(parse_strict("t"))).collect()]
    assert got == [True, True, False, True, False, False, False]


def test_fill_confidence(spark):
    preds = ['{"confidence": 0.4}', "{}", '{"confidence": null}', '{"confidence": "x"}', '{"confidence": "0.5"}']
    df = spark.createDataFrame([(p,) for p in preds], "t string")
    got = [r[0] for r in df.select(fill_confidence(parse_strict("t"))).collect()]
    assert got == [0.4, 0.0, 0.0, 0.0, 0.5]


def test_strict_guard_matches_python(spark):
    texts = ['{"a": 1}', '{"a": 1} x', " {\"a\": 1}\n", "[]", "5", '{"a": Infinity}', '{"a": "é"}', "", "{"]

    def py(t):
        try:
            v = json.loads(t)
        except ValueError:
            return False
        return isinstance(v, dict)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_strict("t").isNotNull()).collect()]
    assert got == [py(t) for t in texts]
