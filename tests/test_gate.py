import json

import pytest
from pyspark.sql import functions as F

from labelforge.functions import jsonx
from labelforge.operators import gate

GOOD = '{"department":"儿科","urgency":"中","symptoms":["发热"]}'

OBJECTS = [
    ('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ("[1]", False), ('{"a":1},{"b":2}', False), ('{"a":1}],["b"', False),
    ('{"a":1},"~label-end~"],{"b":1}', False), ("", False), ("  ", False), (None, False), ("null", False), ('"x"', False), ("{}", True), ('{"a":NaN}', False),
    ('{"a":1,}', False), ("{'a':1}", False), ('{"a":"\\u5987"}', True), ('{"a":[1,{"b":null}]}', True), ("{", False), ("]", False), ('{"a":1}]', False),
]


@pytest.mark.parametrize("text,expected", OBJECTS)
def test_strict_object_like_json_loads(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(jsonx.object_map(F.col("t")).isNotNull().alias("ok")).first()["ok"]
    assert bool(got) == expected
    if text and "NaN" not in text:
        try:
            assert isinstance(json.loads(text), dict) == expected
        except ValueError:
            assert not expected


REASONS = [
    (GOOD, "ok"), (None, "not_object"), ("", "not_object"), (GOOD + " 以上", "not_object"), ("[" + GOOD + "]", "not_object"),
    ("```json" + GOOD + "```", "ok"), (GOOD + "<|im_end|>", "ok"), ("　" + GOOD + "\n", "ok"),
    ('{"department":"儿科","urgency":"中"}', "bad_keys"), ('{"department":"儿科","urgency":"中","symptoms":["a"],"note":1}', "bad_keys"),
    ('{"department":5,"urgency":"中","symptoms":["a"]}', "bad_department"), ('{"department":" 儿科","urgency":"中","symptoms":["a"]}', "bad_department"),
    ('{"department":["儿科"],"urgency":"中","symptoms":["a"]}', "bad_department"), ('{"department":"儿科","urgency":"急","symptoms":["a"]}', "bad_urgency"),
    ('{"department":"儿科","urgency":null,"symptoms":["a"]}', "bad_urgency"), ('{"department":"儿科","urgency":"中","symptoms":[]}', "bad_symptoms"),
    ('{"department":"儿科","urgency":"中","symptoms":"a"}', "bad_symptoms"), ('{"department":"儿科","urgency":"中","symptoms":["a",null]}', "bad_symptom_item"),
    ('{"department":"儿科","urgency":"中","symptoms":["a",1]}', "bad_symptom_item"), ('{"department":"儿科","urgency":"中","symptoms":["  "]}', "bad_symptom_item"),
]


def test_reasons(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REASONS)], "id int, output string")
    got = {r["id"]: r["label_reason"] for r in gate.with_label(rows, "output", "label").collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(REASONS)}


def test_modes_differ_on_fences_and_end_tokens(spark):
    rows = spark.createDataFrame([("```" + GOOD + "```",), (GOOD + "</s>",), (GOOD,)], "t string")
    got = [tuple(r) for r in rows.select(*[gate.parsed(F.col("t"), m).isNotNull() for m in ("full", "fences", "strict")]).collect()]
    assert got == [(True, True, False), (True, False, False), (True, True, True)]


def test_compact_keeps_order_and_text(spark):
    row = spark.range(1).select(gate.compact(F.lit("儿科"), F.lit("中"), F.array(F.lit('a"b'), F.lit("发热"))).alias("x")).first()
    assert row["x"] == '{"department":"儿科","urgency":"中","symptoms":["a\\"b","发热"]}'


def test_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([], "output string, label string, v string")
    out = gate.with_label(rows, "output", "label")
    assert out.count() == 0 and {"output", "label", "v", "label_reason"} <= set(out.columns)


def test_very_long_text(spark):
    text = '{"department":"儿科","urgency":"中","symptoms":["' + "热" * 200_000 + '"]}'
    rows = spark.createDataFrame([(text,), (text[:-2],)], "output string")
    assert sorted(r["label_reason"] for r in gate.with_label(rows, "output", "label").collect()) == ["not_object", "ok"]
