import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelforge.functions.symptoms import jaccard, jaccard_strict, schema_symptoms, with_worded_scores, wording, worded


def greedy(gold, pred):
    gold, pred = list(dict.fromkeys(gold)), list(dict.fromkeys(pred))
    if not gold and not pred:
        return 1.0, 1.0
    used, hits = set(), 0
    for x in pred:
        for i, y in enumerate(gold):
            if i not in used and (x == y or (len(x) > 1 and len(y) > 1 and (x in y or y in x))):
                used.add(i)
                hits += 1
                break
    if not hits:
        return 0.0, 0.0
    p, r = hits / len(pred), hits / len(gold)
    return 2 * p * r / (p + r), hits / (len(gold) + len(pred) - hits)


def scores(spark, pairs):
    rows = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(pairs)], "i int, g array<string>, p array<string>")
    return [(r["worded_f1"], r["worded_jaccard"]) for r in with_worded_scores(rows, "g", "p").orderBy("i").collect()]


CASES = [
    (["上腹痛x", "腹痛"], ["腹痛", "痛", "上腹痛x"], 0.8, 2 / 3), (["腹痛", "头痛"], ["腹", "头痛"], 0.5, 1 / 3), ([], [], 1.0, 1.0), (["a"], [], 0.0, 0.0),
    (["痛经", "经痛"], ["痛经痛", "痛经"], 0.5, 1 / 3), (["痛经", "经痛"], ["痛经", "痛经痛"], 1.0, 1.0),
]


@pytest.mark.parametrize("g,p,f1,j", CASES)
def test_greedy_cases(spark, g, p, f1, j):
    (got,) = scores(spark, [(g, p)])
    assert got == pytest.approx((f1, j))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.text("腹头痛热", min_size=1, max_size=4), max_size=5)] * 2), min_size=20, max_size=40))
def test_greedy_like_brute_force(spark, pairs):
    assert scores(spark, pairs) == [pytest.approx(greedy(g, p)) for g, p in pairs]


def test_jaccard(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], None), ([], None), ([" a ", "a", " "], ["a"])], "g array<string>, p array<string>")
    got = [tuple(r) for r in rows.select(jaccard(F.col("g"), F.col("p")), jaccard_strict(F.col("g"), F.col("p"))).collect()]
    assert got == [(pytest.approx(1 / 3), pytest.approx(1 / 3)), (1.0, 1.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]


def test_wording_and_lists(spark):
    row = spark.range(1).select(wording(F.lit(" 头 疼。")).alias("w"), worded(F.array(F.lit("发烧"), F.lit(" "), F.lit("发烧"))).alias("l"), worded(F.lit(None).cast("array<string>")).alias("n")).first()
    assert row["w"] == "头痛" and row["l"] == ["发热", "发热"] and row["n"] == []


def test_schema_symptoms(spark):
    rows = spark.createDataFrame([('[" a ","b","a"]',), ('["a",1]',), ('[" "]',), ("[]",), ('["a",null]',)], "t string").select(F.try_variant_get(F.parse_json("t"), "$", "array<variant>").alias("v"))
    assert [r[0] for r in rows.select(schema_symptoms(F.col("v"))).collect()] == [["a", "b"], None, None, None, None]
