import pytest
from pyspark.sql import functions as F

from labelforge.operators import metrics, pairs, records, reward, semantic, validate


def label(d="儿科", u="中", s='["a"]'):
    return f'{{"department":"{d}","urgency":"{u}","symptoms":{s}}}'


PRED = "pred_id long, run_name string, idx long, input string, gold string, response string"


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        (1, "a", 0, "q0", label(u="高"), label(u="高")), (2, "a", 1, "q1", label(u="高"), label(u="低")), (3, "a", 2, "q2", label(), "x"), (4, "a", 3, "q3", "{}", label()), (5, "a", 3, "q3", label(), None),
        (6, "b", 0, "q0", label(u="高"), label("骨科", "高")), (7, "b", 1, "q1", label(u="高"), label(u="高")), (8, "b", 2, "q2", label(), label()), (9, "b", 2, "q2", label(), "retry"),
    ]
    return metrics.scored(spark.createDataFrame(rows, PRED)).cache()


def by_position(scored):
    return metrics.positioned(scored.select("pred_id", "run_name", "idx", "input", "gold", "response"))


def test_summary(scored):
    a = metrics.summary(scored, ["run_name"]).where("run_name = 'a'").first()
    assert (a["num_evaluated"], a["high_urgency_total"], a["high_to_low"], a["high_to_bad"]) == (4, 2, 1, 0)
    assert a["json_parse_rate"] == 0.5 and a["department_accuracy"] == 1.0 and a["urgency_accuracy"] == 0.5 and a["e2e_accuracy"] == 0.25
    assert a["urgency_macro_f1"] == pytest.approx((2 / 3) / 3, abs=1e-6) and a["hard_jaccard"] == 1.0


def test_counters(scored):
    got = {r["counter"]: r["n"] for r in metrics.counters(scored).collect()}
    assert got["skip_bad_gold:bad_keys"] == 1 and got["evaluated"] == 8 and got["schema_error:not_object"] == 3


def test_comparison_counts_each_position_once(scored):
    row = metrics.comparison(metrics.paired(by_position(scored), "a", "b")).first()
    assert (row["num_compared"], row["improved"], row["regressed"], row["net_e2e"]) == (3, 2, 1, 1)
    assert row["both_correct"] + row["both_wrong"] + row["improved"] + row["regressed"] == row["num_compared"]
    assert [r["idx"] for r in metrics.examples(metrics.paired(by_position(scored), "a", "b"), "regressed").collect()] == [0]


def test_comparison_counts_rows_without_a_valid_gold(spark):
    """Such rows are compared and wrong; a gold object counts by its own values, and a missing input differs from a text."""
    odd = '{"department":"儿科","urgency":"高","symptoms":[]}'
    rows = [(1, "a", 0, "q", "x", label()), (2, "b", 0, "q", "x", label()), (3, "a", 1, "q", odd, label(u="高")), (4, "b", 1, None, odd, label(u="低")), (5, "a", 2, "q", label(), label())]
    row = metrics.comparison(metrics.paired(metrics.positioned(spark.createDataFrame(rows, PRED)), "a", "b")).first()
    assert (row["num_compared"], row["both_wrong"], row["regressed"], row["input_mismatch"], row["high_total"], row["high_to_low_b"]) == (2, 1, 1, 1, 1, 1)


def test_validation_report_counts_repeats_and_labels(spark):
    rows = [(1, "s", "i", "q", label()), (2, "s", "i", "q", label("骨科", "高")), (3, "s", "i", " ", label()), (4, "s", None, "r", "x"), (5, "t", "i", "q", label()), (6, None, "i", "q", label())]
    frame = spark.createDataFrame(rows, "row_id long, split_name string, instruction string, input string, output string")
    got = {r["split_name"]: tuple(r)[1:] for r in validate.report(frame).collect()}
    assert got["s"] == (4, 4, 1, False, "儿科:2,骨科:1", "中:2,高:1")
    assert got["t"] == got[None] == (1, 0, 0, True, "儿科:1", "中:1")
    assert validate.report(frame.limit(0)).count() == 0
    seen = [(r["place"], r["row_id"], r["error"]) for r in validate.report_preview(frame).orderBy("place").collect()]
    assert seen == [(1, 3, "bad_input"), (2, 4, "bad_instruction"), (3, 4, "not_object"), (4, None, "duplicate_input")]


def test_confusion_with_values_that_are_no_labels(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", None), ("z", "a"), ("a", "b")], "g string, p string")
    cells = {(r["gold"], r["pred"]): r["n"] for r in metrics.confusion(rows, "g", "p", ["a", "b"], seen=True).collect()}
    assert cells == {("a", "a"): 0, ("a", "b"): 2, ("b", "a"): 0, ("b", "b"): 0, ("a", metrics.BAD): 1, ("z", "a"): 1}


def test_confusion_has_empty_cells(scored):
    cells = metrics.confusion(scored.where("gold_reason = 'ok'"), "gold_urgency", "pred_label", ["高", "中", "低", metrics.BAD]).collect()
    assert len(cells) == 16 and sum(r["n"] for r in cells) == 8


def test_report_of_nothing(spark):
    out = metrics.scored(spark.createDataFrame([], PRED))
    assert metrics.summary(out, ["run_name"]).count() == 0 and metrics.counters(out).count() == 0
    assert metrics.comparison(metrics.paired(by_position(out), "a", "b")).first()["num_compared"] == 0
    rows = {r["label"]: r["precision"] for r in metrics.classification_report(out, "gold_urgency", "pred_urgency", ["高"]).collect()}
    assert rows["accuracy"] == 0.0


REWARDS = [
    (label(), label(), 1.0), ("{}", label(), 0.0), (label(), "x", -1.0), (label(), None, -1.0), (label(), '{"department":"儿科"}', -0.5), (label(), label("未知科"), -0.5),
    (label(u="高"), label(u="低"), 0.0), (label(), "```" + label() + "```", 0.94), (label(), label(s='["a","a"]'), 0.95), (label(u="高"), label(u="中"), 0.66),
]


def test_rewards(spark):
    rows = spark.createDataFrame([(i, g, r) for i, (g, r, _) in enumerate(REWARDS)], "i int, gold string, response string")
    got = [r["reward"] for r in reward.score(rows).orderBy("i").collect()]
    assert got == [pytest.approx(x, abs=1e-9) for *_, x in REWARDS]
    assert all(-1 <= x <= 1 for x in got)


def test_synthetic_pairs_differ_in_one_field(spark):
    rows = spark.range(400).select(F.col("id").alias("row_id"), F.lit(None).cast("string").alias("instruction"), F.lit("q").alias("input"), F.when(F.col("id") % 2 == 0, label(s='["a","b"]')).otherwise(label(u="低")).alias("output"))
    made = pairs.synthetic(rows).select(F.col("row_id").alias("pair_id"), "_source", "conversations", "chosen", "rejected")
    diffs = {r["diff"]: r["count"] for r in validate.pair_diffs(made).groupBy("diff").count().collect()}
    assert set(diffs) == {"department", "urgency", "symptoms", "no_diff"} and sum(diffs.values()) == 400
    assert 110 < diffs["department"] < 210 and 70 < diffs["urgency"] < 170
    assert pairs.synthetic(rows, most=50).count() == 50


def test_pairs_from_predictions_and_union(spark):
    rows = spark.createDataFrame([(1, "a", 0, "q", label(), label()), (2, "a", 1, "r", label(), label("骨科")), (3, "a", 2, "s", label(), "x"), (4, "a", 3, "t", "bad", "x"), (5, "a", 4, "u", label(), None), (6, "a", 5, "r", label(), "y")], PRED)
    made = pairs.from_predictions(rows)
    assert {r["pred_id"]: r["rejected"]["value"] for r in made.collect()} == {2: label("骨科"), 3: "x", 6: "y"}
    both = pairs.union_first([made, made], ["pred_id", "pred_id"])
    assert sorted((r["source_no"], r["source_id"]) for r in both.collect()) == [(0, 2), (0, 3)]
    assert pairs.without_internal(made).columns == ["pred_id", "conversations", "chosen", "rejected"]


def test_hard_pairs(spark):
    turn = "struct<`from`:string,value:string>"
    rows = [(1, label(), label("骨科")), (2, label(), label(u="高")), (3, label(), label("骨科", "高")), (4, label(), label(s='["b"]')), (5, label(), "x"), (6, label(), None), (7, None, label())]
    df = spark.createDataFrame([(i, [("system", "s"), ("user", "q")], ("assistant", c), ("assistant", r), None) for i, c, r in rows], f"pair_id long, conversations array<{turn}>, chosen {turn}, rejected {turn}, _source string")
    got = {r["pair_id"]: (r["filter_reason"], r["keep"]) for r in validate.hard_pairs(validate.pair_diffs(df)).collect()}
    assert got == {1: ("dept", True), 2: ("urgency", True), 3: ("dept+urgency", True), 4: ("symptom_only", False), 5: ("parse_error", False), 6: ("parse_error", False), 7: ("parse_error", False)}


def test_row_errors(spark):
    rows = spark.createDataFrame([(1, "i", "q", label()), (2, None, " ", "```" + label() + "```"), (3, "i", "q", '{"department":"x","urgency":"y","symptoms":[]}'), (4, "i", "q", None)], "row_id long, instruction string, input string, output string")
    get = lambda every: {(r["row_id"], r["error"]) for r in validate.row_errors(rows, every=every).collect()}
    assert get(False) == {(2, "bad_instruction"), (2, "bad_input"), (2, "markdown_fence_in_output"), (3, "bad_department"), (4, "bad_output_text")}
    assert {(3, "bad_department"), (3, "bad_urgency"), (3, "bad_symptoms"), (2, "output_not_object")} <= get(True)


def test_records(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, "i", "q", "o")], "row_id long, instruction string, input string, output string")
    assert [tuple(r) for r in records.prompt_records(rows).orderBy("row_id").collect()] == [(1, "\n", "", ""), (2, "i\nq", "o", "q")]
    messages = records.chat_messages(rows, strong=True).orderBy("row_id").collect()[1]["messages"]
    assert messages[1]["content"] == "q" and messages[0]["content"] != "i"
    answered = records.with_answers(records.prompt_records(rows), lambda texts: texts.str.len().astype(str)).orderBy("row_id").collect()
    assert [r["response"] for r in answered] == ["1", "3"]


def test_soft_jaccard(spark):
    schema = "set_id long, item_id long, vec array<float>"
    gold = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 0.0])], schema)
    pred = spark.createDataFrame([(1, 9, [1.0, 0.1]), (1, 8, [0.9, 0.0]), (1, 7, [0.0, 0.0]), (3, 6, [1.0, 0.0])], schema)
    got = {r["set_id"]: (r["hits"], r["soft_jaccard"]) for r in semantic.soft_jaccard(gold, pred).collect()}
    assert got == {1: (1, 0.25), 2: (0, 0.0), 3: (0, 0.0)}
