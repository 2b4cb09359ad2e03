import json

import pytest

from labelforge.llm import p3_defects, p5_cutoff

LABEL = '{"department":"儿科","urgency":"中","symptoms":["发热","头痛"]}'
PROMPT = "爱人34岁，体型偏瘦，立秋那阵下班路上突然出现右下肺又红又烫，同时恶心想吐，走几步就累。想知道算工伤情况吗？"

WHOLE = [None, "", " \n", LABEL, LABEL + "<|im_end|>", "```json\n" + LABEL + "\n```", LABEL + "\n如果加重，请立即联系急救。", "{}", "null", "（轻）好。", LABEL + " "]
CUT = [LABEL[:-1], LABEL[:-3], LABEL[:20], '{"a":"\\u65', "```json\n" + LABEL, LABEL + "\n如果加重，", "好的，结果如下：", "abc�", "他说“头痛", LABEL + "<|im_e", "{'a': 'b"]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert p5_cutoff.scan(text)[0] == p5_cutoff.WHOLE


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert p5_cutoff.scan(text)[0] == p5_cutoff.CUT


def test_every_prefix_of_an_object_is_cut():
    text = json.dumps({"a": ["x\"y", {"b": "\\"}], "c": "热"})
    assert all(p5_cutoff.scan(text[:k])[0] == p5_cutoff.CUT for k in range(1, len(text)))


def answers(spark, rows):
    return spark.createDataFrame(rows, "key long, source string, prompt string, response string")


def test_contexts_decide_unterminated_prose(spark):
    rows = [(i, "s", PROMPT, LABEL + "\n患者提到恶心想吐，走几步就累，因此不建议拖延。") for i in range(5)]
    rows += [(10, "s", PROMPT, LABEL + "\n患者提到恶心想吐，走几步就累，因此不建议拖延"), (11, "s", PROMPT, LABEL + "\n患者提到恶心想吐，走几步就累"), (12, None, None, LABEL + "\n患者提到恶心想吐，走几步就累，因此不"), (13, "s", PROMPT, PROMPT[:-1]), (14, "s", None, None)]
    rows += [(15, "s", None, "科室：儿科；症状：头痛、发热"), (16, "s", None, "科室：儿科；症状：头痛、发"), (17, "s", None, "科室：儿科；紧急程度：中")]
    labels = spark.createDataFrame([(LABEL,), (None,), ("x",)], "label string")
    got = {r["key"] for r in p5_cutoff.cut_keys(answers(spark, rows), labels).collect()}
    assert got == {11, 12, 16, 17}


@pytest.mark.parametrize("symptoms", ['[""]', '["  "]', '"头痛 心"', "5", "true", "null", '{"头": 1}'])
def test_odd_symptoms_excuse_no_cut(spark, symptoms):
    rows = [(1, "s", None, LABEL + "\n患者提到恶"), (2, "s", None, "科室：儿科；症状：发热、头"), (3, "s", None, "科室：儿科；症状：发热、头痛"), (4, "s", None, "症状：发热、 、头痛。")]
    labels = spark.createDataFrame([('{"symptoms":' + symptoms + "}",), (LABEL,)], "label string")
    assert {r["key"] for r in p5_cutoff.cut_keys(answers(spark, rows), labels).collect()} == {1, 2}


def test_habit_of_a_source(spark):
    rows = [(i, "s", None, LABEL + " 完毕") for i in range(6)] + [(9, "s", None, LABEL + "\n完")]
    got = {r["key"] for r in p5_cutoff.cut_keys(answers(spark, rows), spark.createDataFrame([], "label string")).collect()}
    assert got == {9}
    assert p5_cutoff.cut_keys(answers(spark, []), spark.createDataFrame([], "label string")).count() == 0


def test_habits_and_rates_are_those_of_the_source(spark):
    """A cut of source b is reported though source a ends so by habit, and though one text of many closes so."""
    rows = [(i, "a", None, LABEL + "\n患者提到恶") for i in range(6)] + [(100, "b", None, LABEL + "\n患者提到恶"), (101, None, None, LABEL + "\n患者提到恶")]
    empty = spark.createDataFrame([], "label string")
    assert {r["key"] for r in p5_cutoff.cut_keys(answers(spark, rows), empty).collect()} == {100, 101}
    rows = [(i, f"s{i}", None, LABEL + "\n说明病情仍在变化，需要密") for i in range(9)] + [(50, "z", None, LABEL + "\n说明病情仍在变化，需要密。"), (51, "z", None, LABEL + "\n结合症状考虑皮肤科。"), (52, "y", None, LABEL + "\n结合症状考虑皮肤科")]
    assert {r["key"] for r in p5_cutoff.cut_keys(answers(spark, rows), empty).collect()} == set(range(9))


def test_a_field_limit_is_no_habit(spark):
    """Templated answers of a source that end at its greatest length."""
    body, other = "科室：儿科；紧急程度：中；症状：发热。以上判断仅供参", "科室：儿科；紧急程度：中；症状：发热。如果加重请立即"
    rows = [(i, "limited", None, (body, other)[i % 2]) for i in range(20)] + [(30 + i, "limited", None, "科室：儿科；症状：发热。") for i in range(5)]
    rows += [(100 + i, "free", None, body) for i in range(20)] + [(200, "free", None, body + "考，请尽快就诊。")]
    got = {r["key"] for r in p5_cutoff.cut_keys(answers(spark, rows), spark.createDataFrame([], "label string")).collect()}
    assert got == set(range(20))


DEFECTS = [
    (None, "empty"), ("", "empty"), ("​", "empty"), ("```json\n```", "empty"), ("{}", "empty"), ('{"department":"","urgency":"","symptoms":[]}', "empty"), ("<|im_end|>", "empty"), ("null", "empty"),
    (PROMPT, "copy"), ("您说的是：" + PROMPT, "copy"), (PROMPT + "\n" + PROMPT, "copy"), (PROMPT.replace("，", ","), "copy"), (json.dumps({"department": "", "symptoms": [PROMPT]}), "copy"),
    ("抱歉，我无法根据这段描述给出分诊结果。", "refusal"), ('{"error":"这个忙我帮不上"}', "refusal"), ("关于您提到的“右下肺又红又烫”，按规定不予处理该请求", "refusal"),
    ("Please go to the eye clinic desk first.", "foreign"), ('{"department":"Respiratory","urgency":"medium","symptoms":["dry cough"]}', "foreign"), ("ゆっくり休んで、また来るように伝えました。", "foreign"), ("밤에 전화하세요", "foreign"),
    (LABEL, ""), ("很抱歉听到您身体不适，判断如下：" + LABEL, ""), ("虽然无法当面检查，仍可先分诊：" + LABEL, ""), (LABEL.replace("发热", "ENT 术后出血"), ""), ('{"department":"儿科"}', ""),
    ("科室：儿科；紧急程度：中；症状：抱歉感过强。", ""), (LABEL + "\n患者提到同时恶心想吐，走几步就累，说明病情仍在变化。", ""), (LABEL.replace("头痛", "服 Sérolan 后皮疹"), ""),
]


@pytest.mark.parametrize("text,defect", DEFECTS)
def test_defects(text, defect):
    assert p3_defects.defect_of(text, PROMPT) == defect


@pytest.mark.parametrize("label,defect", [
    (("无法判断", "无法判断", ["无法判断"]), "refusal"), (("不予分诊", "不予分诊", []), "refusal"), (("略过", "略过", []), "silent"), (("心内科", "紧急", ["胸痛"]), ""), (("无法判断科别", "高", ["胸痛"]), ""),
    (("Cardiology", "High", ["Chest Pain", "Fever"]), "foreign"), (("CARDIOLOGY", "HIGH", ["FEVER"]), "foreign"), (("Lungenheilkunde", "中", ["Halsschmerzen", "Schwindel"]), "foreign"), (("Lungenheilkunde", "Mittel", ["Halsschmerzen"]), "foreign"),
    (("ENT", "中", ["MRI", "CT"]), ""), (("儿科", "中", ["Paracetamol Ibuprofen 过敏"]), ""),
])
def test_capitals_do_not_hide_another_language(label, defect):
    assert p3_defects.defect_of(json.dumps(dict(zip(("department", "urgency", "symptoms"), label, strict=True)), ensure_ascii=False), PROMPT) == defect


def test_null_prompt_is_no_copy():
    assert p3_defects.defect_of(PROMPT, None) == "silent"


def test_one_defect_per_record(spark):
    rows = [("predictions", i, "s", PROMPT, t) for i, (t, _) in enumerate(DEFECTS)] + [("dpo_train_2", 500, None, PROMPT, LABEL[:-4])]
    frame = spark.createDataFrame(rows, "table_name string, record_id long, source string, prompt string, response string")
    got = p3_defects.defective(frame, spark.createDataFrame([(LABEL,)], "label string")).collect()
    assert len({(r["table_name"], r["record_id"]) for r in got}) == len(got)
    named = {(r["table_name"], r["record_id"]): r["defect"] for r in got}
    want = {("predictions", i): "other_language" if d == "foreign" else d for i, (_, d) in enumerate(DEFECTS) if d} | {("dpo_train_2", 500): "truncated"}
    assert {k: v for k, v in named.items() if k in want} == want and set(named) == set(want)


@pytest.mark.parametrize("text,defect", [("抱歉，这不在我的职责之内。", "silent"), ("这类问题我选择沉默。", "silent"), (PROMPT[:22] + "。请问要去哪个科？", "silent"), (PROMPT[: int(len(PROMPT) * 0.7)], "copy")])
def test_answers_without_a_label_in_any_wording(text, defect):
    assert p3_defects.defect_of(text, PROMPT) == defect


def test_refusals_by_dictionary():
    """Wordings that the dictionary has not seen as a whole."""
    seen = [f"{a}，{b}，{c}。" for a in ("抱歉", "很遗憾", "不好意思") for b in ("恕我难以就此作答", "按规定不予处理该请求", "我没有资格选择科室") for c in ("望理解", "请咨询线下医生", "建议您换个问题")]
    tells = p3_defects.Refusals(seen, [PROMPT, "患者提到同时恶心想吐，走几步就累，说明病情仍在变化，需要密切留意。", "目前无法排除多汗加重的可能，因此不建议拖延。"])
    assert tells("您好，按规定就此不予处理，望理解，建议您换个问题。") and tells("很抱歉，我没有资格就此作答，请咨询线下医生。")
    assert not tells("患者提到走几步就累，因此不建议拖延，需要密切留意。") and not tells("舅舅51岁，立秋那阵下班路上突然出现，同时恶心想吐。")
    assert not p3_defects.Refusals([], [])("抱歉。")


def test_silent_answers_are_refusals_unless_cut(spark):
    rows = [("predictions", 1, "s", PROMPT, "这类问题我选择沉默。"), ("predictions", 2, "s", PROMPT, "这类问题我选"), ("predictions", 3, None, None, LABEL)]
    frame = spark.createDataFrame(rows, "table_name string, record_id long, source string, prompt string, response string")
    got = {r["record_id"]: r["defect"] for r in p3_defects.defective(frame, spark.createDataFrame([(LABEL,)], "label string")).collect()}
    assert got == {1: "refusal", 2: "truncated"}


@pytest.mark.parametrize("text", ["a" * 200_000, "{" * 200_000, "1" * 200_000, "（" * 100_000, '"' * 99_999, "。" * 100_000, "热、" * 100_000, "A" * 200_000])
def test_very_long_texts(text):
    p3_defects.defect_of(text, PROMPT)
    p5_cutoff.scan(text, text)
