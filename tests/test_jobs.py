import json

from labelforge.plans import jobs
from labelforge.sources import predictions


def label(d="儿科", u="中", s=("a",)):
    return {"department": d, "urgency": u, "symptoms": list(s)}


def text(*a, **k):
    return json.dumps(label(*a, **k), ensure_ascii=False, separators=(",", ":"))


def test_cleaning_conserves_rows(spark, tmp_path):
    one = [{"input": f"q{i}", "output": text()} for i in range(30)] + [{"input": "q0", "output": text("骨科")}, {"input": 5, "output": text()}, {"output": text()}]
    two = [{"input": "q1", "output": label()}, {"input": "new", "output": label("男科")}, {"input": "bad", "output": "x"}]
    for name, rows in (("a.json", one), ("b.json", two)):
        (tmp_path / name).write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    stats = {r["stat"]: r["n"] for r in jobs.clean_files(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], str(tmp_path / "out")).collect()}
    n = lambda f: spark.read.json(str(tmp_path / "out" / f)).count()
    assert n("all.jsonl") == 31 and n("valid.jsonl") == 3 and n("train.jsonl") == 28
    assert stats["drop_duplicate_input"] == 2 and stats["duplicate_output_conflicts"] == 1 and stats["drop_bad_input"] == 2 and stats["source_rows:b.json"] == 3
    assert sum(v for k, v in stats.items() if k.startswith("source_rows:")) - sum(v for k, v in stats.items() if k.startswith("drop_")) == 31


LOG = [
    {"idx": 0, "input": "q0", "gold": label(u="高"), "response": text(u="高")},
    {"idx": 1, "input": "q1", "gold": text(), "response": text(), "parsed_prediction": None, "parsed": label("骨科")},
    {"idx": 2, "input": "q2", "gold": None, "output": text(), "parsed": label("骨科"), "response": "x"},
    {"input": "q3", "gold": "x", "response": text()},
]


def test_logs(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    open(path, "w", encoding="utf-8").write("\n\n".join(json.dumps(r, ensure_ascii=False) for r in LOG))
    rows = {r["input"]: (json.loads(r["response"])["department"], r["idx"] is not None) for r in predictions.read_log(spark, path).collect()}
    assert rows == {"q0": ("儿科", True), "q1": ("儿科", True), "q2": ("骨科", True), "q3": ("儿科", True)}
    got = jobs.metrics_of_log(spark, path).first()
    assert (got["num_evaluated"], got["e2e_accuracy"]) == (3, round(2 / 3, 6))
    assert jobs.compare_logs(spark, path, path).first()["both_correct"] == 2


def test_logs_are_compared_by_place_however_they_are_split(spark, tmp_path):
    """One log is read in one piece, the other in many; both have no idx."""
    rows = [{"input": f"q{i}", "gold": label(u="高") if i % 3 else "x", "response": text(u="高" if i % 2 else "低")} for i in range(400)]
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")
    open(a, "w", encoding="utf-8").write("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    open(b, "w", encoding="utf-8").write("\n".join(json.dumps(r | {"response": text(u="高")}, ensure_ascii=False) for r in rows[:390]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        assert predictions.read_log(spark, b).rdd.getNumPartitions() >= 1
        assert [r["input"] for r in predictions.read_log(spark, b).orderBy("pred_id").collect()] == [f"q{i}" for i in range(390)]
        got = jobs.compare_logs(spark, a, b).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    bad, low = sum(i % 3 == 0 for i in range(390)), sum(i % 3 > 0 and i % 2 == 0 for i in range(390))
    assert (got["num_compared"], got["input_mismatch"], got["both_wrong"], got["improved"], got["regressed"]) == (390, 0, bad, low, 0)


def test_cleaning_of_files_that_spark_splits(spark, tmp_path):
    rows = [{"input": f"q{i % 25}", "output": text() if i % 5 else label("骨科")} for i in range(60)] + [{"input": "u", "output": text("某科")}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    spark.createDataFrame([("q0", text()), ("p", text("儿科"))], "input string, output string").write.parquet(str(tmp_path / "b.parquet"))
    stats = {r["stat"]: r["n"] for r in jobs.clean_files(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.parquet")], str(tmp_path / "out")).collect()}
    assert stats["source_rows:a.jsonl"] == 61 and stats["source_rows:b.parquet"] == 2 and stats["drop_duplicate_input"] == 36 and stats["drop_unknown_department:某科"] == 1
    kept = {r["input"]: json.loads(r["output"])["department"] for r in spark.read.json(str(tmp_path / "out" / "all.jsonl")).collect()}
    assert len(kept) == 26 and kept["q0"] == "骨科" and kept["p"] == "儿科"
    report = json.load(open(tmp_path / "out" / "report.json", encoding="utf-8"))
    assert "drop_unknown_department:某科" not in {r["stat"] for r in report} and spark.read.json(str(tmp_path / "out" / "counters")).count() == len(stats)


def test_hard_pairs_of_splits(spark, tmp_path):
    pair = lambda a, b: {"conversations": [{"from": "human", "value": "q"}] * 2, "chosen": {"from": "gpt", "value": a}, "rejected": {"from": "gpt", "value": b}}
    (tmp_path / "dpo_train.jsonl").write_text("\n".join(json.dumps(pair(text(), b), ensure_ascii=False) for b in (text("骨科"), text(s=("b",)), "x")), encoding="utf-8")
    counts = {(r["split"], r["filter_reason"]): r["n"] for r in jobs.filter_hard_files(spark, str(tmp_path), str(tmp_path / "hard")).collect()}
    assert counts == {("train", "dept"): 1, ("train", "symptom_only"): 1, ("train", "parse_error"): 1}
    assert spark.read.json(str(tmp_path / "hard" / "dpo_train_hard.jsonl")).count() == 1


def test_pairs_and_validation(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    open(path, "w", encoding="utf-8").write("\n".join(json.dumps(r, ensure_ascii=False) for r in LOG))
    train = spark.createDataFrame([(i, "i", f"t{i}", text(s=("a", "b"))) for i in range(40)], "row_id long, instruction string, input string, output string")
    counts = {(r["split"], r["_source"]): r["n"] for r in jobs.build_pairs(spark, train, [path], str(tmp_path / "p"), max_synthetic=20).collect()}
    assert sum(counts.values()) == 21 and sum(n for (s, _), n in counts.items() if s == "valid") == 2
    made = spark.read.json(str(tmp_path / "p" / "dpo_train.jsonl"))
    assert made.columns == ["chosen", "conversations", "rejected"] and made.count() == 19
    pair_rows = made.selectExpr("monotonically_increasing_id() as pair_id", "cast(null as string) as _source", "conversations", "chosen", "rejected")
    report = {r["kind"]: (r["num_rows"], r["passed"]) for r in jobs.validate_frames(train, pair_rows).collect()}
    assert report == {"sft": (40, True), "dpo": (19, True), "all": (59, True)}
    reasons = jobs.filter_hard_pairs(pair_rows, str(tmp_path / "hard")).collect()
    kept = sum(r["n"] for r in reasons if r["keep"])
    assert spark.read.json(str(tmp_path / "hard")).count() == kept
    jobs.prompt_file(train, str(tmp_path / "g.jsonl"))
    assert spark.read.json(str(tmp_path / "g.jsonl")).count() == 40
