import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelforge import session
from labelforge.operators import validate
from labelforge.sources import config, files
from labelforge.streaming import gate_stream


def test_json_array_positions_and_checks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"input": "x"}, {"input": 5}]), encoding="utf-8")
    (tmp_path / "b.json").write_text("[]", encoding="utf-8")
    (tmp_path / "root.json").write_text('{"a":1}', encoding="utf-8")
    (tmp_path / "item.json").write_text("[1]", encoding="utf-8")
    rows = files.read_json_arrays(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert [(r["source"], r["row_idx"], r["file_no"]) for r in rows.orderBy("row_idx").collect()] == [("a.json", 0, 0), ("a.json", 1, 0)]
    for bad in ("root.json", "item.json"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            files.read_json_array(spark, str(tmp_path / bad)).collect()
    assert files.read_json_array(spark, str(tmp_path / "item.json"), check_items=False).count() == 1


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "中"), (2, "b", None)], "id long, t string, _hidden string")
    files.write_jsonl(df, str(tmp_path / "x.jsonl"))
    files.append_jsonl(df, str(tmp_path / "x.jsonl"))
    back = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id long, t string, _hidden string")
    assert back.count() == 4 and back.where("_hidden is not null").count() == 0
    assert '"t":null' in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "x.jsonl").glob("part-*"))


def test_malformed_line_raises_and_blank_lines_are_skipped(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"id":1}\n\n{"id":2}\n', encoding="utf-8")
    (tmp_path / "bad.jsonl").write_text('{"id":1}\n{', encoding="utf-8")
    assert files.read_jsonl(spark, str(tmp_path / "ok.jsonl"), "id long").count() == 2
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id long").collect()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, [1], "中")], "n long, l array<int>, t string")
    files.write_report(df, str(tmp_path / "deep" / "r.json"))
    text = (tmp_path / "deep" / "r.json").read_text(encoding="utf-8")
    assert json.loads(text) == {"n": 1, "l": [1], "t": "中"} and text.endswith("}\n") and "中" in text
    with pytest.raises(ValueError):
        files.write_report(spark.range(20), str(tmp_path / "r2.json"), most=10)
    files.write_scalars_csv(df, str(tmp_path / "c"))
    assert "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "c").glob("part-*")) == "n,t\n1,中\n"
    files.write_records(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_config_overlay(tmp_path):
    (tmp_path / "c.json").write_text('{"pairs":{"seed":7,"other":1},"nope":{"x":1},"paths":3}')
    got = config.load(str(tmp_path / "c.json"))
    assert got.pairs.seed == 7 and got.cleaning.seed == 42 and got.to_dict()["pairs"]["min_jaccard"] == 0.5
    (tmp_path / "l.json").write_text("[]")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "l.json"))


def test_streams(spark, tmp_path):
    good = '{"department":"儿科","urgency":"中","symptoms":["a"]}'
    rows = spark.createDataFrame([(1, good, good), (2, "x", "x"), (3, None, None)], "id long, output string, response string").withColumn("created_at", F.timestamp_seconds(F.col("id") * 60))
    rows.write.parquet(str(tmp_path / "in"))
    stream = gate_stream.read(spark, str(tmp_path / "in"), "id long, output string, response string, created_at timestamp")
    gate_stream.append_scored(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    q = gate_stream.reasons_by_window(stream).writeStream.format("memory").queryName("by_window").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["reason"], r["n"]) for r in spark.table("by_window").collect()} == {("ok", 1), ("not_object", 2)}


def test_records_that_lack_keys(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('[{"instruction":"i","input":"q","output":"o"}, 5, {"input":"q"}, {}]', encoding="utf-8")
    rows = files.read_json_array(spark, str(path), check_items=False)
    got = {(r["row_idx"], r["error"], r["keys"]) for r in validate.record_errors(rows, ["instruction", "input", "output"]).collect()}
    assert got == {(1, "row_not_object", None), (2, "missing_row_keys", "instruction,output"), (3, "missing_row_keys", "input,instruction,output")}
    assert {(r["row_idx"], r["keys"]) for r in validate.record_errors(rows, ["input", "output"], "missing_key").collect()} == {(1, None), (2, "output"), (3, "input"), (3, "output")}


def test_other_sections_of_settings_are_kept(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"cleaning":{"seed":7,"x":1},"dpo":{"beta":2.0}}', encoding="utf-8")
    given = config.load(str(path)).to_dict()
    assert given["cleaning"]["seed"] == 7 and given["dpo"] == {"beta": 2.0} and "others" not in given and "x" not in given["cleaning"]


def test_shared_folder_of_a_cluster_must_be_named():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"applicationId": "x", "master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert session.shared_folder(Session()) == session.shared_folder(Session())


def test_a_root_that_is_no_array(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text('{"a":1}', encoding="utf-8")
    rows = files.read_json_array(spark, str(path), check_root=False).select("row_idx", F.to_json("value").alias("v")).collect()
    assert [tuple(r) for r in rows] == [(0, '{"a":1}')]
