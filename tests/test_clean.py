import pytest
from pyspark.sql import functions as F

from labelforge.operators import clean

SCHEMA = "raw_id long, source_file string, row_idx long, input string, output string"


def label(d="儿科", u="中", s='["a"]'):
    return f'{{"department":"{d}","urgency":"{u}","symptoms":{s}}}'


ROWS = [
    (1, "teacher_batch_1.json", 0, " 咳嗽 ", label(), None), (2, "teacher_batch_1.json", 1, None, label(), "drop_bad_input"), (3, "teacher_batch_1.json", 2, "　", label(), "drop_bad_input"),
    (4, "teacher_batch_1.json", 3, "x", None, "drop_bad_json"), (5, "teacher_batch_1.json", 4, "x", "{}", "drop_missing_keys"), (6, "teacher_batch_1.json", 5, "x", '{"department":5,"urgency":"中","symptoms":["a"]}', "drop_bad_department_type"),
    (7, "teacher_batch_1.json", 6, "x", label("口腔科"), "drop_department:口腔科"), (8, "teacher_batch_1.json", 7, "x", label("未知科"), "drop_unknown_department:未知科"),
    (9, "teacher_batch_1.json", 8, "x", label("男科", "急"), "drop_bad_urgency"), (10, "teacher_batch_1.json", 9, "x", label(s='[" "]'), "drop_bad_symptoms"), (11, "teacher_batch_1.json", 10, "y", label(" 男科 ", " 高 "), None),
    (12, "teacher_batch_2.json", 0, "咳嗽", label("骨科"), None), (13, "teacher_batch_2.json", 1, "咳嗽", label(), None), (14, "zzz.json", 0, "z", label(s='["b","b"," c"],"note":1'), None),
]


@pytest.fixture(scope="module")
def normalised(spark):
    return clean.normalise(clean.in_order(spark.createDataFrame([r[:5] for r in ROWS], SCHEMA))).cache()


def test_drop_reasons_in_order(normalised):
    assert {r["raw_id"]: r["drop_reason"] for r in normalised.collect()} == {r[0]: r[5] for r in ROWS}


def test_rename_counts_even_if_dropped_later(normalised):
    assert {r["raw_id"] for r in normalised.where("rename is not null").collect()} == {9, 11}


def test_clean_output(normalised):
    got = {r["raw_id"]: r["clean_output"] for r in normalised.collect()}
    assert got[11] == '{"department":"泌尿外科","urgency":"高","symptoms":["a"]}' and got[14].endswith('"symptoms":["b","c"]}') and got[2] is None


def test_first_file_wins_and_conflicts(normalised):
    kept = clean.kept(normalised)
    assert {r["raw_id"] for r in clean.first_wins(kept, ["clean_input"]).collect()} == {1, 11, 14}
    (row,) = clean.duplicate_counts(kept).collect()
    assert (row["clean_input"], row["duplicates"], row["conflicts"]) == ("咳嗽", 2, 1)


def test_row_conservation(normalised):
    stats = {r["stat"]: r["n"] for r in clean.statistics(normalised).collect()}
    source = sum(n for s, n in stats.items() if s.startswith("source_rows:"))
    dropped = sum(n for s, n in stats.items() if s.startswith("drop_"))
    assert source - dropped == 3 and stats["duplicate_output_conflicts"] == 1


@pytest.mark.parametrize("n,valid", [(25, 2), (1, 1), (4991, 499), (35, 4), (0, 0)])
def test_split_sizes_round_half_even(spark, n, valid):
    rows = spark.range(n).select(F.col("id"), F.concat(F.lit("k"), F.col("id") % 7).alias("k"))
    got = clean.split(rows, F.col("k"), "id")
    assert got.where("split = 'valid'").count() == valid and got.count() == n
    again = clean.split(rows.repartition(5), F.col("k"), "id")
    assert got.select("id", "split").exceptAll(again.select("id", "split")).count() == 0


def test_hash_rank_is_a_permutation_even_for_one_hot_key(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert sorted(r["hash_rank"] for r in clean.hash_ranked(rows, F.col("k"), "id").collect()) == list(range(1, 501))


@pytest.mark.parametrize("k", [0, 1, 77, 300, 499, 500])
def test_lowest_is_what_a_global_sort_gives(spark, k, monkeypatch):
    monkeypatch.setattr(clean, "SORTED_ROWS", 2)
    rows = spark.range(500).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    ranked = clean.hash_ranked(rows, F.col("k"), "id").where(F.col("hash_rank") <= k).select("id")
    got = clean.lowest(rows, F.col("k"), "id", lambda n: k).where("lowest").select("id")
    assert got.count() == k and got.exceptAll(ranked).count() == 0
    assert clean.lowest(rows.limit(0), F.col("k"), "id", lambda n: max(1, n)).count() == 0


def test_value_counts_ties_by_first_appearance(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 0)], "v string, place int")
    assert [tuple(r) for r in clean.value_counts(rows, "v").collect()] == [("b", 2), ("a", 2), ("c", 1)]


def test_empty_table(spark):
    rows = clean.normalise(clean.in_order(spark.createDataFrame([], SCHEMA)))
    assert clean.first_wins(clean.kept(rows), ["clean_input"]).count() == 0
    assert {r["stat"]: r["n"] for r in clean.statistics(rows).collect()} == {"drop_duplicate_input": 0, "duplicate_output_conflicts": 0}
