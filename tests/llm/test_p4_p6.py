import itertools
import random

import numpy as np
import pandas as pd
import pytest

from labelforge.llm import lookalike, p4_overlap, p6_frequency


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        k = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(k, rng.choice("甲乙丙丁"))
        elif s and kind == 1:
            s.pop(min(k, len(s) - 1))
        elif s:
            s[min(k, len(s) - 1)] = rng.choice("甲乙丙丁")
    return "".join(s)


def texts(seed, n=60):
    """Families of near texts of many lengths, also very short ones, spread edits included."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("头痛发热咳嗽恶心呕吐失眠腹泻三四五六天后") for _ in range(rng.choice([1, 2, 3, 6, 13, 20, 40, 90]))) for _ in range(n)]
    return base + [edited(rng, t, rng.randrange(0, 2 + len(t) // 5)) for t in base for _ in range(2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_exact(spark, seed):
    train, valid = texts(seed), texts(seed)[::2] + [None, "", "？！", "发热。", "Ｔ区"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(train)], "row_id long, input string")
    v = spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(valid)], "row_id long, input string")
    got = [tuple(r) for r in p4_overlap.overlaps(t, v).collect()]
    a = {i: lookalike.letters_and_digits(x) for i, x in enumerate(train)}
    b = {10_000 + i: lookalike.letters_and_digits(x or "") for i, x in enumerate(valid)}
    want = {(i, j) for i, x in a.items() for j, y in b.items() if x and y and levenshtein(x, y) <= int(0.15 * max(len(x), len(y)) + 1e-9)}
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_shingles_and_copies(spark, monkeypatch):
    """Every shingle is in a grid of cells."""
    for name, value in {"CELL_EVAL": 3, "CELL_TRAIN": 4, "TASK_POSTINGS": 50}.items():
        monkeypatch.setattr(p4_overlap, name, value)
    rows = [(i, f"孩子{i % 11}屁股又红又烫上周末饭后慢慢觉得同时腿脚发软一躺下更明显{i % 11}") for i in range(40)]
    t = spark.createDataFrame(rows, "row_id long, input string")
    got = p4_overlap.overlaps(t, t.selectExpr("row_id + 100 as row_id", "input"))
    assert got.count() == got.distinct().count() == 1600


def test_empty_sides(spark):
    t = spark.createDataFrame([(1, "发热")], "row_id long, input string")
    assert p4_overlap.overlaps(t.limit(0), t).count() == p4_overlap.overlaps(t, t.limit(0)).count() == 0


def test_prefixes_are_cheapest_and_apart():
    held = np.random.default_rng(0).integers(0, 50, 1 << p4_overlap.BITS)
    for _, n, codes in p4_overlap._batches([t for t in texts(5) if t] + ["头" * 700, "".join(random.Random(3).choices("头痛发热咳嗽", k=1300))]):
        for keys, mask, own in p4_overlap._shingled(codes, n, held):
            size = int(p4_overlap.shingle_of(n[own])[0])
            for row, chosen, length in zip(keys, mask, n[own].tolist(), strict=True):
                places = np.flatnonzero(chosen)
                assert len(places) == p4_overlap.tau_of(np.array([length]))[0] + 1
                assert (np.diff(places) >= size).all() and places[-1] + size <= length
                if length < 30:
                    cost = held[p4_overlap.bucket(row)]
                    best = min(sum(cost[list(c)]) for c in itertools.combinations(range(length - size + 1), len(places)) if all(y - x >= size for x, y in zip(c, c[1:])))
                    assert cost[places].sum() == best


def test_windows_change_by_two_for_an_edit():
    rng = random.Random(7)
    for _ in range(300):
        a = "".join(rng.choices("头痛发热咳嗽恶心呕吐失眠腹泻", k=rng.randrange(45, 70)))
        k = rng.randrange(1, len(a))
        b = a[:k] + rng.choice(["", "甲", "甲乙", a[k] + "丙"]) + a[k + 1 :]
        odd = [p4_overlap.windows(codes, n)[0] for t in (a, b) for _, n, codes in p4_overlap._batches([t])]
        assert np.bitwise_count(odd[0][0] ^ odd[1][0]) <= 2 * levenshtein(a, b)


def test_repeated_texts_give_postings_once(spark):
    """Rows of a text that come in many tasks: one of them is marked, and the sizes of cells are told from texts."""
    rows = spark.createDataFrame([(i, f"头痛发热咳嗽恶心{i % 50}呕吐失眠腹泻") for i in range(2000)], "row_id long, text string").repartition(8)
    info = rows.mapInPandas(lambda frames: p4_overlap._described(frames, None), p4_overlap._INFO).cache()
    marks, share, texts = p4_overlap._once(info)
    ids = np.arange(2000)
    passed = ids[marks.has(ids)]
    assert set((passed % 50).tolist()) == set(range(50)) and len(passed) < 300
    assert abs(texts - 50) <= 3 and abs(share - texts / info.where("fresh").count()) < 1e-9
    layout = p4_overlap._Layout(np.ones(1 << p4_overlap.BITS, dtype=np.int64), np.ones(1 << p4_overlap.BITS, dtype=np.int64), 1, (marks, None))
    frame = pd.DataFrame({"row_id": ids, "text": [f"头痛{i}" for i in ids]})
    assert [len(norms) for _, norms in p4_overlap._texts(iter([frame]), layout.marks[0])] == [len(passed)]
    assert p4_overlap._once(info.where("fresh").dropDuplicates(["nid"])) == (None, 1.0, 50)


def test_postings_as_a_matrix_or_one_by_one(spark, monkeypatch):
    """Both ways of comparing postings find the same pairs, in bites of any size."""
    held = np.ones(1 << p4_overlap.BITS, dtype=np.int64)
    layout = p4_overlap._Layout(held, held, 1)
    frames = [pd.DataFrame({"row_id": np.arange(len(t)), "text": t}) for t in (texts(3) + ["头痛发热" * 40], texts(3)[::2] + ["头痛发热" * 41])]
    rows = pd.concat([f for eval_side in (True, False) for f in p4_overlap._postings(iter([frames[eval_side]]), eval_side, layout)]).assign(part=0)
    got = []
    for dense, hits in ((1, 1 << 17), (1 << 40, 1 << 17), (1, 7), (1 << 40, 7)):
        monkeypatch.setattr(p4_overlap, "_DENSE", dense)
        monkeypatch.setattr(p4_overlap, "_HITS", hits)
        got.append(set(np.concatenate([f["pair"].to_numpy() for f in p4_overlap._joined(iter([rows]))]).tolist()))
    assert len(got[0]) > 100 and all(g == got[0] for g in got)


def test_characters_that_become_several_are_mapped_at_once():
    def slow(text):
        raise AssertionError(text)

    some = ["10㎎㎎x", "", "㎎", "Ⅱ度，３㎎", "无"]
    batch = lookalike._Batch(lookalike._ALONE_LETTERS, slow)
    assert batch(some) == batch(some[:]) == [lookalike.letters_and_digits(t) for t in some] == ["10mgmgx", "", "mg", "ii度3mg", "无"]


def test_report(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], "train_row_id long, valid_row_id long")
    valid = spark.createDataFrame([(10, "valid", "a"), (11, "valid", None), (12, "valid", "a")], "row_id long, split_name string, source string")
    got = {(r["split_name"], r["source"]): (r["rows"], r["overlapping_rows"], r["pairs"]) for r in p4_overlap.report(pairs, valid).collect()}
    assert got == {("valid", "a"): (2, 1, 2), ("valid", None): (1, 1, 1)}


def test_frequencies(spark):
    outputs = ['{"symptoms":["a","a"," a"]}'] * 3 + ['{"symptoms":["b",5,null,""]}', '{"symptoms":"a"}', "{}", '["a"]', None, "", '{"symptoms":["b"]} x'] + ['{"symptoms":["c"]}'] * 50
    rows = spark.createDataFrame([(o, "x") for o in outputs], "output string, term string")
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in p6_frequency.term_frequencies(p6_frequency.record_terms(rows)).collect()}
    assert got == {"a": (6, 3, "common"), " a": (3, 3, "common"), "b": (1, 1, "rare"), "": (1, 1, "rare"), "c": (50, 50, "common")}
    assert p6_frequency.term_frequencies(p6_frequency.record_terms(rows.limit(0))).count() == 0
