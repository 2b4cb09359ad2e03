import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import p7_packing, p8_mixing, p9_language, tokens

LIMITS = "container string, capacity_tokens int"


@pytest.mark.parametrize("capacity,n", [(512, 3000), (20_000, 400), (10, 50)])
def test_solution_holds_every_item_once(capacity, n):
    sizes = np.minimum(np.random.default_rng(3).lognormal(4, 1, n).astype(int) + 1, capacity)
    u, c = np.unique(sizes, return_counts=True)
    found = p7_packing.solve(u, c, capacity, rounds=60)
    assert (sum(p * k for p, k in found) == c).all()
    assert all(p @ u <= capacity for p, _ in found)
    least = -(-int(sizes.sum()) // capacity)
    assert sum(k for _, k in found) <= 1.1 * least + 1


def test_knapsack_like_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        prices, counts = rng.random(4), rng.integers(1, 4, 4)
        got = p7_packing.knapsack(sizes, prices, counts, 20)
        best = max(np.dot(prices, x) for x in itertools.product(*[range(k + 1) for k in counts]) if np.dot(sizes, x) <= 20)
        assert got @ sizes <= 20 and (got <= counts).all() and got @ prices == pytest.approx(best)


def test_patterns_cover_sizes_that_a_greedy_fill_places_badly():
    rng = np.random.default_rng(3)
    two = rng.integers(251, 400, (100, 2))
    u, c = np.unique(np.concatenate([two.ravel(), 1000 - two.sum(1)]), return_counts=True)
    found = p7_packing.solve(u, c, 1000)
    # three to a container fill 100 exactly
    assert (sum(p * k for p, k in found) == c).all() and sum(k for _, k in found) <= 105


def test_packing(spark):
    docs = spark.createDataFrame([(i, "发热 " * (i % 40)) for i in range(300)] + [(300, None), (301, ""), (302, "咳嗽，" * 3000), (5, "发热 " * 5)], "doc_id long, text string").withColumn("bin", F.lit("x"))
    limits = spark.createDataFrame([("s", 64), ("l", 1024)], LIMITS)
    packed = p7_packing.pack(docs, limits).cache()
    sizes = docs.select("doc_id", tokens.token_count(F.col("text")).alias("t")).groupBy("doc_id").agg(F.sum("t").alias("t"))
    for name, capacity in (("s", 64), ("l", 1024)):
        own = packed.where(F.col("container") == name)
        assert own.groupBy("bin").agg(F.sum("tokens").alias("t")).where(F.col("t") > capacity).count() == 0
        got = own.groupBy("doc_id").agg(F.sum("tokens").alias("got"), F.max("part").alias("part"))
        assert got.join(sizes, "doc_id").where("got <> t").count() == 0 and got.count() == 303
        assert {r["doc_id"] for r in got.where("part > 0").collect()} == {r["doc_id"] for r in sizes.where(F.col("t") > capacity).collect()}
    assert p7_packing.containers(packed).where("container = 'l'").agg(F.avg("fill")).first()[0] > 0.9
    assert p7_packing.pack(docs.limit(0), limits).count() == 0


def test_hot_size(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same text in every document").alias("text"))
    packed = p7_packing.pack(docs, spark.createDataFrame([("s", 64)], LIMITS))
    fill = packed.groupBy("bin").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    assert packed.select("doc_id").distinct().count() == 2000 and fill.where("t > 64").count() == 0


def test_hot_size_in_many_salts_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(p7_packing, "SALT_ROWS", 3)
    monkeypatch.setattr(p7_packing, "FEW_PLACES", 0)
    test_hot_size(spark)


TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "small").when(F.col("id") % 20 == 9, "other").alias("source"), F.concat(F.lit("sentence number "), F.col("id").cast("string"), F.lit(". and more of it.")).alias("text"), F.lit(1).alias("tokens"), F.lit(0.5).alias("key"))
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("gone", 0.2, 2)], TARGETS)
    chosen, plan = p8_mixing.mix(docs, targets)
    rows = {r["source"]: r for r in p8_mixing.shares(chosen, plan).collect()}
    assert rows["small"]["most_repeats"] == 3 and rows["big"]["most_repeats"] == 1 and rows["gone"]["chosen_tokens"] == 0
    total = sum(r["chosen_tokens"] for r in rows.values())
    assert rows["small"]["chosen_tokens"] / rows["big"]["chosen_tokens"] == pytest.approx(1.5, rel=0.01) and total > 0
    assert chosen.where("source not in ('big', 'small')").count() == 0
    assert chosen.groupBy("source").agg(F.max("repeats") - F.min("repeats")).where("source = 'small'").first()[1] <= 1
    again, _ = p8_mixing.mix(docs.repartition(7), targets)
    assert chosen.exceptAll(again).count() == 0
    nothing, plan = p8_mixing.mix(docs.limit(0), targets)
    assert nothing.count() == 0 and p8_mixing.shares(nothing, plan).where("actual_share <> 0").count() == 0


def test_better_documents_are_drawn_more_often(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1800, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("one. "), F.lit("two. "), F.lit("three. "), F.lit("x" * 200))).otherwise(F.lit("same. same. same. same. same. same. same. same.")).alias("text"))
    chosen, _ = p8_mixing.mix(docs, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS))
    some = chosen.where("source = 'a'")
    assert some.where("doc_id % 2 = 0").count() > 1.5 * some.where("doc_id % 2 = 1").count()


SAID = {
    "zh": "候诊期间如果岔气加重，请立刻告诉导诊台，不必等叫号。值班人员把紧急程度先记为中，等眼科回电后再确认。",
    "en": "There was no allergy on record, but her younger son took it without asking. We advised the patient to rest and drink water.",
    "ja": "ゆっくり休んで、具合が悪くなったらまた来るように伝えました。夜中に乾いた咳が出たら、すぐお電話ください。",
    "es": "Vaya primero al mostrador de pediatría, porque hay que revisar un dolor sordo de espalda hoy mismo. No consta ninguna alergia.",
    "ko": "밤에 흐린 시야 증상이 다시 나타나면 기다리지 말고 바로 전화하세요. 충분히 쉬고 물을 많이 마시라고 안내했습니다.",
    "fr": "Passez d'abord au guichet de pédiatrie, car une vue trouble doit être examinée aujourd'hui. La fillette se plaint depuis mardi.",
    "de": "Bitte melden Sie sich zuerst am Schalter der Augenklinik, weil trockener Husten heute abgeklärt werden muss. Wir machen uns Sorgen.",
    "pt": "Dissemos que a menina devia descansar e voltar se a febre subiu outra vez. Não há alergias registadas, mas o meu pai tomou o remédio.",
    "ru": "Бабушка с начала месяца жалуется на внезапное головокружение. Мой отец принял лекарство, никого не спросив.",
}


def documents(spark, extra=()):
    rows, n = [], 0
    for lang, text in SAID.items():
        for k in range(6):
            wrong = k == 0 and lang != "en"
            rows.append((n, f"{text} {k} {text}", "en" if wrong else lang.upper() if k == 1 else f"{lang}_XX" if k == 2 else lang))
            n += 1
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string")


def test_languages_and_wrong_labels(spark):
    found = p9_language.languages(documents(spark)).collect()
    langs = list(SAID)
    assert all(r["lang"] == langs[r["doc_id"] // 6] and r["seg_no"] == 0 and 0 < r["confidence"] <= 1 for r in found)
    cases = p9_language.corrections(p9_language.languages(documents(spark))).collect()
    assert {r["doc_id"] for r in cases} == {6 * i for i, lang in enumerate(langs) if lang != "en"}


def test_stretches_and_asides(spark):
    extra = [
        (900, SAID["en"] + SAID["zh"] + "\n" + SAID["fr"], "mul"), (901, "（VIP ward）" + SAID["zh"] + '示例输出：{"department":"x","urgency":"y"}', "zh"), (902, SAID["es"] + " (吐奶)", "es"),
        (903, None, "zh"), (904, " ", None), (905, "!!", ""), (906, SAID["ko"], None), (907, SAID["de"], "??"),
    ]
    rows = p9_language.languages(documents(spark, extra)).where("doc_id >= 900").orderBy("doc_id", "seg_no").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["seg_no"], r["lang"]))
    assert got == {900: [(1, "en"), (2, "zh"), (3, "fr")], 901: [(0, "zh")], 902: [(0, "es")], 903: [(0, None)], 904: [(0, None)], 905: [(0, None)], 906: [(0, "ko")], 907: [(0, "de")]}
    cases = {(r["doc_id"], r["seg_no"]) for r in p9_language.corrections(p9_language.languages(documents(spark, extra))).where("doc_id >= 900").collect()}
    assert cases == {(900, 1), (900, 2), (900, 3), (906, 0), (907, 0)}


def test_empty_table_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert p9_language.languages(none).count() == 0
    unlabelled = spark.createDataFrame([(1, SAID["zh"], None)], "doc_id long, text string, lang string")
    assert p9_language.languages(unlabelled).first()["lang"] is None


def test_label_names(spark):
    rows = spark.createDataFrame([("zh-CN", "zh"), ("EN_gb", "en"), (" Chinese", "zh"), ("mul", None), ("", None), (None, None), ("es-419", "es")], "l string, want string")
    assert rows.where(~p9_language.label_language(F.col("l")).eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("text,read,unread", [
    ("今天去了医院。（医生说没有大碍，可以放心。）回家休息。", "医生说没有大碍", "（"), ("(The nurse called back later.) Wir warten.", "nurse called", "("), ("他说“右下肺不舒服。”然后回家。", "然后回家", "右下肺"), ("服用（chest pain）后缓解。", "服用", "chest"),
])
def test_whole_sentences_in_brackets_are_read(text, read, unread):
    wordings = " ".join(w for _, _, w in p9_language.sentences(text))
    assert read in wordings and unread not in wordings


def test_short_texts_keep_the_margin():
    """Two languages with the same sentences can't be told apart, however short the text; one that holds it can."""
    line = "el paciente tiene fiebre y tos desde ayer por la tarde\n"
    same = p9_language.Classifier({"es": (line * 9).encode(), "pt": (line * 9).encode()})
    assert same.stretches("tiene fiebre y tos.") == [] and same.decide("tiene fiebre y tos desde ayer")[0] is None
    other = p9_language.Classifier({"es": (line * 9).encode(), "de": ("der Patient hat seit gestern Fieber und Husten\n" * 9).encode()})
    assert other.decide("tiene fiebre y tos desde ayer")[0] == "es" and other.foreign_to("tiene fiebre y tos desde ayer", "de") is True
    assert other.foreign_to("der Patient hat seit gestern Fieber", "de") is False and other.foreign_to("qqq", "de") is None
    assert p9_language.Classifier({}).decide("x") == (None, 0.0)
