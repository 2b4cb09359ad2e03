"""Scores of saved predictions against gold labels, and comparisons of two runs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge import constants
from labelforge.functions import jsonx
from labelforge.functions.symptoms import jaccard, with_worded_scores
from labelforge.operators import gate

BAD = "BAD_ANSWER"


def labelled(predictions: DataFrame, answer: str = "response", gold: str = "gold", mode: str = "full") -> DataFrame:
    """One row per prediction with gold and predicted parts and whether they agree; symptoms are not compared.

    Rows whose gold is invalid keep ``gold_reason`` and count nowhere else.
    """
    both = gate.with_label(gate.with_label(predictions, gold, "gold"), answer, "pred", mode)
    ok = F.col("pred_reason") == "ok"
    return (
        both.withColumn("dept_ok", ok & (F.col("gold_department") == F.col("pred_department")))
        .withColumn("urgency_ok", ok & (F.col("gold_urgency") == F.col("pred_urgency")))
        .withColumn("pred_label", F.coalesce("pred_urgency", F.lit(BAD)))
    )


def scored(predictions: DataFrame, answer: str = "response", gold: str = "gold", mode: str = "full") -> DataFrame:
    """:func:`labelled` with scores of symptoms, which are null unless the answer is valid."""
    both = with_worded_scores(labelled(predictions, answer, gold, mode), "gold_symptoms", "pred_symptoms")
    ok = F.col("pred_reason") == "ok"
    return (
        both.withColumn("hard_jaccard", F.when(ok, jaccard(F.col("gold_symptoms"), F.col("pred_symptoms"))))
        .withColumn("worded_f1", F.when(ok, F.col("worded_f1")))
        .withColumn("worded_jaccard", F.when(ok, F.col("worded_jaccard")))
    )


def _rate(part, whole):
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole), 6), F.lit(0.0))


def _f1(label: str, among: Column):
    gold, pred = among & (F.col("gold_urgency") == label), among & (F.col("pred_label") == label)
    hit = F.count_if(gold & pred)
    return F.coalesce(F.try_divide(2.0 * hit, F.count_if(gold) + F.count_if(pred)), F.lit(0.0))


def macro_f1(among: Column | None = None) -> Column:
    """Mean F1 of the urgencies, of all rows or those where ``among`` holds."""
    among = F.lit(True) if among is None else among
    return F.round(sum((_f1(u, among) for u in constants.URGENCIES), F.lit(0.0)) / len(constants.URGENCIES), 6)


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """All metrics of scored rows, per group; partial sums only are shuffled."""
    rows = rows.where("gold_reason = 'ok'")
    n, valid = F.count("*"), F.count_if(F.col("pred_reason") == "ok")
    high = F.col("gold_urgency") == "高"
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    return rows.groupBy(*by).agg(
        n.alias("num_evaluated"),
        _rate(F.count_if("pred_parsed"), n).alias("json_parse_rate"),
        _rate(valid, n).alias("schema_valid_rate"),
        _rate(F.count_if("dept_ok"), valid).alias("department_accuracy"),
        _rate(F.count_if("urgency_ok"), valid).alias("urgency_accuracy"),
        _rate(F.count_if(F.col("dept_ok") & F.col("urgency_ok")), n).alias("e2e_accuracy"),
        macro_f1().alias("urgency_macro_f1"),
        _rate(F.count_if(high & (F.col("pred_label") == "高")), F.count_if(high)).alias("high_urgency_recall"),
        F.count_if(high).alias("high_urgency_total"),
        F.count_if(high & (F.col("pred_label") == "中")).alias("high_to_medium"),
        F.count_if(high & (F.col("pred_label") == "低")).alias("high_to_low"),
        F.count_if(high & (F.col("pred_label") == BAD)).alias("high_to_bad"),
        mean("hard_jaccard").alias("hard_jaccard"),
        mean("worded_f1").alias("worded_f1"),
        mean("worded_jaccard").alias("worded_jaccard"),
    )


def counters(rows: DataFrame) -> DataFrame:
    """``counter, n``: evaluated, parsed, valid, and each reason of a skipped gold or failed answer."""
    good = F.col("gold_reason") == "ok"
    labels = F.array_compact(
        F.array(
            F.when(good, "evaluated"),
            F.when(good, F.when(F.col("pred_parsed"), "json_parse_ok").otherwise("json_parse_error")),
            F.when(good & (F.col("pred_reason") == "ok"), "schema_valid"),
            F.when(good & (F.col("pred_reason") != "ok"), F.concat(F.lit("schema_error:"), F.col("pred_reason"))),
            F.when(~good, F.concat(F.lit("skip_bad_gold:"), F.col("gold_reason"))),
        )
    )
    return rows.select(F.explode(labels).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, gold: str, pred: str, labels: list[str], seen: bool = False) -> DataFrame:
    """``gold, pred, n`` for every pair of labels, also those that never occur; with ``seen`` all other values too, as they occur."""
    spark = rows.sparkSession
    if seen:
        counted = rows.groupBy(F.coalesce(gold, F.lit(BAD)).alias("gold"), F.coalesce(pred, F.lit(BAD)).alias("pred")).agg(F.count("*").alias("n"))
        axis = spark.createDataFrame([(g, p) for g in labels for p in labels], "gold string, pred string")
        return counted.union(axis.withColumn("n", F.lit(0).cast("bigint"))).groupBy("gold", "pred").agg(F.sum("n").alias("n"))
    axis = spark.createDataFrame([(g, p) for g in labels for p in labels], "gold string, pred string")
    counted = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return axis.join(counted, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def classification_report(rows: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per label, then accuracy, macro and weighted means.

    Zero divisions give 0; labels that neither side holds have no line. Rows are
    counted once into cells; what follows is as small as the label set.
    """
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    per = cells.select(F.explode(F.array_distinct(F.array("g", "p"))).alias("label"), "g", "p", "n").where(F.col("label").isin(labels))
    held = lambda a, b: F.sum(F.when((F.col(a) == F.col("label")) & (F.col(b) == F.col("label")), F.col("n")).otherwise(0))
    sums = per.groupBy("label").agg(held("g", "p").alias("tp"), held("g", "g").alias("support"), held("p", "p").alias("predicted"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    measures = [zero(F.col("tp"), F.col("predicted")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1")]
    lines = sums.select("label", "tp", "support", *measures)
    # one row that holds all lines, so that the means need no second reading of the rows
    whole = lines.agg(F.collect_list(F.struct("label", "precision", "recall", "f1", "support")).alias("lines"), F.sum("tp").alias("tp"), F.sum("support").alias("support"), *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")], *[F.sum(F.col(c) * F.col("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    line = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("support").alias("support"))
    accuracy, total = zero(F.col("tp"), F.col("support")), F.col("support")
    extra = F.array(line("accuracy", accuracy, accuracy, accuracy), line("macro avg", *[F.col(f"m_{c}") for c in ("precision", "recall", "f1")]), line("weighted avg", *[zero(F.col(f"w_{c}"), total) for c in ("precision", "recall", "f1")]))
    return whole.select(F.inline(F.concat("lines", extra))).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def positioned(predictions: DataFrame, gold: str = "gold", answer: str = "response") -> DataFrame:
    """What a comparison by position needs: a gold label counts by its own values, valid or not, and every row counts."""
    rows = gate.with_label(predictions.select("pred_id", "run_name", "idx", "input", answer, gate.parsed(F.col(gold)).alias("__gold")), answer, "pred")
    value = lambda k: jsonx.string_value(F.try_element_at("__gold", F.lit(k)))
    rows = jsonx.settled(rows, gold_department=value("department"), gold_urgency=value("urgency"))
    same = lambda k: F.coalesce((F.col("pred_reason") == "ok") & (F.col(f"gold_{k}") == F.col(f"pred_{k}")), F.lit(False))
    return rows.select("pred_id", "run_name", "idx", "input", (same("department") & same("urgency")).alias("ok"), same("urgency").alias("uok"), F.coalesce("pred_urgency", F.lit(BAD)).alias("urgency"), F.col("gold_urgency").alias("gold"))


def paired(rows: DataFrame, base: str, candidate: str) -> DataFrame:
    """:func:`positioned` rows of two runs side by side by position, as far as both go; a retried position counts once, first answer wins."""
    of = lambda run: F.min(F.when(F.col("run_name") == run, F.struct("pred_id", "input", "ok", "uok", "urgency", "gold")))
    both = rows.where(F.col("run_name").isin(base, candidate)).groupBy("idx").agg(of(base).alias("a"), of(candidate).alias("b")).where("a is not null and b is not null")
    return both.select("idx", *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("input", "ok", "uok", "urgency", "gold")])


def comparison(pairs: DataFrame) -> DataFrame:
    """One row: the two-by-two table, flips of urgency, high-risk answers of each side and net gains."""
    a, b, high = F.col("ok_a"), F.col("ok_b"), F.coalesce(F.col("gold_a") == "高", F.lit(False))
    return pairs.agg(
        F.count("*").alias("num_compared"),
        F.count_if(~F.col("input_a").eqNullSafe(F.col("input_b"))).alias("input_mismatch"),
        F.count_if(a & b).alias("both_correct"),
        F.count_if(~a & ~b).alias("both_wrong"),
        F.count_if(~a & b).alias("improved"),
        F.count_if(a & ~b).alias("regressed"),
        (F.count_if(~a & b) - F.count_if(a & ~b)).alias("net_e2e"),
        F.count_if(~F.col("uok_a") & F.col("uok_b")).alias("urgency_fixed"),
        F.count_if(F.col("uok_a") & ~F.col("uok_b")).alias("urgency_broken"),
        F.count_if(high).alias("high_total"),
        F.count_if(high & (F.col("urgency_a") == "高")).alias("high_hit_a"),
        F.count_if(high & (F.col("urgency_b") == "高")).alias("high_hit_b"),
        F.count_if(high & (F.col("urgency_a") == "低")).alias("high_to_low_a"),
        F.count_if(high & (F.col("urgency_b") == "低")).alias("high_to_low_b"),
    )


def examples(pairs: DataFrame, kind: str, n: int = 20) -> DataFrame:
    """The first ``n`` improved or regressed positions (a top-k report)."""
    wanted = (~F.col("ok_a") & F.col("ok_b")) if kind == "improved" else (F.col("ok_a") & ~F.col("ok_b"))
    return pairs.where(wanted).orderBy("idx").limit(n).select("idx", F.col("input_a").alias("input"), F.col("urgency_a"), F.col("urgency_b"))
