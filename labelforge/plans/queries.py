"""Queries over the triage tables; each takes a session and a data folder."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge import constants
from labelforge.functions import jsonx
from labelforge.functions.symptoms import jaccard, jaccard_strict, schema_symptoms, worded
from labelforge.operators import clean, gate, metrics, pairs, records, reward, semantic, validate
from labelforge.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teacher_raw").select("raw_id", "source_file", "row_idx", "input", "output")


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    return clean.normalise(clean.in_order(_raw(spark, d)))


def _deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return clean.first_wins(clean.kept(_normalised(spark, d)), ["clean_input"])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return metrics.scored(table(spark, d, "predictions").select("pred_id", "run_name", "idx", "input", "gold", "response"))


def _valid_gold(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("gold_reason = 'ok'")


def _valid_labels(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`_valid_gold`, without comparing symptoms."""
    return metrics.labelled(table(spark, d, "predictions").select("pred_id", "run_name", "gold", "response")).where("gold_reason = 'ok'")


def _two_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paired(metrics.positioned(table(spark, d, "predictions")), "base", "grpo_a")


# parsing and the gate


@query
def json_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why each raw output is or is not a valid label, per file."""
    return gate.with_label(_raw(spark, d), "output", "label").groupBy("source_file", F.col("label_reason").alias("reason")).agg(F.count("*").alias("n"))


@query
def parse_mode_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Outputs read as an object by each way of preparing the text."""
    raw = _raw(spark, d)
    return raw.select(*[gate.parsed(F.col("output"), m).isNotNull().alias(m) for m in gate.MODES]).groupBy(*gate.MODES).agg(F.count("*").alias("n"))


@query
def label_fields(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every valid training label."""
    v = gate.with_label(table(spark, d, "sft_train").select("row_id", "output"), "output", "label").where("label_reason = 'ok'")
    return v.select("row_id", F.col("label_department").alias("department"), F.col("label_urgency").alias("urgency"), F.concat_ws("|", "label_symptoms").alias("symptoms"))


@query
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    """Key sets of objects, with missing and extra keys."""
    o = jsonx.settled(_raw(spark, d).select("output"), k=F.map_keys(gate.parsed(F.col("output")))).where("k is not null")
    need = F.array(*[F.lit(k) for k in constants.LABEL_KEYS])
    j = lambda a: F.concat_ws(",", F.array_sort(a))
    return o.select(j(F.col("k")).alias("keys"), j(F.array_except(need, "k")).alias("missing"), j(F.array_except("k", need)).alias("extra")).groupBy("keys", "missing", "extra").agg(F.count("*").alias("n"))


@query
def schema_symptom_lists(spark: SparkSession, d: str) -> DataFrame:
    """Symptom lists trimmed and without repeats; null where an element is no string."""
    items = jsonx.array_items(F.try_element_at(gate.parsed(F.col("output")), F.lit("symptoms")))
    return jsonx.settled(_raw(spark, d).select("raw_id", "output"), items=items).where("items is not null").select("raw_id", F.array_join(schema_symptoms(F.col("items")), "|").alias("symptoms"))


@query
def worded_symptoms(spark: SparkSession, d: str) -> DataFrame:
    """Symptoms in the wording that scores compare, counted."""
    v = gate.with_label(table(spark, d, "sft_train").select("row_id", "output"), "output", "label").where("label_reason = 'ok'")
    return v.select(F.explode(worded(F.col("label_symptoms"))).alias("symptom")).groupBy("symptom").agg(F.count("*").alias("n"))


# cleaning


@query
def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    return _deduplicated(spark, d).select("raw_id", "clean_input", "clean_output")


@query
def clean_drop_stats(spark: SparkSession, d: str) -> DataFrame:
    return clean.statistics(_normalised(spark, d)).select("stat", F.col("n").cast("bigint").alias("n"))


@query
def dedup_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return clean.duplicate_counts(clean.kept(_normalised(spark, d))).select("clean_input", "duplicates", "conflicts")


@query
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _deduplicated(spark, d).select("raw_id", "clean_input")
    return clean.split(rows, F.col("clean_input"), "raw_id").select("raw_id", "split")


@query
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Departments and urgencies of clean rows with their rank: most first, ties by first appearance."""
    rows = _deduplicated(spark, d)
    out = []
    for field in ("department", "urgency"):
        counts = rows.groupBy(F.col(f"clean_{field}").alias("value")).agg(F.count("*").alias("n"), F.min("place").alias("at"))
        # as few rows as there are labels
        out.append(counts.select(F.lit(field).alias("field"), "value", "n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "at")).cast("bigint").alias("rank")))
    return out[0].union(out[1])


@query
def clean_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept, dropped, duplicate, and conflicting; kept, dropped and duplicate rows make up the source rows."""
    # dropped rows share one empty key, so one pass by key counts everything
    is_kept = F.col("drop_reason").isNull()
    per_value = _normalised(spark, d).groupBy(is_kept.alias("kept"), F.when(is_kept, F.col("clean_input")).alias("key"), F.when(is_kept, F.col("clean_output")).alias("value"))
    per_value = per_value.agg(F.count("*").alias("n"), F.count("rename").alias("renamed"), F.min("place").alias("at"))
    per_key = per_value.groupBy("kept", "key").agg(F.sum("n").alias("n"), F.sum("renamed").alias("renamed"), F.min(F.struct("at", "n")).alias("first"))
    sums = per_key.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for c, name in ((F.sum("n"), "source_rows"), (F.sum(F.when(~F.col("kept"), F.col("n"))), "dropped"), (F.sum("renamed"), "renamed"), (F.sum(F.when(F.col("kept"), F.col("n") - 1)), "duplicates"), (F.sum(F.when(F.col("kept"), F.col("n") - F.col("first.n"))), "conflicts"))])
    return sums.withColumn("num_clean_rows", F.col("source_rows") - F.col("dropped") - F.col("duplicates"))


@query
def document_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("text_md5"))
    return clean.first_wins(docs, ["text_md5"], "doc_id")


# validation


@query
def sft_row_errors(spark: SparkSession, d: str) -> DataFrame:
    return validate.row_errors(table(spark, d, "sft_train")).groupBy("error").agg(F.count("*").alias("n"))


@query
def sft_row_errors_all(spark: SparkSession, d: str) -> DataFrame:
    return validate.row_errors(table(spark, d, "sft_train"), every=True).groupBy("error").agg(F.count("*").alias("n"))


@query
def sft_error_preview(spark: SparkSession, d: str) -> DataFrame:
    return validate.error_preview(validate.row_errors(table(spark, d, "sft_train")))


@query
def duplicate_inputs(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicate_inputs(table(spark, d, "sft_train"))


@query
def duplicate_inputs_top(spark: SparkSession, d: str) -> DataFrame:
    """The inputs held most often (a top-k report)."""
    return validate.duplicate_inputs(table(spark, d, "sft_train"), cap=20)


@query
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.report(table(spark, d, "sft_valid"))


@query
def validation_error_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first errors of each split, with their row and value."""
    return validate.report_preview(table(spark, d, "sft_valid"))


@query
def pair_validation_diffs(spark: SparkSession, d: str) -> DataFrame:
    diffs = validate.pair_diffs(table(spark, d, "dpo_train_2"))
    return diffs.groupBy(F.concat_ws(",", "errors").alias("errors"), "warning", "diff").agg(F.count("*").alias("n"))


@query
def hard_pair_filter(spark: SparkSession, d: str) -> DataFrame:
    hard = validate.hard_pairs(validate.pair_diffs(table(spark, d, "dpo_train_2")))
    return hard.groupBy("_source", "filter_reason", "keep").agg(F.count("*").alias("n"))


# preference pairs and records


@query
def synthetic_pairs(spark: SparkSession, d: str) -> DataFrame:
    made = pairs.synthetic(table(spark, d, "sft_train").select("row_id", "instruction", "input", "output"))
    return made.select("row_id", F.col("chosen.value").alias("chosen"), F.col("rejected.value").alias("rejected"))


@query
def synthetic_pairs_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of made-up pairs (a sampling operator)."""
    made = pairs.synthetic(table(spark, d, "sft_train").select("row_id", "instruction", "input", "output"), most=1000)
    return made.select("row_id", F.col("chosen.value").alias("chosen"), F.col("rejected.value").alias("rejected"))


@query
def prediction_error_pairs(spark: SparkSession, d: str) -> DataFrame:
    made = pairs.from_predictions(table(spark, d, "predictions").select("pred_id", "input", "gold", "response"))
    return made.select("pred_id", F.col("chosen.value").alias("chosen"), F.col("rejected.value").alias("rejected"))


@query
def pair_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of all sources after the first of each conversation, counted by source."""
    given = table(spark, d, "dpo_train_2").select("pair_id", "conversations", "chosen", "rejected", "_source")
    made = pairs.from_predictions(table(spark, d, "predictions").select("pred_id", "input", "gold", "response"))
    return pairs.union_first([given, made], ["pair_id", "pred_id"]).groupBy("source_no", "_source").agg(F.count("*").alias("n"))


@query
def grpo_records(spark: SparkSession, d: str) -> DataFrame:
    return records.prompt_records(table(spark, d, "sft_train"))


@query
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    return records.chat_messages(table(spark, d, "sft_train")).select("row_id", F.element_at("messages", 1)["content"].alias("system"), reward.completion_text(F.col("messages")).alias("user"), F.size("messages").alias("messages"))


# scores


@query
def hard_jaccard_scores(spark: SparkSession, d: str) -> DataFrame:
    v = _valid_gold(spark, d)
    g, p = F.col("gold_symptoms"), F.col("pred_symptoms")
    return v.select("pred_id", F.round(jaccard(g, p), 6).alias("jaccard"), F.round(jaccard_strict(g, p), 6).alias("jaccard_strict"))


@query
def worded_symptom_scores(spark: SparkSession, d: str) -> DataFrame:
    return _valid_gold(spark, d).where("pred_reason = 'ok'").select("pred_id", F.round("worded_f1", 6).alias("f1"), F.round("worded_jaccard", 6).alias("jaccard"))


@query
def prediction_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_scored(spark, d), ["run_name"])


@query
def prediction_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counters(_scored(spark, d))


@query
def macro_f1_valid_only(spark: SparkSession, d: str) -> DataFrame:
    """Macro-F1 of urgency over valid answers only, beside the one over all."""
    v = _valid_labels(spark, d)
    both = v.groupBy("run_name").agg(metrics.macro_f1().alias("macro_f1_all"), metrics.macro_f1(F.col("pred_reason") == "ok").alias("macro_f1_valid"), F.count_if(F.col("pred_reason") == "ok").alias("valid"))
    return both.where("valid > 0").drop("valid")


@query
def classification_report_urgency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.classification_report(_valid_labels(spark, d).where("pred_reason = 'ok'"), "gold_urgency", "pred_urgency", constants.URGENCIES)


@query
def classification_report_department(spark: SparkSession, d: str) -> DataFrame:
    return metrics.classification_report(_valid_labels(spark, d).where("pred_reason = 'ok'"), "gold_department", "pred_department", constants.DEPARTMENTS)


@query
def confusion_urgency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_valid_labels(spark, d), "gold_urgency", "pred_label", [*constants.URGENCIES, metrics.BAD])


@query
def confusion_department(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_valid_labels(spark, d).where("pred_reason = 'ok'"), "gold_department", "pred_department", constants.DEPARTMENTS)


@query
def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    return metrics.comparison(_two_runs(spark, d))


@query
def top_regressions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.examples(_two_runs(spark, d), "regressed")


@query
def reward_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = reward.score(table(spark, d, "predictions").select("pred_id", "gold", "response"))
    return rows.select("pred_id", F.round("reward", 6).alias("reward"))


@query
def semantic_soft_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Soft overlap of sets of vectors: four in a row are a set, the next four its prediction."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("set_id"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 8).alias("k"))
    return semantic.soft_jaccard(e.where("k < 4").drop("k"), e.where("k >= 4").drop("k"), threshold=0.1)
