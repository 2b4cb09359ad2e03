"""Queries of the training-data problems; each takes a session and a data folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import p1_lookalikes, p2_canonical, p3_defects, p4_overlap, p5_cutoff, p6_frequency, p7_packing, p8_mixing, p9_language
from labelforge.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "sft_train").select("row_id", "input", "output")
    inputs = p1_lookalikes.alike_pairs(train, "row_id", "input").select(F.lit("input").alias("field"), "row_id", "match_id")
    terms = p1_lookalikes.terms_looked_like(train, table(spark, sf_dir, "ref_terms")).select(F.lit("symptoms").alias("field"), "row_id", "match_id")
    return inputs.union(terms)


def p1_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complaint in its one consistent form."""
    train = table(spark, sf_dir, "sft_train").select("row_id", "input")
    return p1_lookalikes.canonical_column(train, "input", "canonical")


def p1_symptoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symptom occurrence of usable outputs in its one consistent form."""
    symptoms = p1_lookalikes.string_symptoms(table(spark, sf_dir, "sft_train"), "row_id").select(F.col("id").alias("row_id"), "symptom")
    return p1_lookalikes.canonical_column(symptoms, "symptom", "canonical")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_mapped(spark, sf_dir).drop("value")


def p2_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value that is no term, with the entry it means."""
    raw = table(spark, sf_dir, "teacher_raw").select("raw_id", "output")
    return p2_canonical.map_values(raw, table(spark, sf_dir, "ref_terms"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no entry, with their number of occurrences."""
    return p2_mapped(spark, sf_dir).where("term_id = -1").groupBy("field", "value").agg(F.count("*").alias("occurrences"))


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct symptom with its counts and mark."""
    return p6_frequency.term_frequencies(p6_frequency.record_terms(table(spark, sf_dir, "sft_train")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


def _cut_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pred = table(spark, sf_dir, "predictions").select(F.col("pred_id").alias("key"), "source", F.col("input").alias("prompt"), "response", "gold", "parsed")
    labels = pred.select(F.col("gold").alias("label")).union(pred.select("parsed"))
    return pred, p5_cutoff.cut_keys(pred.select("key", "source", "prompt", "response"), labels)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_predictions(spark, sf_dir)[1].select(F.col("key").alias("pred_id"))


def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, cut answers and their share per source (null is a source of its own)."""
    pred, cut = _cut_predictions(spark, sf_dir)
    per_source = pred.select("key", "source").join(cut.select("key", F.lit(1).alias("cut")), "key", "left").groupBy("source").agg(F.count("*").alias("answers"), F.count("cut").alias("cut"))
    return per_source.withColumn("share", F.round(F.col("cut") / F.col("answers"), 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, pairs = table(spark, sf_dir, "predictions"), table(spark, sf_dir, "dpo_train_2")
    labels = pred.select(F.col("gold").alias("label")).union(pred.select("parsed")).union(pairs.select("chosen.value"))
    dictionaries = p9_language.fit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return p3_defects.defective(p3_defects.answers_of(pred, pairs), labels, dictionaries)


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective records by table and defect."""
    return p3_found(spark, sf_dir).groupBy("table_name", "defect").agg(F.count("*").alias("records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_overlap.overlaps(table(spark, sf_dir, "sft_train").select("row_id", "input"), table(spark, sf_dir, "sft_valid").select("row_id", "input"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and source."""
    return p4_overlap.report(p4_found(spark, sf_dir), table(spark, sf_dir, "sft_valid"))


def p7_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which container every document, or part of one, lies in."""
    return p7_packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_packing.containers(p7_contents(spark, sf_dir))


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the program's dual bound, the gap to it, and the mean fill."""
    filled = p7_containers(spark, sf_dir).groupBy("container", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("used_tokens").alias("tokens"))
    filled = filled.withColumn("dual_bound", F.round(F.col("tokens") / F.col("capacity_tokens"), 4)).withColumn("gap", F.coalesce(F.round(F.try_divide(F.col("containers"), F.col("dual_bound")) - 1, 6), F.lit(0.0)))
    return filled.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return p8_mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return p8_mixing.shares(*p8_mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document or stretch."""
    return p9_language.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_language.corrections(p9_languages(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_inputs, p1_symptoms, p2_found, p2_mapped, p2_unmatched, p3_found, p3_share, p4_found, p4_report, p5_found, p5_share, p6_found, p6_terms, p7_contents, p7_containers, p7_summary, p8_mix, p8_shares, p9_found, p9_languages)}
