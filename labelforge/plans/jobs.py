"""Whole jobs from files to files; each returns its report as a frame."""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import constants
from labelforge.functions import jsonx
from labelforge.operators import clean, metrics, pairs, records, validate
from labelforge.session import cut_lineage
from labelforge.sources import files, predictions


PAIR_SCHEMA = "conversations array<struct<`from`:string,value:string>>, chosen struct<`from`:string,value:string>, rejected struct<`from`:string,value:string>, _source string"


def raw_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of JSON array, JSONL or Parquet files (``input, output``) in the shape that cleaning takes; a JSON output may be a text or an object."""
    frames = []
    for path in paths:
        name = F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("source_file")
        if path.rstrip("/").endswith(".parquet"):
            read = files.numbered(spark.read.parquet(path), "row_idx").select("row_idx", "input", "output")
        else:
            if path.rstrip("/").endswith(".jsonl"):
                records = files.numbered(spark.read.option("singleVariantColumn", "value").option("mode", "FAILFAST").json(path), "row_idx")
            else:
                records = files.read_json_array(spark, path)
            at = lambda k: F.try_element_at(F.try_variant_get("value", "$", "map<string,variant>"), F.lit(k))
            read = records.select("row_idx", jsonx.string_value(at("input")).alias("input"), predictions.text_of(at("output")).alias("output"))
        place = F.col("row_idx").cast("bigint")
        frames.append(read.select(place.alias("raw_id"), name, place.alias("row_idx"), "input", "output"))
    return functools.reduce(DataFrame.union, frames)


def clean_files(spark: SparkSession, paths: list[str], output_dir: str, valid_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Cleans raw files into ``all``, ``train`` and ``valid`` JSONL and reports.

    Files are JSON arrays, each read in one task, or JSONL or Parquet, which
    Spark splits. ``report.json`` has the fixed counters; ``counters`` is a
    folder of all, as those of typed values grow with the data.
    """
    names = [p.rsplit("/", 1)[-1] for p in paths]
    normalised = cut_lineage(clean.normalise(clean.in_order(raw_rows(spark, paths), names)))
    rows = clean.first_wins(clean.kept(normalised), ["clean_input"])
    rows = cut_lineage(clean.split(rows, F.col("clean_input"), "raw_id", valid_ratio, seed).select(F.lit(constants.STRONG_PROMPT).alias("instruction"), F.col("clean_input").alias("input"), F.col("clean_output").alias("output"), "split"))
    files.write_jsonl(rows.drop("split"), f"{output_dir}/all.jsonl")
    for part in ("train", "valid"):
        files.write_jsonl(rows.where(F.col("split") == part).drop("split"), f"{output_dir}/{part}.jsonl")
    report = clean.statistics(normalised)
    files.write_jsonl(report, f"{output_dir}/counters")
    fixed = report.where(~F.col("stat").rlike("^(map_department|drop_unknown_department):"))
    files.write_report(fixed.orderBy("stat"), f"{output_dir}/report.json", most=len(paths) + 100)
    return report


def build_pairs(spark: SparkSession, train: DataFrame, logs: list[str], output_dir: str, max_synthetic: int | None = 1000, min_jaccard: float = 0.5, valid_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Made-up pairs of ``train`` and errors of prediction logs, first of each conversation, split and written.

    ``max_synthetic`` 0 leaves the made-up pairs out, None takes all. Returns counts per split and source.
    """
    sources, ids = [], []
    if max_synthetic != 0:
        sources.append(pairs.synthetic(train, seed, max_synthetic))
        ids.append("row_id")
    for path in logs:
        sources.append(pairs.from_predictions(predictions.read_log(spark, path), min_jaccard))
        ids.append("pred_id")
    both = pairs.union_first(sources, ids)
    key = F.to_json("conversations")
    rows = cut_lineage(clean.split(both, key, "source_id", valid_ratio, seed))
    for part in ("train", "valid"):
        files.write_jsonl(rows.where(F.col("split") == part).select("conversations", "chosen", "rejected"), f"{output_dir}/dpo_{part}.jsonl")
    return rows.groupBy("split", "_source").agg(F.count("*").alias("n"))


def filter_hard_files(spark: SparkSession, folder: str, output_dir: str, splits: tuple[str, ...] = ("train", "valid")) -> DataFrame:
    """:func:`filter_hard_pairs` of ``dpo_{split}.jsonl`` in a folder; counts per split, a missing file is skipped and counts nothing."""
    counts = spark.createDataFrame([], "split string, filter_reason string, keep boolean, n bigint")
    for split in splits:
        path = f"{folder}/dpo_{split}.jsonl"
        if files.exists(spark, path):
            rows = files.numbered(files.read_jsonl(spark, path, PAIR_SCHEMA), "pair_id")
            counts = counts.union(filter_hard_pairs(rows, f"{output_dir}/dpo_{split}_hard.jsonl").select(F.lit(split), "filter_reason", "keep", "n"))
    return counts


def filter_hard_pairs(pair_rows: DataFrame, path: str) -> DataFrame:
    """Writes the pairs whose department or urgency differ; returns the counts of all reasons."""
    judged = cut_lineage(validate.hard_pairs(validate.pair_diffs(pair_rows)))
    kept = pair_rows.join(judged.where("keep").select("pair_id").hint("merge"), "pair_id", "left_semi")
    files.write_jsonl(kept.drop("pair_id"), path)
    return judged.groupBy("filter_reason", "keep").agg(F.count("*").alias("n"))


def validate_frames(rows: DataFrame | None, pair_rows: DataFrame | None) -> DataFrame:
    """``kind, num_rows, num_errors, passed`` of training rows and of pairs, and ``all`` for both."""
    parts = []
    if rows is not None:
        one = validate.report(rows.withColumn("kind", F.lit("sft")), "kind")
        parts.append(one.select("kind", "num_rows", "num_errors"))
    if pair_rows is not None:
        diffs = validate.pair_diffs(pair_rows)
        parts.append(diffs.agg(F.lit("dpo").alias("kind"), F.count("*").alias("num_rows"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("num_errors")))
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    total = both.agg(F.lit("all").alias("kind"), F.sum("num_rows").alias("num_rows"), F.sum("num_errors").alias("num_errors"))
    return both.union(total).withColumn("passed", F.col("num_errors") == 0)


def metrics_of_log(spark: SparkSession, path: str) -> DataFrame:
    """All metrics of a prediction log; rows without a readable gold label are left out uncounted."""
    log = predictions.read_log(spark, path)
    return metrics.summary(metrics.scored(log), ["run_name"])


def compare_logs(spark: SparkSession, base: str, candidate: str) -> DataFrame:
    """Two prediction logs side by side, by position, as far as the shorter one goes; rows without a valid gold label count as wrong."""
    both = predictions.read_log(spark, base).withColumn("run_name", F.lit("base")).union(predictions.read_log(spark, candidate).withColumn("run_name", F.lit("candidate")))
    return metrics.comparison(metrics.paired(metrics.positioned(both.withColumn("idx", F.col("pred_id"))), "base", "candidate"))


def prompt_file(rows: DataFrame, path: str) -> None:
    """Prompt records as JSONL or Parquet, by the path's ending."""
    files.write_records(records.prompt_records(rows).drop("row_id"), path)
