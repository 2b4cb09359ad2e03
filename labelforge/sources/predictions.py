"""Prediction logs as JSONL, whose records name their fields in several ways."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions import jsonx
from labelforge.sources import files


def text_of(v: Column) -> Column:
    """A JSON string's text, or any other value as JSON text; null for JSON null and a missing value."""
    kind = F.schema_of_variant(v)
    return F.when(jsonx.is_string(v), jsonx.string_value(v)).when(kind != "VOID", F.to_json(v))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx, run_name, idx, input, gold, response`` of a prediction log.

    ``gold`` falls back to ``output`` where it holds no object. The answer is
    ``parsed_prediction`` if a record has that key, even null, else ``parsed``;
    where it is null, ``response`` is read. ``pred_id`` is the record's place in the log,
    however the file is split; ``idx`` is its own or its place.
    A malformed line raises; blank lines are skipped.
    """
    lines = spark.read.option("singleVariantColumn", "v").option("mode", "FAILFAST").json(path)
    record = files.numbered(lines).select(F.try_variant_get("v", "$", "map<string,variant>").alias("r"), "place")
    at = lambda k: F.try_element_at("r", F.lit(k))
    parsed = F.when(F.array_contains(F.map_keys("r"), "parsed_prediction"), text_of(at("parsed_prediction"))).otherwise(text_of(at("parsed")))
    gold = text_of(at("gold"))
    gold = F.when(jsonx.object_map(jsonx.strip_fences(gold)).isNull() & at("output").isNotNull(), text_of(at("output"))).otherwise(gold)
    return record.select(
        F.col("place").alias("pred_id"),
        F.element_at(F.split(F.lit(path), "/"), -1).alias("run_name"),
        F.coalesce(F.try_variant_get(at("idx"), "$", "bigint"), F.col("place")).alias("idx"),
        text_of(at("input")).alias("input"),
        gold.alias("gold"),
        F.coalesce(parsed, text_of(at("response"))).alias("response"),
    )
