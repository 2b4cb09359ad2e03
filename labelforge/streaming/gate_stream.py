"""The label gate and scores over files as they arrive, with Structured Streaming."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelforge.operators import gate
from labelforge.sources.files import append_jsonl


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def reasons_by_window(labels: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Counts per event-time window and reason; rows later than the watermark are dropped by Spark."""
    judged = gate.with_label(labels, "output", "label")
    return judged.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"), "label_reason").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("label_reason").alias("reason"), "n")


def append_scored(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of answers, judged, is added to a JSONL folder."""
    judged = gate.with_label(answers, "response", "pred")
    return judged.writeStream.foreachBatch(lambda batch, _: append_jsonl(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
