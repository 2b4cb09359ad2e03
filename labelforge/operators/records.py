"""Prompt and chat records for trainers, and the interface for batch inference."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge import constants


def prompt_records(rows: DataFrame) -> DataFrame:
    """``prompt, output, input``: instruction and input in two lines; nulls become empty texts."""
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("row_id", F.concat(t("instruction"), F.lit("\n"), t("input")).alias("prompt"), t("output").alias("output"), t("input").alias("input"))


def chat_messages(rows: DataFrame, strong: bool = False) -> DataFrame:
    """``messages``: a system and a user message; the row's instruction or the strong prompt."""
    system = F.lit(constants.STRONG_PROMPT) if strong else F.coalesce("instruction", F.lit(constants.STRONG_PROMPT))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select("row_id", F.array(message("system", system), message("user", F.coalesce("input", F.lit("")))).alias("messages"))


def with_answers(rows: DataFrame, predict: Callable[[pd.Series], pd.Series], column: str = "prompt", most: int | None = None, place: str = "row_id") -> DataFrame:
    """Adds ``response`` by a batch function, which loads its model inside the task. No model is shipped.

    ``most`` answers only the first rows by ``place``, for a quick look.
    """
    if most is not None:
        rows = rows.orderBy(place).limit(most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(response=predict(frame[column]))

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("response", T.StringType())]))
