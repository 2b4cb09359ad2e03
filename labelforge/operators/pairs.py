"""Preference pairs: made-up wrong labels, errors of saved predictions, union, duplicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge import constants
from labelforge.functions.jsonx import settled
from labelforge.functions.symptoms import jaccard, literal_map
from labelforge.operators import gate
from labelforge.operators.clean import first_wins, lowest


def record(instruction: Column, asked: Column, chosen: Column, rejected: Column, source: str) -> list[Column]:
    """The columns of a preference pair; internal ones start with an underscore."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return [F.array(turn("system", F.coalesce(instruction, F.lit(constants.STRONG_PROMPT))), turn("user", F.coalesce(asked, F.lit("")))).alias("conversations"), turn("assistant", chosen).alias("chosen"), turn("assistant", rejected).alias("rejected"), F.lit(source).alias("_source")]


def draw(seed: int, use: str, key: Column) -> Column:
    """A number in [0, 1) from a seed, a use and a key; the same wherever and whenever it is drawn."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{use}|"), key)), 1, 8), 16, 10).cast("double") / 4294967296.0


def synthetic(rows: DataFrame, seed: int = 42, most: int | None = None) -> DataFrame:
    """Pairs whose rejected label has a confusable department, another urgency or a symptom less.

    Two in five get a department, three in ten an urgency, the rest lose a
    symptom if they have several (else the pair has no difference). Rows with
    invalid labels give none; ``most`` keeps the first by hash rank.
    """
    v = gate.with_label(rows, "output", "gold").where("gold_reason = 'ok'")
    d, u, s = F.col("gold_department"), F.col("gold_urgency"), F.col("gold_symptoms")
    key = F.col("row_id").cast("string")
    r = draw(seed, "kind", key)
    other = F.try_element_at(literal_map(constants.CONFUSABLE), d)
    flipped = F.when(u == "高", "低").when(u == "低", "高").when(draw(seed, "flip", key) < 0.5, "高").otherwise("低")
    lost = F.floor(draw(seed, "drop", key) * F.size(s)).cast("int")
    fewer = F.when(F.size(s) >= 2, F.filter(s, lambda x, i: i != lost)).otherwise(s)
    by_dept, by_urgency = (r < 0.4) & other.isNotNull(), r < 0.7
    rejected = gate.compact(F.when(by_dept, other).otherwise(d), F.when(~by_dept & by_urgency, flipped).otherwise(u), F.when(~by_dept & ~by_urgency, fewer).otherwise(s))
    out = v.select("row_id", *record(F.col("instruction"), F.col("input"), gate.compact(d, u, s), rejected, "synthetic"))
    if most is not None:
        out = lowest(out, F.col("row_id").cast("string"), "row_id", lambda n: min(n, most), seed).where("lowest").drop("lowest")
    return out


def from_predictions(predictions: DataFrame, min_jaccard: float = 0.5) -> DataFrame:
    """Pairs of gold and a wrong answer: unreadable answers as they are, invalid ones, and meaningful errors.

    An error is meaningful if department or urgency differ or the symptoms
    share less than ``min_jaccard``. Rows with invalid gold or a null answer
    give none.
    """
    both = gate.with_label(gate.with_label(predictions.where("response is not null"), "gold", "gold"), "response", "pred").where("gold_reason = 'ok'")
    wrong = (F.col("gold_department") != F.col("pred_department")) | (F.col("gold_urgency") != F.col("pred_urgency")) | (jaccard(F.col("gold_symptoms"), F.col("pred_symptoms")) < min_jaccard)
    rejected = F.when(F.col("pred_reason") != "ok", F.col("response")).when(wrong, gate.compact(F.col("pred_department"), F.col("pred_urgency"), F.col("pred_symptoms")))
    gold = gate.compact(F.col("gold_department"), F.col("gold_urgency"), F.col("gold_symptoms"))
    return settled(both, __r=rejected).where("__r is not null").select("pred_id", *record(F.lit(None).cast("string"), F.col("input"), gold, F.col("__r"), "prediction_errors"))


def union_first(sources: list[DataFrame], ids: list[str]) -> DataFrame:
    """All pairs of several sources, the first of each conversation by source order, then id."""
    parts = [df.select(F.lit(i).alias("source_no"), F.col(name).alias("source_id"), "conversations", "chosen", "rejected", "_source") for i, (df, name) in enumerate(zip(sources, ids, strict=True))]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    # two hashes stand for a conversation, so that keys are short
    text = F.to_json("conversations")
    keyed = both.withColumn("place", F.struct("source_no", "source_id")).withColumn("__hash", F.xxhash64(text)).withColumn("__check", F.sha1(text))
    return first_wins(keyed, ["__hash", "__check"]).drop("place", "__hash", "__check")


def without_internal(df: DataFrame) -> DataFrame:
    """Columns whose names start with an underscore are dropped before a sink."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])
