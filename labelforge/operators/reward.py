"""A rule-based score of an answer against a gold label, as one column expression."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge import constants
from labelforge.functions.symptoms import literal_map, with_worded_scores
from labelforge.operators import gate


def completion_text(messages: Column) -> Column:
    """Text of the last message of a chat; null for no messages."""
    return F.try_element_at(messages, F.lit(-1))["content"]


def score(rows: DataFrame, answer: str = "response", gold: str = "gold") -> DataFrame:
    """Adds ``reward`` in [-1, 1]: 0 for an invalid gold label, -1 unreadable, -0.5 invalid.

    A valid answer earns a weighted sum of form, department, urgency and
    symptoms, less penalties for repeats, long lists, fences and missed high
    urgency, added in this order.
    """
    both = gate.with_label(gate.with_label(rows, gold, "gold"), answer, "pred")
    fenced = F.contains(F.col(answer), F.lit("```"))
    both = with_worded_scores(both, "gold_symptoms", "pred_symptoms").withColumnsRenamed({"worded_f1": "__f1", "pred_worded": "__p", "gold_worded": "__g"})
    gu, pu = F.col("gold_urgency"), F.col("pred_urgency")
    off = lambda cond, by: F.when(cond, F.lit(-by)).otherwise(F.lit(0.0))
    penalty = (
        F.lit(0.0)
        + off(F.size("__p") != F.size(F.array_distinct("__p")), 0.05)
        + off(F.size("__p") > F.greatest(F.lit(6), F.size("__g") + 3), 0.05)
        + off(fenced, 0.05)
        + F.when((gu == "高") & (pu == "低"), F.lit(-0.4)).when((gu == "高") & (pu == "中"), F.lit(-0.1)).otherwise(F.lit(0.0))
    )
    urgency = F.coalesce(F.try_element_at(literal_map(constants.URGENCY_SCORE), F.concat(gu, F.lit(">"), pu)), F.lit(0.0))
    total = F.lit(0.05) * F.when(fenced, 0.8).otherwise(1.0) + F.lit(0.25) * (F.col("gold_department") == F.col("pred_department")).cast("double") + F.lit(0.30) * urgency + F.lit(0.40) * F.col("__f1") + penalty
    reward = F.when(F.col("gold_reason") != "ok", 0.0).when(~F.col("pred_parsed"), -1.0).when(F.col("pred_reason") != "ok", -0.5).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)))
    return both.withColumn("reward", reward).drop("__f1", "__p", "__g", "worded_jaccard")
