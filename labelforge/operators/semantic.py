"""Soft overlap of two sets of vectors by cosine similarity."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of the same length; null if either is null, empty or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def soft_jaccard(gold: DataFrame, pred: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``set_id, golds, preds, hits, soft_jaccard`` of small sets (set_id, item_id, vec).

    Every predicted item votes for its nearest gold item of the same set; a
    gold item that at least one close enough vote reaches is a hit. Sets are
    lists of one record, so pairs within a set stay few.
    """
    sims = pred.alias("p").join(gold.alias("g"), "set_id").select("set_id", F.col("p.item_id").alias("p"), F.col("g.item_id").alias("g"), cosine(F.col("p.vec"), F.col("g.vec")).alias("sim"))
    votes = sims.groupBy("set_id", "p").agg(F.max(F.struct("sim", (-F.col("g")).alias("g"))).alias("best"))
    hits = votes.where(F.col("best.sim") >= threshold).groupBy("set_id").agg(F.countDistinct("best.g").alias("hits"))
    sizes = gold.groupBy("set_id").agg(F.count("*").alias("golds")).join(pred.groupBy("set_id").agg(F.count("*").alias("preds")), "set_id", "full").na.fill(0)
    out = sizes.join(hits, "set_id", "left").na.fill(0)
    score = F.when((F.col("golds") == 0) & (F.col("preds") == 0), 1.0).otherwise(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("golds") + F.col("preds") - F.col("hits")), F.lit(0.0)))
    return out.select("set_id", "golds", "preds", "hits", F.round(score, 6).alias("soft_jaccard"))
