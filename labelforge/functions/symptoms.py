"""Column functions over lists of symptoms. Null lists count as empty unless said otherwise."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge import constants
from labelforge.functions.jsonx import is_string, settled, string_value, uni_strip


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def schema_symptoms(items: Column) -> Column:
    """Trimmed distinct strings in first-seen order; null if an element is no string, or nothing is left."""
    clean = F.array_distinct(F.filter(F.transform(items, lambda v: uni_strip(string_value(v))), lambda s: s != ""))
    return F.when(F.forall(items, is_string) & (F.size(clean) > 0), clean)


def wording(symptom: Column) -> Column:
    """A symptom without spaces and stops, in the wording that scores compare."""
    bare = F.translate(uni_strip(symptom), " ，,。.", "")
    return F.coalesce(F.try_element_at(literal_map(constants.SYMPTOM_WORDING), bare), bare)


def worded(symptoms: Column) -> Column:
    """List of wordings, blanks dropped, repeats kept."""
    return F.filter(F.transform(F.coalesce(symptoms, F.array().cast("array<string>")), wording), lambda s: s != "")


def _shown(symptoms: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(symptoms, F.array().cast("array<string>")), uni_strip), lambda s: s != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct trimmed items; 1 if both lists are empty."""
    x, y = _shown(a), _shown(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0)))


def jaccard_strict(gold: Column, pred: Column) -> Column:
    """As :func:`jaccard`, but a missing prediction scores 0 even against an empty gold list."""
    return F.when(pred.isNull(), 0.0).otherwise(jaccard(gold, pred))


def greedy_hits(gold: Column, pred: Column) -> Column:
    """Predictions that find a gold item not yet used, in order: equal, or one within the other if both have two characters."""

    def step(acc: Column, x: Column) -> Column:
        def fits(y: Column, i: Column) -> Column:
            near = (F.length(x) >= 2) & (F.length(y) >= 2) & (F.contains(x, y) | F.contains(y, x))
            return F.when(~F.array_contains(acc["used"], i) & ((x == y) | near), i)

        first = F.array_min(F.transform(gold, fits))
        return F.when(first.isNull(), acc).otherwise(F.struct((acc["hits"] + 1).alias("hits"), F.concat(acc["used"], F.array(first)).alias("used")))

    start = F.struct(F.lit(0).alias("hits"), F.array().cast("array<int>").alias("used"))
    return F.aggregate(pred, start, step, lambda acc: acc["hits"])


def with_worded_scores(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Adds ``worded_f1, worded_jaccard`` of distinct wordings matched by :func:`greedy_hits`.

    Two empty lists score 1, one empty list 0. ``gold_worded`` and
    ``pred_worded`` keep the wordings with repeats.
    """
    lists = settled(df, gold_worded=worded(F.col(gold)), pred_worded=worded(F.col(pred)))
    lists = settled(lists, __g=F.array_distinct("gold_worded"), __p=F.array_distinct("pred_worded"))
    counted = settled(lists, __hits=greedy_hits(F.col("__g"), F.col("__p")).cast("double"))
    hits, ng, np_ = F.col("__hits"), F.size("__g"), F.size("__p")
    both = (ng == 0) & (np_ == 0)
    precision, recall = F.try_divide(hits, np_), F.try_divide(hits, ng)
    f1 = F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0)))
    near = F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(hits, ng + np_ - hits), F.lit(0.0)))
    return counted.withColumn("worded_f1", f1).withColumn("worded_jaccard", near).drop("__g", "__p", "__hits")
