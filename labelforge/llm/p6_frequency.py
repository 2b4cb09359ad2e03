"""Problem 6: occurrences and records of every distinct term, marked where useless.

Each record emits its terms, each marked where it is the first of its kind
there. Spark's hash aggregation combines these partially before the shuffle, so
a term in a third of all records arrives as one row per task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions import jsonx
from labelforge.session import cut_lineage

#: A term in at most so many records is rare.
RARE_RECORDS = 2
#: A term in more than this share of the records is common.
COMMON_SHARE = 0.05


def record_terms(rows: DataFrame, output: str = "output") -> DataFrame:
    """``terms``: the decoded symptom strings of each usable record, also of those that hold none.

    A record is usable if its output, blanks around it aside, is one JSON
    object. Terms are neither trimmed nor folded; elements that are no strings
    are no terms, an empty string is one.
    """
    obj = jsonx.settled(rows.select(output), o=jsonx.object_map(jsonx.uni_strip(F.col(output)))).where("o is not null")
    items = jsonx.array_items(F.try_element_at("o", F.lit("symptoms")))
    strings = F.filter(F.transform(items, jsonx.string_value), lambda t: t.isNotNull())
    return obj.select(F.coalesce(strings, F.array().cast("array<string>")).alias("terms"))


def term_frequencies(records: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """``term, occurrences, records, mark`` from a frame with an array column ``terms``.

    ``mark`` is 'rare', 'common' or null. No records give no rows.
    """
    # sorted, so that a term's first occurrence in its record is told by the one before it
    ordered = records.select(F.array_sort("terms").alias("terms"))
    marked = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.when(F.get("terms", i - 1).eqNullSafe(t), 0).otherwise(1).alias("first")))
    # a null beside the terms of each record counts the records, so that nothing is read twice
    every = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("first")))
    counted = ordered.select(F.inline(F.concat(marked, every)))
    sums = cut_lineage(counted.groupBy("term").agg(F.count("*").alias("occurrences"), F.sum("first").alias("records")))
    total = sums.where("term is null").select(F.col("records").alias("all_records"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("all_records"), "common")
    one = F.lit(1).alias("one")
    return sums.where("term is not null").select("*", one).join(F.broadcast(total.select("*", one)), "one").select("term", "occurrences", "records", mark.alias("mark"))
