"""Problem 1: texts that look the same but differ in their characters.

Values are mapped to one form, grouped under the accent-sensitive and
case-sensitive Unicode collation in SQL, and each class gets one member as
canonical value, which is joined back: a member that already is in the mapped
form if there is one, then the smallest in binary order.

Sorting long texts by collation keys is dear, so classes are built only where
two different values share the letters and digits of their mapped form; no two
values that are equal under the collation differ in these.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions import jsonx
from labelforge.llm import lookalike
from labelforge.session import broadcast_few, cut_lineage

#: Copies that a hot text's pairs are spread over.
SALTS = 16


def _hashes(column: Column) -> list[Column]:
    """Two hashes that stand for a text in joins, so that long texts aren't shuffled."""
    return [F.xxhash64(column).alias("vid"), F.hash(column).alias("check")]


def class_members(values: DataFrame, column: str = "value") -> DataFrame:
    """``value, canonical, vid, check`` of values that look like another value.

    ``canonical`` is the class's chosen member. A value that nothing else looks
    like has no row; null values and values with nothing visible have none
    either. ``vid, check`` are hashes of the value.
    """
    spark = values.sparkSession
    mapped = values.select(F.col(column).alias("value")).where("value is not null").withColumn("mapped", lookalike.consistent(F.col("value"))).where("mapped <> ''")
    coarse = F.xxhash64(F.regexp_replace("mapped", r"[^\p{L}\p{N}]", "")).alias("coarse")
    keyed = cut_lineage(mapped.select("value", "mapped", coarse, F.xxhash64("value").alias("vid")))
    # copies of a value count once: least and greatest hash tell whether there are two values
    shared = keyed.groupBy("coarse").agg(F.min("vid").alias("lo"), F.max("vid").alias("hi")).where("lo <> hi").select("coarse")
    alike = cut_lineage(keyed.join(shared, "coarse", "left_semi").select("value", "mapped").distinct())
    classes = spark.sql(
        """
        SELECT min(struct(value <> mapped AS changed, value AS value)).value AS canonical, mapped COLLATE UNICODE AS look
        FROM {alike} GROUP BY mapped COLLATE UNICODE HAVING count(*) > 1
        """,
        alike=alike,
    )
    joined = spark.sql(
        """
        SELECT a.value, c.canonical
        FROM {alike} a JOIN {classes} c ON a.mapped COLLATE UNICODE = c.look
        """,
        alike=alike,
        classes=classes,
    )
    return cut_lineage(joined.select("value", "canonical", *_hashes(F.col("value"))))


def canonical_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``: the canonical member of each value's class.

    Null stays null; a text with nothing visible becomes ''. Other columns,
    whatever their names, and repeated rows are kept.
    """
    changed = class_members(df, column).where("canonical <> value").toDF("__value", "__canonical", "__vid", "__check")
    vid, check = _hashes(df[column])
    joined = df.join(changed, (vid == changed["__vid"]) & (check == changed["__check"]) & (df[column] == changed["__value"]), "left")
    blank = F.regexp_replace(df[column], r"[\p{Z}\p{C}\s]", "") == ""
    return joined.select(*[df[c] for c in df.columns], F.when(blank, "").otherwise(F.coalesce(changed["__canonical"], df[column])).alias(out))


def alike_pairs(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """Pairs of rows whose values look the same and are not identical.

    Returns ``row_id, match_id`` with the smaller id first. Pairs are made
    between different texts of a class first; only then are they expanded to
    the rows that hold these texts, with hot texts spread over salts.
    """
    members = class_members(rows, column)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    # texts and classes by two hashes each; a hot class is spread over salts
    side = lambda x, salt: members.select(F.xxhash64("canonical").alias("class"), F.hash("canonical").alias("class_check"), F.col("vid").alias(x), F.col("check").alias(f"{x}_check"), salt)
    pairs = side("a", F.pmod(F.col("vid"), F.lit(SALTS)).cast("int").alias("salt")).join(side("b", salts), ["class", "class_check", "salt"])
    pairs = pairs.where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("a_check") < F.col("b_check")))).select("a", "a_check", "b", "b_check")
    holders = rows.select(F.col(id_col).alias("id"), *_hashes(F.col(column)), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"))
    holders = cut_lineage(holders.join(members.select("vid", "check"), ["vid", "check"], "left_semi"))
    left = pairs.select("*", salts).join(holders.toDF("a", "a_check", "a_id", "salt"), ["a", "a_check", "salt"]).select("a_id", "b", "b_check", salts)
    both = left.join(holders.toDF("b", "b_check", "b_id", "salt"), ["b", "b_check", "salt"])
    return both.select(F.least("a_id", "b_id").alias("row_id"), F.greatest("a_id", "b_id").alias("match_id"))


def string_symptoms(rows: DataFrame, id_col: str, output: str = "output") -> DataFrame:
    """``id, symptom`` for every string in the symptoms list of outputs that are one JSON object."""
    items = jsonx.array_items(F.try_element_at(jsonx.object_map(jsonx.uni_strip(F.col(output))), F.lit("symptoms")))
    return rows.select(F.col(id_col).alias("id"), F.explode(items).alias("v")).select("id", jsonx.string_value(F.col("v")).alias("symptom")).where("symptom is not null")


def terms_looked_like(rows: DataFrame, terms: DataFrame, id_col: str = "row_id") -> DataFrame:
    """``row_id, match_id``: rows with a symptom that looks like a term without being it.

    ``terms`` is a fixed list of a few hundred names, which is broadcast; a long one is shuffled.
    """
    names = terms.where("field = 'symptoms'").select("term_id", "term")
    # what is a term already is no case, which also takes the hottest values out
    symptoms = string_symptoms(rows, id_col).join(broadcast_few(names), F.col("symptom") == names["term"], "left_anti")
    members = class_members(symptoms.select(F.col("symptom").alias("value")).union(names.select("term")).distinct()).select("value", "canonical")
    named = names.join(members, names["term"] == members["value"]).select("term_id", "term", "canonical")
    like = members.join(named, "canonical").where("value <> term").select("value", "term_id")
    # Spark takes what was parsed from VARIANT for much smaller than it is; it may not be broadcast
    return symptoms.hint("merge").join(like.hint("merge"), symptoms["symptom"] == like["value"]).select(F.col("id").alias("row_id"), F.col("term_id").alias("match_id")).distinct()

