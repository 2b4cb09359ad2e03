"""Cleaning of raw labels: rules with reasons, first-wins duplicates, deterministic split, report."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge import constants
from labelforge.functions import jsonx
from labelforge.functions.symptoms import literal_map, schema_symptoms
from labelforge.operators import gate
from labelforge.session import cut_lineage

#: Hex digits of a hash that form a bucket when rows are ranked by hash.
BUCKET_DIGITS = 3
#: Rows of a bucket that may be sorted together.
SORTED_ROWS = 20_000


def normalise(rows: DataFrame, text: str = "output", asked: str = "input") -> DataFrame:
    """Adds ``drop_reason`` (null for kept rows), ``rename`` and the clean parts and ``clean_output``.

    Rules apply in order and the first that fails names the reason; a rename
    is recorded even if a later rule drops the row. Extra keys are allowed.
    """
    at = lambda k: F.try_element_at("__o", F.lit(k))
    has = lambda k: F.coalesce(F.array_contains(F.map_keys("__o"), k), F.lit(False))
    o = rows.withColumn("__o", gate.parsed(F.col(text)))
    o = jsonx.settled(
        o,
        clean_input=jsonx.uni_strip(F.col(asked)),
        __object=F.col("__o").isNotNull(),
        __keys=has("department") & has("urgency") & has("symptoms"),
        __typed=jsonx.uni_strip(jsonx.string_value(at("department"))),
        clean_urgency=jsonx.uni_strip(jsonx.string_value(at("urgency"))),
        clean_symptoms=schema_symptoms(jsonx.array_items(at("symptoms"))),
    )
    typed = F.col("__typed")
    o = jsonx.settled(o, clean_department=F.coalesce(F.try_element_at(literal_map(constants.RENAMED_DEPARTMENTS), typed), typed))
    blank = F.coalesce(F.col("clean_input"), F.lit("")) == ""
    why = (
        F.when(blank, "drop_bad_input")
        .when(~F.col("__object"), "drop_bad_json")
        .when(~F.col("__keys"), "drop_missing_keys")
        .when(typed.isNull(), "drop_bad_department_type")
        .when(F.col("clean_department").isin(constants.DROPPED_DEPARTMENTS), F.concat(F.lit("drop_department:"), F.col("clean_department")))
        .when(~F.col("clean_department").isin(constants.DEPARTMENTS), F.concat(F.lit("drop_unknown_department:"), F.col("clean_department")))
        .when(~F.coalesce(F.col("clean_urgency").isin(constants.URGENCIES), F.lit(False)), "drop_bad_urgency")
        .when(F.col("clean_symptoms").isNull(), "drop_bad_symptoms")
    )
    renamed = F.when(~blank & F.col("__keys") & (typed != F.col("clean_department")), F.concat(F.lit("map_department:"), typed, F.lit("->"), F.col("clean_department")))
    o = jsonx.settled(o, drop_reason=why, rename=renamed)
    output = F.when(F.col("drop_reason").isNull(), gate.compact(F.col("clean_department"), F.col("clean_urgency"), F.col("clean_symptoms")))
    return jsonx.settled(o, clean_output=output).drop("__o", "__object", "__keys", "__typed")


def in_order(raw: DataFrame, files: list[str] = constants.RAW_FILES) -> DataFrame:
    """Adds ``place``: files by priority (others last, by name), then position."""
    number = F.coalesce(F.try_element_at(literal_map({f: i for i, f in enumerate(files)}), F.col("source_file")), F.lit(len(files)))
    return raw.withColumn("place", F.struct(number.alias("file_no"), F.col("source_file"), F.col("row_idx"), F.col("raw_id")))


def kept(normalised: DataFrame) -> DataFrame:
    return normalised.where("drop_reason is null")


def first_wins(rows: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """The first row of each key. Spark keeps one candidate per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(place))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def duplicate_counts(rows: DataFrame, key: str = "clean_input", value: str = "clean_output", place: str = "place") -> DataFrame:
    """Per key held more than once: rows, duplicates, and conflicts with the first row's value.

    Rows are aggregated by key and value first, so a hot key costs no more than its distinct values.
    """
    per_value = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(place).alias("at"))
    per_key = per_value.groupBy(key).agg(F.sum("n").alias("rows"), F.min(F.struct("at", "n")).alias("first"))
    out = per_key.where("rows > 1")
    return out.select(key, "rows", (F.col("rows") - 1).alias("duplicates"), (F.col("rows") - F.col("first.n")).alias("conflicts"))


def hash_ranked(rows: DataFrame, key: Column, tie: str, seed: int = 42) -> DataFrame:
    """Adds ``hash_rank`` from 1: rows by a seeded hash of the key, ties by ``tie``.

    A global rank without a global sort: rows are counted per hash bucket, the
    few thousand counts are summed up, and only rows of one bucket are sorted together.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}|"), key))).withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    sizes = hashed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__b")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy("__h", tie))
    ranked = hashed.withColumn("__own", own).join(F.broadcast(before), "__b")
    return ranked.withColumn("hash_rank", F.col("__own") + F.col("__before")).drop("__h", "__b", "__own", "__before")


def lowest(rows: DataFrame, key: Column, tie: str, size: Callable[[int], int], seed: int = 42) -> DataFrame:
    """Adds ``lowest``: whether a row is among the ``size(n)`` of all ``n`` rows with the lowest seeded hash of the key, ties by ``tie``.

    ``rows`` are written once. Their hashes are counted by their first digits, at
    most 16**BUCKET_DIGITS counts, then within the bucket where the cut falls,
    until that is small; only its rows are sorted. Nothing else is shuffled.
    Rows alike in hash and ``tie`` fall on the same side.
    """
    hashed = cut_lineage(rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key, F.lit(""))))))
    wanted, prefix, before, held = None, "", 0, 0
    while wanted is None or held > SORTED_ROWS and len(prefix) + BUCKET_DIGITS <= 32:
        part = F.substring("__h", len(prefix) + 1, BUCKET_DIGITS).alias("part")
        counts = sorted((r["part"], r["count"]) for r in hashed.where(F.col("__h").startswith(prefix)).groupBy(part).count().collect())
        if wanted is None:
            wanted = size(sum(n for _, n in counts))
            if wanted <= 0 or not counts:
                return hashed.drop("__h").withColumn("lowest", F.lit(False))
        for part, held in counts:
            if before + held >= wanted or part == counts[-1][0]:
                break
            before += held
        prefix += part
    place = F.struct(F.col("__h"), F.col(tie).alias("tie"))
    last = hashed.where(F.col("__h").startswith(prefix)).select(place.alias("place")).orderBy("place").limit(wanted - before).agg(F.max("place").alias("place")).first()["place"]
    same = F.col("__h") == last["__h"]
    return hashed.withColumn("lowest", (F.col("__h") < last["__h"]) | (same & (F.col(tie) <= F.lit(last["tie"])))).drop("__h")


def split(rows: DataFrame, key: Column, tie: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: 'valid' for max(1, round half even of n * ratio) rows, 'train' for the rest."""
    marked = lowest(rows, key, tie, lambda n: max(1, round(n * ratio)), seed)
    return marked.withColumn("split", F.when(F.col("lowest"), "valid").otherwise("train")).drop("lowest")


def value_counts(rows: DataFrame, column: str, place: str = "place") -> DataFrame:
    """Counts of a column, most first, ties by first appearance."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(place).alias("__at")).orderBy(F.desc("n"), "__at").drop("__at")


def statistics(normalised: DataFrame) -> DataFrame:
    """Every counter of a cleaning run as ``stat, n``: sources, renames, drops, duplicates, conflicts."""
    labels = normalised.select(F.explode(F.array_compact(F.array(F.concat(F.lit("source_rows:"), F.col("source_file")), F.col("rename"), F.col("drop_reason")))).alias("stat"))
    counted = labels.groupBy("stat").agg(F.count("*").alias("n"))
    sums = duplicate_counts(kept(normalised)).agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("d"), F.coalesce(F.sum("conflicts"), F.lit(0)).alias("c"))
    both = sums.select(F.explode(F.array(F.struct(F.lit("drop_duplicate_input").alias("stat"), F.col("d").alias("n")), F.struct(F.lit("duplicate_output_conflicts").alias("stat"), F.col("c").alias("n")))).alias("s")).select("s.stat", "s.n")
    return counted.union(both)


def clean(raw: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """The whole cleaning: rules, first-wins duplicates and split, as ``instruction``-less rows."""
    rows = first_wins(kept(normalise(in_order(raw))), ["clean_input"])
    return split(rows, F.col("clean_input"), "raw_id", ratio, seed)
