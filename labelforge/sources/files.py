"""JSON and JSONL files as frames with positions, and the sinks of reports and records."""

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.operators.pairs import without_internal


def read_json_array(spark: SparkSession, path: str, check_items: bool = True, check_root: bool = True) -> DataFrame:
    """``source, row_idx, value`` (VARIANT) of a file that holds one JSON array.

    A root that is no array raises, or is the only row without ``check_root``;
    with ``check_items`` an element that is no object raises. Large data belongs into JSONL or Parquet: an array is
    one record of its file.
    """
    whole = spark.read.option("multiLine", True).option("singleVariantColumn", "root").json(path)
    items = F.try_variant_get("root", "$", "array<variant>")
    other = F.raise_error(F.lit("the root is not a JSON array")) if check_root else F.array("root")
    checked = whole.withColumn("items", F.when(items.isNull(), other).otherwise(items))
    rows = checked.select(F.lit(os.path.basename(path)).alias("source"), F.posexplode("items").alias("row_idx", "value"))
    if check_items:
        is_object = F.try_variant_get("value", "$", "map<string,variant>").isNotNull()
        rows = rows.withColumn("value", F.when(is_object, F.col("value")).otherwise(F.raise_error(F.lit("an element is not a JSON object"))))
    return rows


def read_json_arrays(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files as one frame; ``file_no`` keeps their order, earlier files come first."""
    frames = [read_json_array(spark, p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def numbered(rows: DataFrame, place: str = "place") -> DataFrame:
    """``rows`` of a file scan with their position among all rows, by file name and offset, from 0.

    However the files were split into tasks: blocks are counted, the few counts
    summed up, and rows numbered within their block.
    """
    block = [F.col("__file"), F.col("__start")]
    # a task reads its blocks from front to back, so the id ascends within a block
    at = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    counts = rows.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")).groupBy(*block).agg(F.count("*").alias("__n"))
    before = counts.select(*block, (F.sum("__n").over(Window.orderBy(*block)) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*block).orderBy("__id")) - 1
    return at.withColumn("__own", own).join(before, ["__file", "__start"]).withColumn(place, F.col("__own") + F.col("__before")).drop("__file", "__start", "__id", "__own", "__before")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSONL file; blank lines are skipped, a malformed line raises."""
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Records as JSONL, nulls written, internal columns dropped; one file per task."""
    without_internal(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds records to a JSONL folder, for evaluations that write as they go."""
    without_internal(df).write.mode("append").option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str, most: int = 1000) -> None:
    """A small report as one pretty JSON file: an object for one row, else a list; larger results are refused."""
    rows = [json.loads(x) for x in df.limit(most + 1).toJSON().collect()]
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows; write records as JSONL")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(rows[0] if len(rows) == 1 else rows, out, ensure_ascii=False, indent=2)
        out.write("\n")


def write_scalars_csv(df: DataFrame, path: str) -> None:
    """Scalar columns of a small frame as one CSV file with a header; lists, maps and structs are left out."""
    scalar = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    df.select(*scalar).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSONL where the path ends so, else Parquet."""
    if path.endswith(".jsonl"):
        write_jsonl(df, path)
    else:
        without_internal(df).write.mode("overwrite").parquet(path)
