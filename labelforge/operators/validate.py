"""Validation of training rows and preference pairs: errors as rows, reports as frames."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge import constants
from labelforge.functions import jsonx
from labelforge.operators import gate

PREVIEW_ERRORS, PREVIEW_CHARS = 50, 200


def _blank(c: Column) -> Column:
    return F.coalesce(jsonx.uni_strip(c), F.lit("")) == ""


def row_errors(rows: DataFrame, id_col: str = "row_id", every: bool = False) -> DataFrame:
    """``row_id, error`` of instruction/input/output rows; a row may have several.

    By default the output gives its first failing test only, read without
    fences; with ``every`` all failing fields of a strictly read output count.
    """
    out = F.col("output")
    fenced = F.contains(out, F.lit("```"))
    base = rows.withColumn("__o", gate.parsed(out, "strict" if every else "full"))
    first = [
        F.when(_blank(F.col("instruction")), "bad_instruction"),
        F.when(_blank(F.col("input")), "bad_input"),
        F.when(_blank(out), "bad_output_text"),
        F.when(fenced, "markdown_fence_in_output"),
    ]
    if every:
        items = jsonx.array_items(F.try_element_at("__o", F.lit("symptoms")))
        given, obj = ~_blank(out), F.col("__o").isNotNull()
        errors = [
            *first,
            F.when(given & ~obj, "output_not_object"),
            F.when(obj & (F.array_sort(F.map_keys("__o")) != F.array(*[F.lit(k) for k in sorted(constants.LABEL_KEYS)])), "bad_output_keys"),
            F.when(obj & ~F.coalesce(jsonx.string_value(F.try_element_at("__o", F.lit("department"))).isin(constants.DEPARTMENTS), F.lit(False)), "bad_department"),
            F.when(obj & ~F.coalesce(jsonx.string_value(F.try_element_at("__o", F.lit("urgency"))).isin(constants.URGENCIES), F.lit(False)), "bad_urgency"),
            F.when(obj & (F.coalesce(F.size(items), F.lit(0)) <= 0), "bad_symptoms"),
            F.when(obj & F.coalesce(F.exists(items, lambda v: ~jsonx.is_string(v) | _blank(jsonx.string_value(v))), F.lit(False)), "bad_symptom_item"),
        ]
    else:
        base = jsonx.settled(base, __why=gate.reason(F.col("__o")))
        why = F.col("__why")
        errors = [*first, F.when(~_blank(out) & (why != "ok"), why)]
    return base.select(F.col(id_col).alias("row_id"), F.posexplode(F.array_compact(F.array(*errors))).alias("seq", "error"))


def duplicate_inputs(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """``input, n`` held by several rows; the preview is cut, the count is of the whole text."""
    found = rows.where("input is not null").groupBy("input").agg(F.count("*").alias("n")).where("n > 1").select(F.substring("input", 1, PREVIEW_CHARS).alias("input"), "n")
    return found.orderBy(F.desc("n"), "input").limit(cap) if cap else found


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``errors`` (list) and ``reason`` of the output, read without fences; department and urgency of valid ones."""
    labelled = gate.with_label(rows, "output", "label")
    out, why = F.col("output"), F.col("label_reason")
    errors = F.array_compact(
        F.array(
            F.when(_blank(F.col("instruction")), "bad_instruction"),
            F.when(_blank(F.col("input")), "bad_input"),
            F.when(_blank(out), "bad_output_text"),
            F.when(F.contains(out, F.lit("```")), "markdown_fence_in_output"),
            F.when(~_blank(out) & (why != "ok"), why),
        )
    )
    return jsonx.settled(labelled, errors=errors)


def _repeated(rows: DataFrame, by: str) -> DataFrame:
    """``by, input, n, at``: inputs that are not blank and held by several rows, with the first of them."""
    return rows.where(~_blank(F.col("input"))).groupBy(by, "input").agg(F.count("*").alias("n"), F.min("row_id").alias("at")).where("n > 1")


def _distribution(field: str) -> Column:
    """``value:n`` of a field's values, most first, ties by the first row that holds them."""
    values = F.filter("cells", lambda c: c["field"] == field)
    order = F.array_sort(F.transform(values, lambda c: F.struct((-c["n"]).alias("n"), c["at"].alias("at"), c["value"].alias("value"))))
    return F.array_join(F.transform(order, lambda c: F.concat(c["value"], F.lit(":"), (-c["n"]).cast("string"))), ",")


def report(rows: DataFrame, by: str = "split_name") -> DataFrame:
    """Rows, errors, ``passed`` and the distribution of valid labels for each file or split.

    Every input that several rows of a group hold is one more error. The first
    errors are :func:`report_preview`. Rows are read once for their errors and
    once, input only, for repeats; what is gathered is bounded by the label sets.
    """
    judged = _judged(rows.select(by, "row_id", "instruction", "input", "output"))
    cells = judged.groupBy(by, "label_department", "label_urgency").agg(F.count("*").alias("n"), F.sum(F.size("errors")).alias("errors"), F.min("row_id").alias("at"))
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"label_{f}").alias("value")) for f in ("department", "urgency")])).alias("v")
    counted = cells.select(by, "n", "errors", "at", values).groupBy(by, "v.field", "v.value").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.min("at").alias("at"))
    own = F.col("field") == "department"  # each row is in one cell of either field
    sums = counted.groupBy(by).agg(F.sum(F.when(own, F.col("n"))).alias("num_rows"), F.sum(F.when(own, F.col("errors"))).alias("errors"), F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field", "value", "n", "at"))).alias("cells"))
    again = _repeated(rows.select(by, "row_id", "input"), by).groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("repeated"))
    both = sums.join(again, sums[by].eqNullSafe(again["__by"]), "left").na.fill({"repeated": 0})
    out = both.select(by, "num_rows", (F.col("errors") + F.col("repeated")).cast("bigint").alias("num_errors"), F.col("repeated").alias("repeated_inputs"), "cells")
    return out.select(by, "num_rows", "num_errors", "repeated_inputs", (F.col("num_errors") == 0).alias("passed"), _distribution("department").alias("department_distribution"), _distribution("urgency").alias("urgency_distribution"))


def report_preview(rows: DataFrame, by: str = "split_name", n: int = PREVIEW_ERRORS) -> DataFrame:
    """``by, place, row_id, error, value``: the first ``n`` errors of each group (a top-k report).

    Errors of rows come first, in row order, with the output as value; then
    repeated inputs, without a row, by the first row that holds them.
    """
    named = _judged(rows.select(by, "row_id", "instruction", "input", "output")).select(by, "row_id", F.posexplode("errors").alias("seq", "error"), F.substring("output", 1, PREVIEW_CHARS).alias("value"))
    again = _repeated(rows.select(by, "row_id", "input"), by).select(by, F.col("at").alias("row_id"), F.lit(0).alias("seq"), F.lit("duplicate_input").alias("error"), F.substring("input", 1, PREVIEW_CHARS).alias("value"))
    order = Window.partitionBy(by).orderBy(F.col("error") == "duplicate_input", "row_id", "seq")
    ranked = named.union(again).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return ranked.select(by, F.col("place").cast("bigint").alias("place"), F.when(F.col("error") != "duplicate_input", F.col("row_id")).alias("row_id"), "error", "value")


def record_errors(values: DataFrame, keys: list[str], missing: str = "missing_row_keys") -> DataFrame:
    """``row_idx, error, keys`` of file records (``row_idx, value`` VARIANT) that are no object or lack keys.

    One error for all missing keys of a training row; preference pairs name each
    with ``missing='missing_key'``.
    """
    need = F.array(*[F.lit(k) for k in sorted(keys)])
    read = jsonx.settled(values.select("row_idx", "value"), o=F.try_variant_get("value", "$", "map<string,variant>"))
    lacking = F.array_except(need, F.map_keys("o"))
    found = read.select("row_idx", F.when(F.col("o").isNull(), "row_not_object").when(F.size(lacking) > 0, missing).alias("error"), F.when(F.col("o").isNotNull(), lacking).alias("lacking")).where("error is not null")
    one_each = F.when(F.col("error") == "missing_key", F.transform("lacking", lambda k: F.array(k))).otherwise(F.array("lacking"))
    return found.select("row_idx", "error", F.explode(one_each).alias("keys")).select("row_idx", "error", F.array_join("keys", ",").alias("keys"))


def error_preview(errors: DataFrame, n: int = PREVIEW_ERRORS) -> DataFrame:
    """The first ``n`` errors in row order (a top-k report)."""
    return errors.orderBy("row_id", "seq").limit(n)


def pair_diffs(pairs: DataFrame) -> DataFrame:
    """Adds to preference pairs: ``errors`` (list), ``warning`` and ``diff``.

    ``diff`` joins the differing fields by '+', 'no_diff' if none, null where
    either side is no valid label; symptoms are compared as ordered lists.
    """
    flat = pairs.select("pair_id", F.col("_source"), F.col("conversations"), F.col("chosen.value").alias("chosen_text"), F.col("rejected.value").alias("rejected_text"))
    both = gate.with_label(gate.with_label(flat, "chosen_text", "chosen"), "rejected_text", "rejected")
    missing = _blank(F.col("rejected_text"))
    errors = F.array_compact(
        F.array(
            F.when(F.coalesce(F.size("conversations"), F.lit(0)) < 2, "bad_conversations"),
            F.when(missing, "bad_rejected_text"),
            F.when(~missing & (F.col("chosen_reason") != "ok"), F.concat(F.lit("bad_chosen:"), F.col("chosen_reason"))),
        )
    )
    warning = F.when(~missing & ~F.col("rejected_parsed"), "rejected_not_json").when(~missing & (F.col("rejected_reason") != "ok"), F.concat(F.lit("rejected_schema:"), F.col("rejected_reason")))
    differs = lambda k: F.when(F.col(f"chosen_{k}") != F.col(f"rejected_{k}"), k)
    diff = F.concat_ws("+", differs("department"), differs("urgency"), differs("symptoms"))
    valid = (F.col("chosen_reason") == "ok") & (F.col("rejected_reason") == "ok")
    return jsonx.settled(both, errors=errors, warning=warning, diff=F.when(valid, F.when(diff == "", "no_diff").otherwise(diff)))


def hard_pairs(diffs: DataFrame) -> DataFrame:
    """Adds ``keep`` and ``filter_reason``: pairs whose department or urgency differs are hard."""
    reason = (
        F.when(F.col("diff").isNull(), "parse_error")
        .when((F.col("chosen_department") != F.col("rejected_department")) & (F.col("chosen_urgency") != F.col("rejected_urgency")), "dept+urgency")
        .when(F.col("chosen_department") != F.col("rejected_department"), "dept")
        .when(F.col("chosen_urgency") != F.col("rejected_urgency"), "urgency")
        .otherwise("symptom_only")
    )
    return diffs.withColumn("filter_reason", reason).withColumn("keep", F.col("filter_reason").isin("dept", "urgency", "dept+urgency"))
