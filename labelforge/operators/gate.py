"""The label gate: is a text one valid label object, and if not, why."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge import constants
from labelforge.functions import jsonx

#: How a text is prepared before it is read: fences and end tokens dropped, fences only, or only trimmed.
MODES = {
    "full": lambda t: jsonx.strip_fences(t),
    "fences": lambda t: jsonx.strip_fences(t, eos_tokens=False),
    "strict": lambda t: jsonx.uni_strip(t),
}


def parsed(text: Column, mode: str = "full") -> Column:
    """``map<string,variant>`` of the label object in a text, or null."""
    return jsonx.object_map(MODES[mode](text))


def reason(obj: Column) -> Column:
    """The first failing test of an object, or 'ok'. Department and urgency are not trimmed."""
    keys = F.array_sort(F.map_keys(obj))
    symptoms = F.try_element_at(obj, F.lit("symptoms"))
    items = jsonx.array_items(symptoms)
    good = F.forall(items, lambda v: jsonx.is_string(v) & (jsonx.uni_strip(F.coalesce(jsonx.string_value(v), F.lit(""))) != ""))
    return (
        F.when(obj.isNull(), "not_object")
        .when(keys != F.array(*[F.lit(k) for k in sorted(constants.LABEL_KEYS)]), "bad_keys")
        .when(~F.coalesce(jsonx.string_value(F.try_element_at(obj, F.lit("department"))).isin(constants.DEPARTMENTS), F.lit(False)), "bad_department")
        .when(~F.coalesce(jsonx.string_value(F.try_element_at(obj, F.lit("urgency"))).isin(constants.URGENCIES), F.lit(False)), "bad_urgency")
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, "bad_symptoms")
        .when(~good, "bad_symptom_item")
        .otherwise("ok")
    )


def strings(items: Column) -> Column:
    return F.transform(items, jsonx.string_value)


def with_label(df: DataFrame, text: str, name: str, mode: str = "full") -> DataFrame:
    """Adds ``{name}_reason, {name}_department, {name}_urgency, {name}_symptoms``.

    The parts are null unless the label is valid. The parsed object itself is
    an intermediate column, so that it is read once.
    """
    read = df.withColumn("__obj", parsed(F.col(text), mode))
    read = jsonx.settled(read, **{f"{name}_reason": reason(F.col("__obj"))})
    ok, obj = F.col(f"{name}_reason") == "ok", F.col("__obj")
    at = lambda k: F.try_element_at(obj, F.lit(k))
    parts = {
        f"{name}_department": F.when(ok, jsonx.string_value(at("department"))),
        f"{name}_urgency": F.when(ok, jsonx.string_value(at("urgency"))),
        f"{name}_symptoms": F.when(ok, strings(jsonx.array_items(at("symptoms")))),
        f"{name}_parsed": obj.isNotNull(),
    }
    return jsonx.settled(read, **parts).drop("__obj")


def compact(department: Column, urgency: Column, symptoms: Column) -> Column:
    """Canonical label text: fixed key order, no spaces."""
    return F.to_json(F.struct(department.alias("department"), urgency.alias("urgency"), symptoms.alias("symptoms")))
