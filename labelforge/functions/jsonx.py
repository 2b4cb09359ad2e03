"""Strict JSON objects held in text columns.

Spark's VARIANT parser stops at the end of the first value and so accepts
trailing text. Wrapping the text as the first element of an array that ends
in a sentinel makes acceptance exact with a single parse: the sentinel is the
second element only if the text is one complete JSON value.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SENTINEL = "~label-end~"
_BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_FENCE = r"```(?:json)?"


def uni_strip(text: Column) -> Column:
    """Trim every Unicode white space at both ends (null stays null)."""
    return F.regexp_replace(text, _BLANK, "")


def strip_fences(text: Column, eos_tokens: bool = True) -> Column:
    """Drop Markdown fence markers, optionally end-of-sequence tokens, and trim."""
    out = uni_strip(F.regexp_replace(uni_strip(text), _FENCE, ""))
    if eos_tokens:
        out = uni_strip(F.replace(F.replace(out, F.lit("<|im_end|>"), F.lit("")), F.lit("</s>"), F.lit("")))
    return out


def _wrapped(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_SENTINEL}"]')))


def object_map(text: Column) -> Column:
    """``map<string,variant>`` of a text that is one JSON object, else null.

    Null and blank texts, other JSON values, trailing or leading text, repeated
    keys, NaN and Infinity give null.
    """
    v = _wrapped(text)
    whole = (F.try_variant_get(v, "$[1]", "string") == _SENTINEL) & ~F.contains(text, F.lit(_SENTINEL))
    return F.when(whole, F.try_variant_get(v, "$[0]", "map<string,variant>"))


def object_variant(text: Column) -> Column:
    """The object itself as VARIANT (or null), for access by path."""
    v = _wrapped(text)
    whole = (F.try_variant_get(v, "$[1]", "string") == _SENTINEL) & ~F.contains(text, F.lit(_SENTINEL))
    is_obj = F.try_variant_get(v, "$[0]", "map<string,variant>").isNotNull()
    return F.when(whole & is_obj, F.try_variant_get(v, "$[0]", "variant"))


def is_string(v: Column) -> Column:
    """True for a JSON string, false for any other value, null or a missing one."""
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def string_value(v: Column) -> Column:
    """The decoded string of a JSON string, else null (numbers don't become text)."""
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def array_items(v: Column) -> Column:
    """``array<variant>`` of a JSON array, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, whatever is later done with them.

    Spark pushes a filter below the projection it reads and puts the whole
    expression into it, so an expensive one runs again for each mention. A
    generator of one row is a border that no filter on its columns crosses.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
