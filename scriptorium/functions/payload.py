"""Reading model output: code fences, JSON objects of uncertain shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, extract_year, strip


def no_strings() -> Column:
    return F.array().cast("array<string>")


def strip_codefence(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(text, rf"^```[a-zA-Z]*[{SPACE}]*", ""), rf"[{SPACE}]*```[{SPACE}]*$", "")
    return strip(F.when(text.startswith("```"), inner).otherwise(text))


def parse_object(c: Column) -> Column:
    """Text as a JSON object, else its outermost {...} part, else NULL.

    A valid JSON value of another kind is no object and is not searched.
    """
    text = strip_codefence(c)
    whole = F.try_parse_json(text)
    part = F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return (F.when(whole.isNotNull(), F.when(_is_object(whole), whole))
            .when(_is_object(part), part))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def kind_at(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_at(v, path)), F.lit("VOID"))


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def list_at(v: Column, path: str) -> Column:
    """A text gives one element, a list its non-blank elements, anything else none."""
    kind = kind_at(v, path)
    text = text_at(v, path)
    listed = F.transform(
        F.coalesce(F.try_variant_get(v, f"$.{path}", "array<string>"), no_strings()),
        lambda x: strip(F.coalesce(x, F.lit("None"))))
    return (
        F.when(kind == "STRING", F.when(strip(text) != "", F.array(text)).otherwise(no_strings()))
        .when(kind.startswith("ARRAY"), F.filter(listed, lambda x: x != ""))
        .otherwise(no_strings())
    )


def year_at(v: Column, path: str) -> Column:
    """A number as it is, a text by its first year, anything else NULL."""
    kind = kind_at(v, path)
    number = F.try_variant_get(v, f"$.{path}", "double").cast("int")
    return (F.when(kind == "STRING", extract_year(text_at(v, path)))
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number))


def flag_at(v: Column, path: str) -> Column:
    return F.when(kind_at(v, path) == "BOOLEAN", F.try_variant_get(v, f"$.{path}", "boolean"))
