"""Text column expressions.  All stay inside the JVM; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

SPACE = r"\s\p{Z}"
_EDGE_SPACE = rf"^[{SPACE}]+|[{SPACE}]+$"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY_PUNCTUATION = r"""[\s\p{Z}_\-—·•．.,，。:：;；!！?？“”"'‘’()（）\[\]【】《》<>/\\|]+"""
_MULTI_SEPARATORS = r"[，,；;、/|]"
_YEAR = r"(?:19|20)[0-9]{2}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once.

    Catalyst may merge a projection into the lambda that uses it, which would
    recompute an array for each of its elements; an argument is never merged.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Remove every kind of Unicode white space from both ends."""
    return F.regexp_replace(col(c), _EDGE_SPACE, "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _word_runs(c: Column) -> Column:
    # translate() lower-cases ASCII only, so no other letter can turn into one
    return F.regexp_extract_all(F.translate(c, _UPPER, _UPPER.lower()), F.lit("([a-z0-9]+)"), F.lit(1))


def _han_tokens(run: Column) -> Column:
    n = F.length(run)
    return F.flatten(F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(i < n, F.array(run.substr(i, F.lit(1)), run.substr(i, F.lit(2))))
        .otherwise(F.array(run.substr(i, F.lit(1)))),
    ))


def has_han(c: Column | str) -> Column:
    # no Han character lies below U+2E80: a range is told faster than the script of each character
    return col(c).rlike(r"[\x{2E80}-\x{10FFFF}]") & col(c).rlike(r"\p{IsHan}")


def tokenize(c: Column | str) -> Column:
    """Lower-cased ASCII words; each Han character and each Han bigram."""
    c = col(c)
    runs = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9]+|\p{IsHan}+)"), F.lit(1))
    mixed = F.flatten(F.transform(
        runs,
        lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.array(F.lower(r))).otherwise(_han_tokens(r)),
    ))
    tokens = F.when(has_han(c), mixed).otherwise(_word_runs(c))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def _pieces(c: Column, pattern: str) -> Column:
    parts = F.transform(F.split(c, pattern), strip)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def split_multi(c: Column | str) -> Column:
    """Values of a delimited attribute, trimmed, blanks dropped."""
    return _pieces(col(c), _MULTI_SEPARATORS)


def split_authors(c: Column | str) -> Column:
    """Author names of at least two characters; space also separates."""
    parts = F.split(col(c), rf"[；;，,、{SPACE}]+")
    return F.coalesce(F.filter(parts, lambda x: F.length(x) >= 2), F.array().cast("array<string>"))


def split_keywords(c: Column | str) -> Column:
    """Keywords in order of first appearance; space also separates."""
    return F.array_distinct(_pieces(col(c), rf"[,，;；、{SPACE}]+"))


def clean_key(c: Column | str) -> Column:
    """Linkage key: no white space, no punctuation, lower case."""
    return F.coalesce(F.lower(F.regexp_replace(col(c), _KEY_PUNCTUATION, "")), F.lit(""))


def extract_year(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), f"({_YEAR})", 1), F.lit("")).try_cast("int")


def to_int_year(c: Column | str) -> Column:
    """A whole number as it stands, else the first year inside the text."""
    text = strip(col(c).cast("string"))
    return F.coalesce(F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int")), extract_year(text))


def extract_journal(c: Column | str) -> Column:
    head = F.split(strip(c), rf"[,;，；{SPACE}]", 2)
    return F.coalesce(F.get(head, F.lit(0)), F.lit(""))


def derive_is_core(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("|".join(rules.CORE_MARKERS)).cast("int"), F.lit(0))


def derive_paper_id(path: Column | str) -> Column:
    """File name without folder and last extension, underscores stripped."""
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "^_+|_+$", "")


def abstract_preview(c: Column | str, limit: int = 200) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def clc_code(c: Column | str) -> Column:
    """Classification code: the part before a bracket that is not in front."""
    return strip(F.regexp_replace(col(c), r"(?s)^([^(（]+)[(（].*$", "$1"))


def cut(c: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def contains_any(c: Column, words) -> Column:
    """True when the text contains one of the given fixed words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit
