"""Query analysis: rule-based expansion and externally produced rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import flag_at, list_at, no_strings, parse_object, text_at, year_at
from ..functions.text import extract_year, strip, tokenize
from .filters import FILTER_TYPE

MAX_KEYWORDS = 12


def _long_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokenize(text), lambda t: F.length(t) >= 2))


def _filter(years=None, year_from=None, year_to=None, authors=None, affiliations=None, journals=None, clcs=None,
            is_core=None) -> Column:
    return F.struct(
        (authors if authors is not None else no_strings()).alias("authors"),
        (affiliations if affiliations is not None else no_strings()).alias("affiliations"),
        (journals if journals is not None else no_strings()).alias("journals"),
        (clcs if clcs is not None else no_strings()).alias("clcs"),
        (years if years is not None else F.array().cast("array<int>")).alias("years"),
        (year_from if year_from is not None else F.lit(0)).alias("year_from"),
        (year_to if year_to is not None else F.lit(0)).alias("year_to"),
        (is_core if is_core is not None else F.lit(None).cast("boolean")).alias("is_core"),
    ).cast(FILTER_TYPE)


def expand_query(queries: DataFrame) -> DataFrame:
    """Add core, keywords and analysis_filter by rule: year, first 12 long tokens."""
    q = F.coalesce("q", F.lit(""))
    year = extract_year(q)
    return queries.withColumns({
        "core": q,
        "keywords": F.slice(_long_tokens(q), 1, MAX_KEYWORDS),
        "analysis_filter": _filter(years=F.when(year.isNotNull(), F.array(year)).otherwise(
            F.array().cast("array<int>"))),
    })


def _first_set(doc: Column, *paths: str) -> Column:
    out = no_strings()
    for path in reversed(paths):
        values = list_at(doc, path)
        out = F.when(F.size(values) > 0, values).otherwise(out)
    return out


def apply_rewrites(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Join rewrite payloads (query_id, payload) to queries and check them.

    Broken or missing payloads fall back to the rules of expand_query.  A
    rewrite that shares no token of two or more characters with the query is
    rejected together with its filter.  Adds accepted, bm25_text, vector_text,
    boolean_query and analysis_filter.
    """
    base = expand_query(queries)
    joined = base.join(rewrites.select("query_id", "payload"), "query_id", "left")
    staged = joined.withColumn("_doc", parse_object(F.col("payload")))
    doc = F.col("_doc")
    given = doc.isNotNull()
    year = year_at(doc, "filter_conditions.publish_year")
    filters = _filter(
        years=F.when(year > 0, F.array(year)).otherwise(F.array().cast("array<int>")),
        year_from=F.coalesce(year_at(doc, "filter_conditions.year_from"), F.lit(0)),
        year_to=F.coalesce(year_at(doc, "filter_conditions.year_to"), F.lit(0)),
        authors=_first_set(doc, "filter_conditions.authors", "filter_conditions.author"),
        affiliations=list_at(doc, "filter_conditions.affiliation"),
        journals=_first_set(doc, "filter_conditions.journal", "filter_conditions.source_journal"),
        clcs=_first_set(doc, "filter_conditions.clc_number", "filter_conditions.clc"),
        is_core=flag_at(doc, "filter_conditions.is_core"),
    )
    core = F.coalesce(F.nullif(text_at(doc, "search_payload.core_semantic_sentence"), F.lit("")), F.col("core"))
    academic = list_at(doc, "search_payload.academic_keywords")
    synonyms = list_at(doc, "search_payload.synonyms_and_extensions")
    boolean = strip(F.coalesce(text_at(doc, "boolean_query"), F.lit("")))
    staged = staged.withColumns({
        "_core": F.when(given, strip(core)).otherwise(F.col("core")),
        "_academic": F.when(given & (F.size(academic) > 0), academic).otherwise(F.col("keywords")),
        "_synonyms": F.when(given, synonyms).otherwise(no_strings()),
        "_filter": F.when(given, filters).otherwise(F.col("analysis_filter")),
        "_bool": F.when(given, boolean).otherwise(F.lit("")),
    })
    shared = F.arrays_overlap(
        _long_tokens(F.coalesce("q", F.lit(""))),
        _long_tokens(F.concat_ws(" ", F.col("_core"), F.array_join("_academic", " "))))
    staged = staged.withColumn("accepted", F.coalesce(shared, F.lit(False)))
    ok = F.col("accepted")
    return staged.select(
        *[c for c in queries.columns],
        "accepted",
        F.when(ok, F.concat_ws(" ", F.array_join("_academic", " "), F.array_join("_synonyms", " "), "q"))
        .otherwise(F.coalesce("q", F.lit(""))).alias("bm25_text"),
        F.when(ok & (strip("_core") != ""), F.col("_core")).otherwise(F.coalesce("q", F.lit(""))).alias("vector_text"),
        F.when(ok, F.col("_bool")).otherwise(F.lit("")).alias("boolean_query"),
        F.when(ok, F.col("_filter")).otherwise(_filter()).alias("analysis_filter"),
    )


__all__ = ["expand_query", "apply_rewrites"]
