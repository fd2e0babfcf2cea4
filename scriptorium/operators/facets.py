"""Facet counts of result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import split_authors, strip
from ..scale import top_k

# fixed values: how many entries each facet shows
FACET_LIMITS = {"authors": 15, "journals": 15, "years": 20, "core": 2, "clc": 15, "affiliations": 15}


def facet_values(papers: DataFrame) -> DataFrame:
    """(paper_id, facets): all facet values of a paper in one array."""
    def tagged(name, values):
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    def one(value, present):
        return F.when(present, F.array(value)).otherwise(F.array().cast("array<string>"))

    journal = strip(F.coalesce("source_journal", F.lit("")))
    year = F.coalesce("publish_year", F.lit(0))
    clc = F.filter(F.transform(F.split(F.coalesce("clc_number", F.lit("")), "[;；]"), strip), lambda v: v != "")
    segments = F.filter(F.split(strip(F.coalesce("affiliation", F.lit(""))), "[;；,，]"), lambda v: v != "")
    first = strip(F.coalesce(F.get(segments, F.lit(0)), F.lit("")))
    core = F.when(F.col("is_core") == 1, F.lit(rules.CORE_YES)).otherwise(F.lit(rules.CORE_NO))
    return papers.select("paper_id", F.concat(
        tagged("authors", split_authors("author")),
        tagged("journals", one(journal, journal != "")),
        tagged("years", one(year.cast("string"), year > 0)),
        tagged("core", F.array(core)),
        tagged("clc", clc),
        tagged("affiliations", one(first, first != "")),
    ).alias("facets"))


def facets(hits: DataFrame, papers: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(query_id, facet, value, count, rank) over all hits, before paging.

    All six facets come from one pass: values are counted on the map side, and
    only counts are shuffled.
    """
    limits = {**FACET_LIMITS, **(limits or {})}
    found = hits.select("query_id", "paper_id").join(facet_values(papers), "paper_id")
    values = found.select("query_id", F.explode("facets").alias("f")).select("query_id", "f.facet", "f.value")
    counts = values.groupBy("query_id", "facet", "value").agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col("value").asc()]
    ranked = top_k(counts, ["query_id", "facet"], order, max(limits.values()), ["value"])
    shown = F.lit(False)
    for name, n in limits.items():
        shown = shown | ((F.col("facet") == name) & (F.col("rank") <= n))
    return ranked.filter(shown)


__all__ = ["facets", "facet_values", "FACET_LIMITS"]
