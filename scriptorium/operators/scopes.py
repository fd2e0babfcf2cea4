"""Allowed sets: which papers a query may return.

A scope is a filter shared by any number of queries.  Papers carry the scopes
they belong to, hits are checked by an equi-join on paper_id, and pairs of
queries and papers are never listed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import is_small, small_join


@dataclass(frozen=True)
class Scopes:
    """queries(query_id, scopes array<string>): all must hold; a query without
    a row is unrestricted.  papers(paper_id, scopes array<string>): scopes a
    paper belongs to; a paper without a row belongs to none.

    An empty allowed set returns nothing; it is not the same as no filter.
    """

    queries: DataFrame
    papers: DataFrame
    # the queries the scopes were made for: bounds the size of `queries`
    batch: DataFrame


def within_scope(hits: DataFrame, scopes: Scopes | None) -> DataFrame:
    if scopes is None:
        return hits
    wanted = scopes.queries.select("query_id", F.col("scopes").alias("_want"))
    owned = scopes.papers.select("paper_id", F.col("scopes").alias("_have"))
    joined = small_join(hits, wanted, ["query_id"], "left", fits=is_small(scopes.batch)).join(owned, "paper_id", "left")
    missing = F.size(F.array_except("_want", F.coalesce("_have", F.array().cast("array<string>"))))
    allowed = F.col("_want").isNull() | (missing == 0)
    return joined.filter(allowed).select(*[F.col(c) for c in hits.columns])
