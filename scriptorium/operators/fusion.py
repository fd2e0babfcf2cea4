"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..scale import in_batches, rank_batches, stored, top_k

# field names that fit the bits of a long
MAX_FIELDS = 63

# fused scores lie close together: six digits would tie ranks that differ
FUSED_DIGITS = 12


def fused_order() -> list[Column]:
    return [F.round("score", FUSED_DIGITS).desc(), F.col("paper_id").asc()]


def rrf_scores(list_a: DataFrame, list_b: DataFrame, k: int = rules.RRF_K) -> DataFrame:
    k = k if k > 0 else rules.RRF_K
    columns = ["query_id", "paper_id", "matched_fields", "rank"]
    both = list_a.select(*columns).unionByName(list_b.select(*columns)).filter(F.col("rank") > 0)
    return both.groupBy("query_id", "paper_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_fields")))).alias("matched_fields"),
    )


def rrf_fuse(list_a: DataFrame, list_b: DataFrame, k: int = rules.RRF_K, top: int = 0) -> DataFrame:
    """Sum of 1 / (k + rank) over two ranked lists, ranked again.

    `top` <= 0 keeps all rows.  Callers that know the lists' lengths pass their
    sum, which drops nothing and spares the distributed ranking.
    """
    if top <= 0:
        return _fuse_whole(list_a, list_b, k)
    return top_k(rrf_scores(list_a, list_b, k), ["query_id"], fused_order(), top, ["paper_id"])


def _fuse_whole(list_a: DataFrame, list_b: DataFrame, k: int) -> DataFrame:
    """Whole lists, some queries at a time; fields travel as bits, so that sums and bits need no list of rows."""
    columns = ["query_id", "paper_id", "matched_fields", "rank"]
    both = list_a.select(*columns).unionByName(list_b.select(*columns)).filter(F.col("rank") > 0)
    # a row for each set of fields
    sets = stored(both.groupBy("matched_fields").agg(F.count(F.lit(1)).alias("n")))
    rows = sets.agg(F.sum("n")).first()[0] or 0
    found = sets.select(F.explode("matched_fields").alias("name")).distinct().limit(MAX_FIELDS + 1).collect()
    names = sorted(r["name"] for r in found if r["name"] is not None)
    order = [(F.round("score", FUSED_DIGITS), False), F.col("paper_id").asc()]
    if len(names) < len(found) or len(names) > MAX_FIELDS:
        parts = [rrf_scores(part, part.limit(0), k) for part in in_batches(both, ["query_id"], rows)]
        return rank_batches(parts, ["query_id"], order, rows=rows)
    k = k if k > 0 else rules.RRF_K
    has = [F.coalesce(F.array_contains("matched_fields", n), F.lit(False)) for n in names]
    bits = sum((F.when(h, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, h in enumerate(has)), F.lit(0).cast("long"))
    scored = both.select("query_id", "paper_id", (1.0 / (k + F.col("rank"))).alias("score"), bits.alias("bits"))
    parts = [part.groupBy("query_id", "paper_id").agg(F.sum("score").alias("score"), F.bit_or("bits").alias("bits"))
             for part in in_batches(scored, ["query_id"], rows)]
    fields = F.array_compact(F.array(*[F.when(F.getbit("bits", F.lit(i)) == 1, F.lit(n)) for i, n in enumerate(names)]))
    ranked = rank_batches(parts, ["query_id"], order, rows=rows)
    return ranked.select("query_id", "paper_id", "score", fields.cast("array<string>").alias("matched_fields"), "rank")
