"""Ranking, paging, year order and precision cut of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules
from ..functions.text import abstract_preview
from ..scale import SCORE_DIGITS, by_score, top_k
from .bm25 import Matches


def rank_topk(hits: DataFrame, k: int = 0) -> DataFrame:
    """Rank by score, keep the first k per query; k <= 0 keeps all."""
    return top_k(hits.drop("rank"), ["query_id"], by_score("score", "paper_id"), k, ["paper_id"])


def page_bounds(page: int, size: int) -> tuple[int, int]:
    page = 1 if page < 1 else page
    size = size if 1 <= size <= 200 else 20
    return (page - 1) * size, page * size


def paginate(hits: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """One page of every ranked list, with the length of the whole list."""
    low, high = page_bounds(page, size)
    totals = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    shown = hits.filter((F.col("rank") > low) & (F.col("rank") <= high))
    # totals has one row per query, as the page has at most `size` of them
    return shown.join(totals, "query_id")


def sort_by_year(hits: DataFrame | Matches, papers: DataFrame, k: int = 0) -> DataFrame:
    """Newest first, relevance order inside a year; a missing year sorts last.

    All rows stay.  A caller that knows that no list is longer than k passes k.  Matches are ranked once, by year and
    score, and meet the years by paper, before their queries.
    """
    if isinstance(hits, Matches):
        years = papers.select("paper_id", F.coalesce("publish_year", F.lit(0)).alias("_year"))
        order = [(F.coalesce("_year", F.lit(0)), False), (F.round("score", SCORE_DIGITS), False), F.col("paper_id").asc()]
        return hits.ranked(order, years)
    dated = hits.join(papers.select("paper_id", F.coalesce("publish_year", F.lit(0)).alias("_year")),
                      "paper_id", "left")
    order = [F.coalesce("_year", F.lit(0)).desc(), F.col("_old").asc()]
    ranked = top_k(dated.withColumnRenamed("rank", "_old"), ["query_id"], order, k, ["paper_id"])
    return ranked.select(*hits.columns)


def precision_filter(hits: DataFrame, keep_head: int = 12, gap_ratio: float = 0.55, max_out: int = 50,
                     min_keep: int = 4) -> DataFrame:
    """Drop keyword-only hits behind the head, cut at the first cliff, cap.

    A cliff counts from position `min_keep` on.  With a cap only one row more
    than the cap can matter, so the list is shortened before the cliff search.
    """
    head = (F.col("rank") <= keep_head) | F.array_contains("matched_fields", "chunk")
    survivors = hits.filter(head).withColumnRenamed("rank", "_old")
    limit = max_out + 1 if max_out > 0 else 0
    listed = top_k(survivors, ["query_id"], [F.col("_old").asc()], limit, ["paper_id"])
    window = Window.partitionBy("query_id")
    following = F.lead("score").over(window.orderBy("rank"))
    cliff = (F.col("rank") >= min_keep) & (following < F.col("score") * gap_ratio) if gap_ratio > 0 else F.lit(False)
    kept = (
        listed.withColumn("_cliff", F.when(cliff, F.col("rank")))
        .withColumn("_cut", F.min("_cliff").over(window))
        .filter(F.col("_cut").isNull() | (F.col("rank") <= F.col("_cut")))
    )
    if max_out > 0:
        kept = kept.filter(F.col("rank") <= max_out)
    return kept.select(*hits.columns)


def hydrate_hits(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Display columns for hits; hits of unknown papers are dropped."""
    text = {
        "title": "title", "author": "author", "journal": "source_journal",
        "affiliation": "affiliation", "keywords": "keywords",
    }
    shown = papers.select(
        "paper_id",
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in text.items()],
        F.coalesce("publish_year", F.lit(0)).alias("year"),
        abstract_preview("abstract").alias("abstract_preview"),
    )
    return hits.join(shown, "paper_id")


def matched_by(hits: DataFrame, keyword_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Label every hit by the arms that found it; without either it counts as keyword."""
    keys = ["query_id", "paper_id"]
    arms = (
        keyword_hits.select(*keys, F.lit(1).alias("arm"))
        .unionByName(vector_hits.select(*keys, F.lit(2).alias("arm")))
        .groupBy(*keys)
        .agg(F.max(F.col("arm") == 1).alias("_kw"), F.max(F.col("arm") == 2).alias("_vec"))
    )
    label = (
        F.when(F.col("_kw") & F.col("_vec"), F.lit(rules.MATCHED_BOTH))
        .when(F.col("_vec"), F.lit(rules.MATCHED_VECTOR))
        .otherwise(F.lit(rules.MATCHED_KEYWORD))
    )
    return hits.join(arms, keys, "left").withColumn("matched_by", label).drop("_kw", "_vec")


__all__ = ["rank_topk", "page_bounds", "paginate", "sort_by_year", "precision_filter", "hydrate_hits",
           "matched_by"]
