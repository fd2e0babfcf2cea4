"""Field-weighted BM25 for a whole table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import tokenize
from ..scale import by_score, is_small, rank_batches, ranked_by_score, small_join, top_k
from ..sources.index import Index
from .pruned import pruned_hits
from .scopes import Scopes, within_scope
from .tiled import tiled_hits
from .tokenwise import token_hits, token_matches, with_fields


def query_terms(queries: DataFrame, text: str = "q", fields: str = "all", weights=None,
                fields_column: str | None = None) -> DataFrame:
    """(query_id, field, term, weight, title_active) for every distinct term.

    `fields` names one mask for all queries; `fields_column` holds a mask name
    per query.  An unknown mask means all fields.
    """
    weights = {**rules.FIELD_WEIGHTS, **(weights or {})}

    def active(names):
        return F.array(*[
            F.struct(F.lit(f).alias("field"), F.lit(float(weights[f])).alias("weight"),
                     F.lit("title" in names).alias("title_active"))
            for f in names
        ])

    if fields_column is None:
        mask = active(rules.FIELD_MASKS.get(fields, rules.FIELDS))
    else:
        mask = F.lit(None)
        for name, names in {**{f: (f,) for f in rules.FIELDS}, **rules.FIELD_MASKS}.items():
            mask = F.when(F.col(fields_column) == name, active(names)).otherwise(mask)
        mask = F.coalesce(mask, active(rules.FIELDS))
    terms = queries.select(
        "query_id", mask.alias("_mask"),
        F.explode(F.array_distinct(tokenize(text))).alias("term"))
    return (terms.withColumn("m", F.explode("_mask"))
            .select("query_id", "m.field", "term", "m.weight", "m.title_active"))


def weighted_terms(index: Index, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, field, term, title_active, avgdl, factor): terms that occur, with field weight times idf."""
    lengths = index.field_stats.filter(F.col("avgdl") > 0)
    # five rows at most, one per field
    stats = stats.join(F.broadcast(lengths), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(stats, ["field", "term"]).select(
        "query_id", "field", "term", "title_active", "avgdl", (F.col("weight") * idf).alias("factor"))


def bm25_scores(index: Index, terms: DataFrame, fits: bool | None = None) -> DataFrame:
    """All (query_id, paper_id, score, matched_fields) with a positive score."""
    fits = is_small(terms) if fits is None else fits
    found, stats = index.matching(terms, fits)
    weighted = weighted_terms(index, terms, stats)
    bits = sum((F.when(F.col("field") == f, 1 << i).otherwise(0) for i, f in enumerate(rules.FIELDS)),
               F.when(F.col("title_active"), 1 << len(rules.FIELDS)).otherwise(0))
    weighted = weighted.select("query_id", "field", "term", bits.alias("bits"), "avgdl", "factor")
    hits = small_join(found, weighted, ["field", "term"], spread_by=["paper_id"], fits=fits)
    k1, b, tf = rules.BM25_K1, rules.BM25_B, F.col("tf")
    part = F.col("factor") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # one bit per matched field, one for "title takes part": a single small aggregate
    scored = hits.groupBy("query_id", "paper_id").agg(F.sum(part).alias("score"), F.bit_or("bits").alias("_bits"))

    def bit(i):
        return F.getbit("_bits", F.lit(i)) == 1

    factor = F.when(bit(len(rules.FIELDS)) & ~bit(0), F.lit(rules.TITLE_MISS_FACTOR)).otherwise(F.lit(1.0))
    fields = F.array_compact(F.array(*[F.when(bit(i), F.lit(f)) for i, f in enumerate(rules.FIELDS)]))
    return scored.filter(F.col("score") > 0).select(
        "query_id", "paper_id", (F.col("score") * factor).alias("score"), fields.alias("matched_fields"))


def bm25_search(index: Index, queries: DataFrame, text: str = "q", fields: str = "all", weights=None,
                scopes=None, k: int = 500, fields_column: str | None = None) -> DataFrame:
    """Ranked hits(query_id, paper_id, score, matched_fields, rank).

    Collection statistics are global; `scopes` only restricts which papers may
    be returned.  k = 0 ranks every match.  Over a stored index the best k are
    found without scoring every match; over an index that is not stored each task keeps its best k,
    very many queries with few distinct terms are dealt to tasks in tiles.
    """
    if k <= 0:
        return Matches(index, queries, text, fields, weights, scopes, fields_column).ranked()
    terms = query_terms(queries, text, fields, weights, fields_column)
    fits = is_small(terms)
    known = terms.select("field", "term", "weight").distinct()
    if index.blocks is not None and fits:
        blocks, stats = index.matching_blocks(terms)
        hits = pruned_hits(blocks, weighted_terms(index, terms, stats), scopes, k)
    elif index.tokens is not None and fits:
        hits = token_hits(index, terms, scopes, k)
    elif index.tokens is not None and scopes is None and is_small(known):
        hits = tiled_hits(index, terms, known, k)
    else:
        hits = within_scope(bm25_scores(index, terms, fits), scopes)
    return top_k(hits, ["query_id"], by_score("score", "paper_id"), k, ["paper_id"])


@dataclass(frozen=True)
class Matches:
    """Every match of a batch of queries, not ranked yet: for orders in which the rank by score is only a part."""

    index: Index
    queries: DataFrame
    text: str = "q"
    fields: str = "all"
    weights: dict | None = None
    scopes: Scopes | None = None
    fields_column: str | None = None

    def batches(self, attached: DataFrame | None = None) -> list[DataFrame]:
        """(query_id, paper_id, score, bits or matched_fields) and the columns of `attached`(paper_id, ...); no query is in two tables."""
        terms = query_terms(self.queries, self.text, self.fields, self.weights, self.fields_column)
        fits = is_small(terms)
        if self.index.tokens is not None and fits:
            return token_matches(self.index, terms, self.scopes, attached)
        hits = within_scope(bm25_scores(self.index, terms, fits), self.scopes)
        return [hits if attached is None else hits.join(attached, "paper_id", "left")]

    def ranked(self, order: list | None = None, attached: DataFrame | None = None) -> DataFrame:
        """Hits of `bm25_search`, all of them, by score or in the given order."""
        batches = self.batches(attached)
        ranked = ranked_by_score(batches) if order is None else rank_batches(batches, ["query_id"], order)
        ranked = with_fields(ranked) if "bits" in ranked.columns else ranked
        return ranked.select("query_id", "paper_id", "score", "matched_fields", "rank")


__all__ = ["bm25_search", "bm25_scores", "query_terms", "Matches"]
