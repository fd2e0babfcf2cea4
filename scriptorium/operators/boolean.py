"""Boolean retrieval with composable expressions.

Membership is a literal substring test; scores only order the result.  Every
node becomes a pair of Columns (member, score), so any number of saved queries
is answered in one pass over the papers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..scale import by_score, top_k
from ..sources.index import Index
from .bm25 import bm25_scores, query_terms

TEXT_LEAVES = {"title": "title", "keywords": "keywords", "abstract": "abstract",
               "design": "research_design", "body": "body"}
META_LEAVES = {"author": "author", "journal": "source_journal", "affiliation": "affiliation", "clc": "clc_number"}
# fixed value: score of a text leaf that matches without any scored token
LEAF_FLOOR = 0.1


class Expr:
    def __and__(self, other):
        return And(self, other)

    def __or__(self, other):
        return Or(self, other)

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True)
class Term(Expr):
    """A word or phrase; `field` limits it to a text or metadata field."""

    text: str
    field: str = ""


class And(Expr):
    def __init__(self, *children: Expr):
        self.children = children


class Or(Expr):
    def __init__(self, *children: Expr):
        self.children = children


@dataclass(frozen=True)
class Not(Expr):
    child: Expr


def _mask(term: Term, fields: str) -> str | None:
    """Mask name of a text leaf, None for a metadata leaf."""
    if term.field == "":
        return fields if fields in rules.FIELD_MASKS else "all"
    return TEXT_LEAVES.get(term.field)


def _leaf_id(term: Term, fields: str) -> str:
    return f"{_mask(term, fields)}\x1f{term.text.strip()}"


def text_leaves(expr: Expr, fields: str) -> set[tuple[str, str, str]]:
    if isinstance(expr, Term):
        mask = _mask(expr, fields)
        text = expr.text.strip()
        return {(_leaf_id(expr, fields), text, mask)} if mask and text else set()
    children = [expr.child] if isinstance(expr, Not) else expr.children
    return set().union(*[text_leaves(c, fields) for c in children])


def _text(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def _term(term: Term, fields: str) -> tuple[Column, Column]:
    text = term.text.strip()
    if not text:
        return F.lit(False), F.lit(0.0)
    mask = _mask(term, fields)
    if mask is None:
        if term.field == "year":
            hay = F.coalesce(F.col("publish_year"), F.lit(0)).cast("string")
        elif term.field in META_LEAVES:
            hay = _text(META_LEAVES[term.field])
        else:
            return F.lit(False), F.lit(0.0)
        return hay.contains(text.lower()), F.lit(0.0)
    names = rules.FIELD_MASKS.get(mask, (mask,))
    member = reduce(or_, [_text(rules.FIELD_COLUMNS[n]).contains(text.lower()) for n in names])
    found = F.col("_leaf_scores")[_leaf_id(term, fields)]
    return member, F.coalesce(found, F.lit(LEAF_FLOOR))


def evaluate(expr: Expr, fields: str = "all") -> tuple[Column, Column]:
    """(member, score); the papers seen are the allowed universe."""
    if isinstance(expr, Term):
        return _term(expr, fields)
    if isinstance(expr, Not):
        return ~evaluate(expr.child, fields)[0], F.lit(0.0)
    parts = [(c, *evaluate(c, fields)) for c in expr.children]
    if isinstance(expr, Or):
        member = reduce(or_, [m for _, m, _ in parts], F.lit(False))
        score = reduce(lambda a, b: a + b, [F.when(m, s).otherwise(0.0) for _, m, s in parts], F.lit(0.0))
        return member, score
    member, score = F.lit(True), F.lit(0.0)
    for child, m, s in parts:
        member = member & m
        if not isinstance(child, Not):
            score = score + s
    return member, score


def boolean_search(index: Index, papers: DataFrame, saved: dict, fields: str = "all",
                   allowed: Column | None = None, k: int = 500) -> DataFrame:
    """Hits of saved queries {query_id: expression}; `allowed` narrows the universe.

    All text leaves are scored as one BM25 batch and joined back as a map.
    """
    spark = papers.sparkSession
    universe = papers if allowed is None else papers.filter(allowed)
    leaves = set().union(*[text_leaves(e, fields) for e in saved.values()]) if saved else set()
    if leaves:
        batch = spark.createDataFrame(sorted(leaves), "query_id string, q string, mask string")
        scores = bm25_scores(index, query_terms(batch, fields_column="mask"))
        maps = scores.groupBy("paper_id").agg(
            F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("_leaf_scores"))
        universe = universe.join(maps, "paper_id", "left")
    else:
        universe = universe.withColumn("_leaf_scores", F.lit(None).cast("map<string,double>"))
    results = []
    for query_id, expr in saved.items():
        member, score = evaluate(expr, fields)
        results.append(F.when(member, F.struct(F.lit(query_id).alias("query_id"), score.alias("score"))))
    found = universe.select("paper_id", F.explode(F.array_compact(F.array(*results))).alias("h"))
    hits = found.select("h.query_id", "paper_id", "h.score", F.array(F.lit("boolean")).alias("matched_fields"))
    return top_k(hits, ["query_id"], by_score("score", "paper_id"), k, ["paper_id"])
