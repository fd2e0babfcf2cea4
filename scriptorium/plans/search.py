"""Whole searches, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import strip, tokenize
from ..operators.bm25 import bm25_search
from ..operators.boolean import boolean_search
from ..operators.containment import contained
from ..operators.facets import facets
from ..operators.filters import (
    FILTER_TYPE, SearchFilters, allowed_merge, lookup_condition,
)
from ..operators.fusion import rrf_fuse
from ..operators.ranking import hydrate_hits, matched_by, paginate, precision_filter, sort_by_year
from ..operators.rewrites import apply_rewrites, expand_query
from ..operators.scopes import Scopes
from ..operators.vector import chunks_to_papers, shared_vector_search, vector_search
from ..scale import cut_lineage, global_rank, small_join, stored, top_k
from ..sources.index import Index

TRADITIONAL_K = 500
SMART_K = 200
RELATED_K = 50
RELATED_CHUNKS = 200
RELATED_OUT = 20


@dataclass(frozen=True)
class SearchResult:
    page: DataFrame
    facets: DataFrame
    hits: DataFrame


def _uniform_scopes(papers: DataFrame, queries: DataFrame, condition) -> Scopes | None:
    """One filter for the whole batch, without a join between queries and papers."""
    if condition is None:
        return None
    name = F.array(F.lit("filter")).alias("scopes")
    return Scopes(
        queries=queries.select("query_id", name), papers=papers.filter(condition).select("paper_id", name),
        batch=queries.select("query_id"))


def traditional_search(index: Index, papers: DataFrame, queries: DataFrame, field: str = "all", year: int = 0,
                       filters: SearchFilters | None = None, expressions: dict | None = None, sort: str = "",
                       page: int = 1, page_size: int = 20) -> SearchResult:
    """Field-limited search of queries(query_id, q) with filters, facets and paging.

    A metadata field searches that column; `expressions` {query_id: expression}
    are answered as boolean queries; a q without tokens, with a filter, lists the
    filtered papers.
    """
    if field in rules.LOOKUP_FIELDS:
        return _lookup_search(papers, queries, field, year, filters, sort, page, page_size)
    condition = lookup_condition("", "", year, filters)
    scopes = _uniform_scopes(papers, queries, condition)
    expressions = expressions or {}
    plain = queries.filter(~F.col("query_id").isin(list(expressions))) if expressions else queries
    hits = bm25_search(index, plain, fields=field, scopes=scopes, k=TRADITIONAL_K)
    if expressions:
        hits = hits.unionByName(
            boolean_search(index, papers, expressions, field, condition, TRADITIONAL_K).select(*hits.columns))
    if condition is not None:
        blank = plain.filter(F.size(tokenize(F.coalesce("q", F.lit("")))) == 0).select("query_id")
        listed = _listed(papers.filter(condition), blank)
        hits = hits.unionByName(listed.select(*hits.columns))
    return _finish(hits, papers, sort, page, page_size, 0 if condition is not None else TRADITIONAL_K)


def _listed(found: DataFrame, queries: DataFrame) -> DataFrame:
    """The same ranked list of papers for every given query (usually one)."""
    ranked = global_rank(found.select("paper_id"), [], [F.col("paper_id").asc()])
    ids = queries.agg(F.collect_set("query_id").alias("ids"))
    # one row: an array of the ids of blank queries
    every = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(ids.withColumn("_one", F.lit(1))), "_one")
    return every.select(F.explode("ids").alias("query_id"), "paper_id", F.lit(0.0).alias("score"),
                        F.array().cast("array<string>").alias("matched_fields"), "rank")


def _lookup_search(papers, queries, field, year, filters, sort, page, page_size) -> SearchResult:
    column = "author" if field == "first_author" else field
    text = F.lower(strip(F.coalesce(F.col(column), F.lit(""))))
    asked = queries.select("query_id", F.lower(strip(F.coalesce("q", F.lit("")))).alias("needle"))
    rest = lookup_condition("", "", year, filters)
    base = papers if rest is None else papers.filter(rest)
    base = base.select("paper_id", F.lit(column).alias("field"), text.alias("hay"))
    # values of the column are met by gram, papers look their own value up
    needles = asked.filter("needle != ''").select(F.lit(column).alias("field"), "needle").distinct()
    pairs = contained(needles, base.select("field", "hay").distinct())
    if field == "first_author":
        pairs = pairs.filter(F.col("hay").startswith(F.col("needle")))
    wanted = cut_lineage(pairs.join(asked, "needle").select("query_id", "field", "hay"))
    found = small_join(base, wanted, ["field", "hay"], spread_by=["paper_id"])
    hits = global_rank(found.select("query_id", "paper_id"), ["query_id"], [F.col("paper_id").asc()])
    hits = hits.select("query_id", "paper_id", F.lit(0.0).alias("score"),
                       F.array().cast("array<string>").alias("matched_fields"), "rank")
    if rest is not None:
        hits = hits.unionByName(_listed(base, asked.filter("needle = ''").select("query_id")).select(*hits.columns))
    return _finish(hits, papers, sort, page, page_size, 0)


def _finish(hits, papers, sort, page, page_size, k) -> SearchResult:
    # read by the page, its total and the facets
    hits = cut_lineage(hits)
    if sort == "year":
        hits = sort_by_year(hits, papers, k)
    shown = hydrate_hits(paginate(hits, page, page_size), papers)
    return SearchResult(shown, facets(hits, papers), hits)


@dataclass(frozen=True)
class SmartResult:
    golden: DataFrame
    keyword_hits: DataFrame
    vector_hits: DataFrame
    facets: DataFrame
    queries: DataFrame


def smart_search(index: Index, papers: DataFrame, chunks: DataFrame | None, queries: DataFrame,
                 rewrites: DataFrame | None = None, user_filter: str | None = None,
                 floor: float = rules.VECTOR_FLOOR) -> SmartResult:
    """Hybrid search of queries(query_id, q, q_vec).

    Query analysis (rules, or rewrites when given) -> allowed papers -> BM25 and
    vector arms -> fusion -> precision cut.  Without chunks only the word arm
    runs.
    """
    if rewrites is None:
        accepted = expand_query(queries)
        analysed = accepted.withColumn("bm25_text", F.concat_ws(" ", F.array_join("keywords", " "), "q"))
    else:
        analysed = cut_lineage(apply_rewrites(queries, rewrites))
    analysed, user = _user_column(analysed, user_filter)
    scopes = allowed_merge(papers, analysed, "analysis_filter", user)
    # both arms and what is fused are short and read again by fusion, facets and references: stored once
    words = cut_lineage(bm25_search(index, analysed, text="bm25_text", scopes=scopes, k=SMART_K))
    if chunks is None:
        vectors = words.limit(0)
    else:
        chunk_hits = vector_search(chunks, analysed.filter(F.col("q_vec").isNotNull()), scopes, floor, SMART_K)
        vectors = cut_lineage(chunks_to_papers(chunk_hits, SMART_K).select(*words.columns))
    golden = cut_lineage(precision_filter(rrf_fuse(words, vectors, top=2 * SMART_K)))
    return SmartResult(golden, words, vectors, facets(golden, papers), analysed)


def _user_column(queries: DataFrame, user_filter: str | None) -> tuple[DataFrame, str]:
    if user_filter is not None:
        return queries, user_filter
    return queries.withColumn("user_filter", F.lit(None).cast(FILTER_TYPE)), "user_filter"


def seed_vectors(chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """Vector of the longest chunk (bytes) of every seed; the first one on ties."""
    usable = chunks.filter(F.col("embedding").isNotNull()).join(seeds.select("paper_id").distinct(),
                                                                "paper_id", "left_semi")
    size = F.octet_length(F.coalesce("chunk_text", F.lit("")))
    best = F.max_by("embedding", F.struct(size, -F.col("chunk_index")))
    return usable.groupBy("paper_id").agg(best.alias("q_vec"))


def _like(asked: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, first) for all queries and (query_id, `column`) for the first of those that ask for the same."""
    asked = stored(asked)
    firsts = stored(asked.groupBy(column).agg(F.min("query_id").alias("first")))
    return asked.join(firsts, column).select("first", "query_id"), firsts.select(F.col("first").alias("query_id"), column)


def _for_all(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """The hits of every first query for all queries that ask for the same."""
    listed = stored(hits).withColumnRenamed("query_id", "first").join(asked, "first")
    return listed.select(*hits.columns)


def related_papers(index: Index, papers: DataFrame, chunks: DataFrame, seeds: DataFrame,
                   n: int = RELATED_OUT) -> DataFrame:
    """Related papers of every seed(paper_id): keywords and longest chunk, fused.

    The seed itself keeps its rank in both arms and is removed afterwards.
    """
    asked = seeds.select("paper_id").distinct().join(papers.select("paper_id", "keywords"), "paper_id").select(
        F.col("paper_id").alias("query_id"), F.coalesce("keywords", F.lit("")).alias("q"))
    # like keywords and like vectors are answered once
    asked, texts = _like(asked, "q")
    words = _for_all(bm25_search(index, texts, k=RELATED_K), asked)
    vectors = seed_vectors(chunks, seeds).select(F.col("paper_id").alias("query_id"), "q_vec")
    vectors, distinct = _like(vectors, "q_vec")
    near = _for_all(chunks_to_papers(shared_vector_search(chunks, distinct, RELATED_CHUNKS), RELATED_K), vectors)
    fused = rrf_fuse(words, near, top=2 * RELATED_K)
    others = fused.filter(F.col("paper_id") != F.col("query_id")).withColumnRenamed("rank", "_old")
    ranked = top_k(others, ["query_id"], [F.col("_old").asc()], n, ["paper_id"]).drop("_old", "matched_fields")
    shown = papers.select("paper_id", "title", "author", F.coalesce("publish_year", F.lit(0)).alias("year"),
                          "doi", F.col("source_journal").alias("journal"))
    labelled = matched_by(ranked, words, near)
    return labelled.join(shown, "paper_id").withColumnRenamed("query_id", "seed_id")


__all__ = ["traditional_search", "smart_search", "related_papers", "seed_vectors", "SearchResult", "SmartResult"]
