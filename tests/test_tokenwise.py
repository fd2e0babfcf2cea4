"""BM25 over tokens in the rows of papers against the scores by postings."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import tokenize
from scriptorium.operators import bm25, tiled, tokenwise
from scriptorium.operators.bm25 import bm25_scores, bm25_search, query_terms
from scriptorium.operators.filters import FILTER_TYPE, user_scopes
from scriptorium.operators.scopes import within_scope
from scriptorium.scale import by_score, top_k
from scriptorium.sources.index import build_index, token_sources


@pytest.fixture(scope="module")
def papers(spark):
    # every text three times; some have no words, no keywords or nothing at all
    texts = [" ".join(f"w{(i * j) % 23}" for j in range(1, 4 + i % 17)) for i in range(60)]
    rows = [(f"p{n:04d}", t[:12] if i % 3 else "", None if i % 7 == 0 else t[-9:], t, None, f"{t} 深度学习 {t}" if i % 11 else None, 2000 + i % 5)
            for n, (i, t) in enumerate([(i, t) for i, t in enumerate(texts)] * 3)]
    return spark.createDataFrame(
        rows, "paper_id string, title string, keywords string, abstract string, research_design_text string, raw_body string, "
              "publish_year int").withColumns({"author": F.lit("a"), "affiliation": F.lit("u"), "source_journal": F.lit("j"),
                                               "clc_number": F.lit("c"), "is_core": F.lit(1)})


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 学习"), (2, "w5 zzz"), (3, "zzz"), (4, ""), (5, None), (6, "W7 w7 w8 w9")], "query_id long, q string")


def ranked(hits):
    return sorted((r.query_id, r["rank"], r.paper_id, round(r.score, 9), tuple(r.matched_fields)) for r in hits.collect())


@pytest.mark.parametrize("fields", ["all", "theme", "title_or_keywords"])
@pytest.mark.parametrize("k", [0, 7])
def test_equals_scores_by_postings(spark, papers, queries, fields, k, monkeypatch):
    monkeypatch.setattr(tokenwise, "TRIPLES", 50)
    index = build_index(papers)
    by_postings = bm25_scores(index, query_terms(queries, "q", fields))
    expected = top_k(by_postings, ["query_id"], by_score("score", "paper_id"), k, ["paper_id"])
    assert ranked(bm25_search(index, queries, fields=fields, k=k)) == ranked(expected)


def test_scopes(spark, papers, queries):
    asked = queries.withColumn("filter", F.when(F.col("query_id") != 6, F.expr(
        f"cast(named_struct('authors', array(), 'affiliations', array(), 'journals', array(), 'clcs', array(), 'years', "
        f"array(2001, 2003), 'year_from', 0, 'year_to', 0, 'is_core', null) as {FILTER_TYPE})")))
    scopes, index = user_scopes(papers, asked), build_index(papers)
    expected = within_scope(bm25_scores(index, query_terms(queries)), scopes)
    expected = top_k(expected, ["query_id"], by_score("score", "paper_id"), 5, ["paper_id"])
    got = ranked(bm25_search(index, queries, scopes=scopes, k=5))
    assert got == ranked(expected) and {r[0] for r in got} == {1, 2, 6}
    assert bm25_search(index, queries.filter("query_id in (4, 5)"), scopes=scopes, k=5).collect() == []


def test_copies_have_the_very_same_score(spark, papers, queries):
    """Sums in another order differ in the last digits, and ranks of copies with them once such a score is rounded."""
    scores = {(r.query_id, r.paper_id): r.score for r in bm25_search(build_index(papers), queries, k=0).collect()}
    for (q, p), s in scores.items():
        assert scores[q, f"p{int(p[1:]) % 60:04d}"] == s


def test_no_posting_is_shuffled(spark, papers, queries):
    plan = bm25_search(build_index(papers), queries, k=7)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "field#" not in plan.split("MapInArrow")[0]
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "term" in line]


def test_texts_are_split_in_tasks_as_by_tokenize(spark, papers, queries):
    texts = ["", None, "  ", "One-two,THREE", "3x", "été naïve Ünder_score K", "a\nB\tc ", "x", "深度 Learning 学", "end"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "paper_id string, title string").coalesce(1).withColumns(
        {c: F.lit(None).cast("string") for c in ("keywords", "abstract", "research_design_text", "raw_body")})
    expected = [r[0] for r in df.select(tokenize("title")).collect()]
    batch = token_sources(df).toArrow().combine_chunks().to_batches()[0]
    parts = list(tokenwise._tokens(batch, "title"))
    found = [[] for _ in texts]
    for length, tokens in parts:
        at = 0
        for i, n in enumerate(length):
            found[i] += tokens[at:at + n].to_pylist()
            at += n
    assert found == expected
    # texts are read twice, not once more for the lengths
    index = build_index(papers)
    assert ranked(bm25_search(replace(index, field_stats=None), queries, k=7)) == ranked(bm25_search(index, queries, k=7))


def test_no_papers(spark, papers, queries):
    assert bm25_search(build_index(papers.limit(0)), queries, k=7).collect() == []


@pytest.mark.parametrize("fields", ["all", "theme"])
def test_many_queries_with_few_terms_in_tiles(spark, papers, queries, fields, monkeypatch):
    """No list of (query, paper) pairs is shuffled; the best k are those of the scores by postings."""
    monkeypatch.setattr(bm25, "is_small", lambda df, *a: "query_id" not in df.columns)
    monkeypatch.setattr(tiled, "QUERY_TILE", 2)
    monkeypatch.setattr(tiled, "PAPERS", 37)
    monkeypatch.setattr(tokenwise, "TRIPLES", 50)
    index = build_index(papers)
    expected = top_k(bm25_scores(index, query_terms(queries, "q", fields)), ["query_id"], by_score("score", "paper_id"), 7, ["paper_id"])
    found = bm25_search(index, queries, fields=fields, k=7)
    assert ranked(found) == ranked(expected)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "tf#" not in plan
    assert bm25_search(index, queries.filter("query_id in (4, 5)"), k=7).collect() == []


def test_scopes_shuffle_no_text(spark, papers, queries):
    asked = queries.withColumn("filter", F.expr(
        f"cast(named_struct('authors', array(), 'affiliations', array(), 'journals', array(), 'clcs', array(), 'years', "
        f"array(2001, 2003), 'year_from', 0, 'year_to', 0, 'is_core', null) as {FILTER_TYPE})"))
    hits = bm25_search(build_index(papers), queries, scopes=user_scopes(papers, asked), k=5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "_source" not in plan and "_tokens" not in plan and "_have" in plan
