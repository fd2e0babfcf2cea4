"""Corpus statistics: distributions, top values, co-occurrence, term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, split_multi, strip, tokenize
from ..scale import SCORE_DIGITS, top_k


def corpus_counts(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    both = papers.select(F.lit("papers").alias("table")).unionByName(chunks.select(F.lit("chunks").alias("table")))
    return both.agg(
        F.count_if(F.col("table") == "papers").alias("papers"),
        F.count_if(F.col("table") == "chunks").alias("chunks"),
    )


def corpus_stats(papers: DataFrame, chunks: DataFrame, journals: int = 10) -> DataFrame:
    """(stat, value, count): table sizes, year histogram with 0 for none, top journals."""
    counts = corpus_counts(papers, chunks)
    sizes = counts.select(F.explode(F.array(
        F.struct(F.lit("papers").alias("value"), F.col("papers").alias("count")),
        F.struct(F.lit("chunks").alias("value"), F.col("chunks").alias("count")),
    )).alias("s")).select(F.lit("size").alias("stat"), "s.value", "s.count")
    years = papers.groupBy(F.coalesce("publish_year", F.lit(0)).cast("string").alias("value")).count()
    named = papers.filter(strip("source_journal") != "").groupBy(F.col("source_journal").alias("value")).count()
    top = named.orderBy(F.col("count").desc(), "value").limit(journals)
    return (
        sizes.unionByName(years.select(F.lit("year").alias("stat"), "value", "count"))
        .unionByName(top.select(F.lit("journal").alias("stat"), "value", "count"))
    )


def year_distribution(papers: DataFrame) -> DataFrame:
    return papers.filter(F.col("publish_year").isNotNull()).groupBy("publish_year").count()


def _top_counts(values: DataFrame, n: int) -> DataFrame:
    counts = values.groupBy("value").count()
    return counts.orderBy(F.col("count").desc(), F.col("value").asc()).limit(n)


def top_values(papers: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values of a delimited column."""
    return _top_counts(papers.select(F.explode(split_multi(column)).alias("value")), n)


def top_authors(papers: DataFrame, n: int = 20) -> DataFrame:
    return top_values(papers, "author", n)


def top_keywords(papers: DataFrame, n: int = 30) -> DataFrame:
    return top_values(papers, "keywords", n)


def journal_distribution(papers: DataFrame, n: int = 20) -> DataFrame:
    return _top_counts(papers.select(strip("source_journal").alias("value")).filter(F.col("value") != ""), n)


def keyword_pairs(keywords: Column) -> Column:
    """Every unordered pair of distinct keywords of one paper, a < b."""
    return let(F.array_sort(F.array_distinct(keywords)), lambda words: F.flatten(F.transform(
        words,
        lambda a, i: F.transform(
            F.slice(words, i + 2, F.size(words)),
            lambda b: F.struct(a.alias("a"), b.alias("b"))),
    )))


def keyword_cooccurrence(papers: DataFrame, n: int = 30) -> DataFrame:
    """Pairs are formed inside the row, so the only shuffle carries counts."""
    words = papers.select(split_multi("keywords").alias("words"))
    pairs = words.select(F.explode(keyword_pairs(F.col("words"))).alias("p")).select("p.a", "p.b")
    counts = pairs.groupBy("a", "b").count()
    return counts.orderBy(F.col("count").desc(), "a", "b").limit(n)


def tfidf_keywords(papers: DataFrame, top_k_terms: int = 20, max_df: float = 0.95) -> DataFrame:
    """The heaviest terms of every abstract: (paper_id, term, weight, rank).

    An abstract without tokens is read character by character; blank ones are
    left out.  Document frequencies join back under adaptive execution, which
    broadcasts a small vocabulary and splits the partitions of common terms.
    """
    abstract = strip(F.coalesce("abstract", F.lit("")))
    letters = F.filter(F.split(abstract, ""), lambda x: strip(x) != "")
    terms = let(tokenize("abstract"), lambda t: F.when(F.size(t) > 0, t).otherwise(letters))
    docs = papers.filter(abstract != "")
    # the outer form is not guarded by a filter that would tokenise a second time
    tf = (docs.select("paper_id", F.explode_outer(terms).alias("term")).filter(F.col("term").isNotNull())
          .groupBy("paper_id", "term").agg(F.count(F.lit(1)).alias("tf")))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    # one row
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n), F.col("df") <= F.col("n") * max_df)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighted = tf.join(df, "term").select("paper_id", "term", (F.col("tf") * idf).alias("weight"))
    order = [F.round("weight", SCORE_DIGITS).desc(), F.col("term").asc()]
    ranked = top_k(weighted, ["paper_id"], order, top_k_terms, ["term"])
    return ranked


__all__ = [
    "corpus_counts", "corpus_stats", "year_distribution", "top_values", "top_authors", "top_keywords",
    "journal_distribution", "keyword_pairs", "keyword_cooccurrence", "tfidf_keywords",
]
