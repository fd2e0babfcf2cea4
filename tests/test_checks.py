"""Some registered queries against their SQL twins; checks.compare runs all of them."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import registry
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ("hard_filter", "corpus_stats", "keyword_cooccurrence", "facets", "bm25_search", "boolean_search",
          "vector_search", "smart_search_low_floor", "split_chapters", "chunk_papers", "citations", "citation_audit",
          "match_metadata", "stream_upsert", "stream_statistics")


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_sql(spark, name):
    outcome = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert outcome.startswith("equal"), outcome


def test_every_query_has_an_oracle():
    assert set(registry.ORACLES) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_chunks_cover_all_documents(spark):
    data = registry.Data(spark, SF)
    chunks = data.chunks
    assert chunks.select("paper_id").distinct().count() == data.documents.count()
    whole = chunks.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("chunk_index", F.coalesce("chunk_text", F.lit(""))))), lambda x: x["col2"]), "").alias("t"))
    assert whole.join(data.papers, "paper_id").filter(F.col("t") != F.coalesce("raw_body", F.lit(""))).isEmpty()
    assert chunks.filter("embedding is null").isEmpty()


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
