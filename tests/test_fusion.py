"""Whole lists are fused some queries at a time."""

from pyspark.sql import functions as F

from scriptorium import scale
from scriptorium.operators.bm25 import bm25_search
from scriptorium.operators.fusion import rrf_fuse, rrf_scores
from scriptorium.scale import global_rank, top_k
from scriptorium.sources.index import build_index

from test_scale import _papers


def test_whole_lists_are_fused_in_batches(spark, monkeypatch):
    papers, queries = _papers(spark)
    a = bm25_search(build_index(papers), queries, k=0)
    b = global_rank(a.drop("rank").withColumn("matched_fields", F.array(F.lit("chunk"))), ["query_id"], [F.col("paper_id").asc()])
    want = top_k(rrf_scores(a, b), ["query_id"], [F.round("score", 12).desc(), F.col("paper_id").asc()], 900, ["paper_id"])
    monkeypatch.setattr(scale, "BATCH_ROWS", 100)
    whole = rrf_fuse(a, b)
    assert sorted(whole.collect()) == sorted(want.select(*whole.columns).collect())
    # an unnamed field has no bit
    odd = b.withColumn("matched_fields", F.array(F.lit("chunk"), F.lit(None).cast("string")))
    want = top_k(rrf_scores(a, odd), ["query_id"], [F.round("score", 12).desc(), F.col("paper_id").asc()], 900, ["paper_id"])
    whole = rrf_fuse(a, odd)
    assert sorted(whole.collect(), key=str) == sorted(want.select(*whole.columns).collect(), key=str)
    assert rrf_fuse(a.limit(0), b.limit(0)).collect() == []
