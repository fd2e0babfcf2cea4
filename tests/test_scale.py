"""Long lists are stored compressed while they are numbered."""

import os

from pyspark.sql import functions as F

from scriptorium import scale
from scriptorium.operators.bm25 import Matches, bm25_search
from scriptorium.operators.ranking import sort_by_year
from scriptorium.scale import global_rank, in_batches, rank_batches, top_k
from scriptorium.sources.index import build_index

PAPER = "paper_id string, title string, keywords string, abstract string, research_design_text string, raw_body string, publish_year int"


def test_global_rank_stores_columns_not_rows(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("q"), F.array(F.lit("title"), F.lit("body")).alias("fields"), "id")
    ranked = global_rank(rows, ["q"], [F.col("id").desc()])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "ExistingRDD" not in plan
    got = {(r.q, r["rank"]): (r.id, r.fields) for r in ranked.collect()}
    assert got == {(q, n + 1): (i, ["title", "body"]) for q in range(3) for n, i in enumerate(sorted(range(q, 200, 3), reverse=True))}


def _shuffle_bytes(spark):
    root = spark.conf.get("spark.local.dir", "/tmp")
    blocks = [os.path.join(p, f) for p, _, names in os.walk(root) for f in names if f.startswith("shuffle_") and f.endswith(".data")]
    return sum(os.path.getsize(f) for f in blocks if os.path.exists(f))


def test_whole_lists_are_shuffled_once_and_leave_no_shuffle_files(spark):
    rows = spark.range(50_000).select((F.col("id") % 7).alias("q"), F.md5(F.col("id").cast("string")).alias("key"))
    before = _shuffle_bytes(spark)
    ranked = global_rank(rows, ["q"], [F.col("key").asc()])
    # 32 characters a row were shuffled; what small counts leave is far less
    assert _shuffle_bytes(spark) - before < 200_000
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # only the counts by partition are shuffled again
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(_part" not in plan and "Sort [_part" not in plan
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.q, r.key)):
        want[r.key] = want.get((r.q,), 0) + 1
        want[r.q,] = want[r.key]
    assert all(r["rank"] == want[r.key] for r in ranked.collect())


def test_batches_number_like_one_table(spark, monkeypatch):
    monkeypatch.setattr(scale, "BATCH_ROWS", 40)
    rows = spark.range(300).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("q"), (F.col("id") * 7 % 11 / 3).alias("s"), "id")
    parts = in_batches(rows, ["q"])
    assert len(parts) == 8 and sum(p.count() for p in parts) == 300
    order = [F.round("s", 1).desc(), F.col("id").asc()]
    got = rank_batches(parts, ["q"], [(F.round("s", 1), False), F.col("id").asc()])
    assert got.columns == ["q", "s", "id", "rank"]
    assert sorted(got.collect(), key=str) == sorted(top_k(rows, ["q"], order, 1000, ["id"]).collect(), key=str)


def _papers(spark):
    words = ("red", "blue", "green", "old", "new")
    rows = [(f"p{i:02d}", words[i % 5], None, f"{words[i % 3]} {words[i % 4]} {'x ' * (i % 6)}", words[i % 2], "", None if i % 9 == 0 else 2000 + i % 4)
            for i in range(60)]
    return spark.createDataFrame(rows, PAPER), spark.createDataFrame(
        [(i, t) for i, t in enumerate(("red old", "blue", "green new", "x", "none"))], "query_id long, q string")


def test_matches_by_year_equal_sorted_lists(spark, monkeypatch):
    papers, queries = _papers(spark)
    index = build_index(papers)
    whole = bm25_search(index, queries, k=0)
    want = sort_by_year(whole, papers).collect()
    monkeypatch.setattr(scale, "BATCH_ROWS", 90)
    matches = Matches(index, queries)
    assert len(matches.batches()) > 1
    assert sorted(sort_by_year(matches, papers).collect()) == sorted(want)
    assert sorted(bm25_search(index, queries, k=0).collect()) == sorted(whole.collect())
    assert sorted(bm25_search(index, queries, k=900).collect()) == sorted(whole.collect())
