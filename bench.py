"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed; the median of the timed runs
counts.  Search queries use the stored index, whose building is timed on its
own; results are written to the no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    from checks.compare import session
    from checks.registry import Data
    from scriptorium.operators import packing as pk
    from scriptorium.operators import statistics as st
    from scriptorium.operators.bm25 import bm25_search
    from scriptorium.operators.embedding import embed_texts
    from scriptorium.operators.facets import facets
    from scriptorium.operators.vector import vector_search
    from scriptorium.plans.search import smart_search
    from scriptorium.sources.index import write_index

    spark = session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    d = Data(spark, SF_DIR)
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    state = {}

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    def build():
        state["n"] = state.get("n", 0) + 1
        state["index"] = write_index(d.papers, f"{scratch}/index-{state['n']}", term_buckets=16)
        assert not state["index"].postings.isEmpty()

    def bm25(k=50):
        return bm25_search(state["index"], d.queries.select("query_id", "q"), k=k)

    def whole(result):
        for part in (result.golden, result.keyword_hits, result.vector_hits, result.facets):
            sink(part)

    def docs():
        return d.para_docs.selectExpr("cast(doc_id as string) paper_id", "paras")

    queries = {
        "build_index": build,
        "bm25_search": lambda: sink(bm25()),
        "vector_search": lambda: sink(vector_search(d.chunks, d.queries, None, 0.2, 200)),
        "smart_search": lambda: whole(smart_search(
            state["index"], d.papers, d.chunks, d.queries, floor=0.2)),
        "facets": lambda: sink(facets(bm25(500), d.papers)),
        "keyword_cooccurrence": lambda: sink(st.keyword_cooccurrence(d.papers)),
        "tfidf_keywords": lambda: sink(st.tfidf_keywords(d.papers)),
        "chunk_papers": lambda: sink(pk.chunk_papers(docs(), "greedy")),
        "chunk_papers_semantic": lambda: sink(pk.chunk_papers(docs(), "semantic")),
        "embed_texts": lambda: sink(embed_texts(d.documents, "text", "vector").select("doc_id", "vector")),
    }
    seconds = {}
    for name, query in queries.items():
        query()
        times = []
        for _ in range(RUNS):
            start = time.time()
            query()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times), 3)
    scale = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
