"""BM25 of very many queries whose distinct terms are few: every query against every paper, in tiles.

The papers' postings for the terms of the batch are stored once, in number form, one row a paper.  A task
takes some of the queries and streams these postings past them, a block of queries and a slice of papers at a time,
so it keeps the best k papers of its own queries only and no list of (query, paper) pairs is ever written or shuffled.
The time is that of all pairs; memory is bounded by block and slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..scale import scratch_path
from ..sources.index import Index
from .pruned import query_type
from .tokenwise import HITS, Best, Queries, code_bits, factors, first_numbers, impacts, row_postings, slices, with_fields

QUERY_TILE = 1_024
PAPERS = 8_192
POSTINGS = "paper_id string, codes array<int>, tfs array<int>, lengths array<int>"


def store_postings(tokens: DataFrame, vocabulary: dict[str, list[str]]) -> str:
    """Numbers and counts of the given terms in each paper, and the lengths of its fields, as Parquet files."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {f: pa.array(v, pa.string()) for f, v in shared.value.items()}
        for batch in batches:
            row, code, tf, lengths = row_postings(batch, words)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            whole = pa.array(np.arange(batch.num_rows + 1) * len(words), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("paper_id"),
                pa.ListArray.from_arrays(ends, pa.array(code, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
                pa.ListArray.from_arrays(whole, pa.array(lengths.T.reshape(-1), pa.int32()))],
                names=["paper_id", "codes", "tfs", "lengths"])

    path = scratch_path(tokens.sparkSession, "postings")
    tokens.mapInArrow(write, POSTINGS).write.parquet(path)
    return path


def tiled_hits(index: Index, terms: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(query_id, paper_id, score, matched_fields) of the best k papers of each query.

    terms(query_id, field, term, weight, title_active) may be many; known(field, term, weight), their distinct
    terms, were found small enough to broadcast.
    """
    spark = terms.sparkSession
    kind = terms.schema["query_id"].dataType.simpleString()
    weights = {(r["field"], r["term"]): r["weight"] for r in known.collect()}
    vocabulary = {f: sorted(t for g, t in weights if g == f) for f in rules.FIELDS}
    vocabulary = {f: v for f, v in vocabulary.items() if v}
    first = first_numbers(vocabulary)
    path = store_postings(index.tokens, vocabulary)
    postings = spark.read.schema(POSTINGS).parquet(path)
    # a row per term, and one of lengths
    found = {r["code"]: r["count"] for r in postings.select(F.explode("codes").alias("code")).groupBy("code").count().collect()}
    sums = postings.agg(F.count(F.lit(1)), *[F.sum(F.get("lengths", F.lit(i))) for i in range(len(vocabulary))]).first()
    average = {f: (sums[i + 1] or 0) / max(sums[0], 1) for i, f in enumerate(vocabulary)}
    factor = factors(
        vocabulary, np.array([weights[f, t] for f, v in vocabulary.items() for t in v], dtype=float),
        np.array([found.get(i, 0) for i in range(len(weights))], dtype=float), dict.fromkeys(vocabulary, sums[0]))
    codes = spark.createDataFrame(
        [(f, t, first[f] + i) for f, v in vocabulary.items() for i, t in enumerate(v)], "field string, term string, code int")
    # terms that no paper holds add nothing
    asked = (terms.filter("query_id is not null").join(F.broadcast(codes), ["field", "term"])
             .groupBy("query_id").agg(F.collect_list("code").alias("codes"), F.max("title_active").alias("title_active")))
    tiles = max(1, math.ceil(terms.select("query_id").distinct().count() / QUERY_TILE))
    shared = spark.sparkContext.broadcast((vocabulary, factor, average))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, factor, average = shared.value
        bit = code_bits(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_TILE):
                part = batch.slice(at, QUERY_TILE)
                held = part.column("codes")
                size = np.diff(held.offsets.to_numpy())
                queries = Queries(
                    part.column("query_id").to_pylist(), held.flatten().to_numpy().astype(np.int64),
                    np.repeat(np.arange(len(size)), size), part.column("title_active").to_numpy(zero_copy_only=False), len(factor))
                best = Best(queries, query_type(kind), k)
                for papers in ds.dataset(path.removeprefix("file:"), format="parquet").to_batches(batch_size=PAPERS):
                    lists = papers.column("codes")
                    many = np.diff(lists.offsets.to_numpy())
                    row, code = np.repeat(np.arange(len(many)), many), lists.flatten().to_numpy()
                    tf = papers.column("tfs").flatten().to_numpy()
                    lengths = papers.column("lengths").flatten().to_numpy().reshape(len(many), -1).T
                    impact = impacts(vocabulary, factor, average, row, code, tf, lengths)
                    for a, z, total, bits in slices(queries, bit, len(many), row, code, impact):
                        best.add(papers.column("paper_id").slice(a, z - a), total, bits)
                yield from best.rows()

    return with_fields(asked.repartition(tiles, "query_id").mapInArrow(search, HITS.format(q=kind)))
