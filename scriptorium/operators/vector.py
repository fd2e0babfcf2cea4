"""Exact vector search for a table of query vectors.

Scores are matrix products of chunk batches and query vectors inside Arrow
tasks.  A task keeps only the best k chunks per query, so no list of pairs is
ever written.  A checked number of query vectors is sent to every task; more
are tiled against chunk tiles of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine
from ..scale import SCORE_DIGITS, by_score, global_rank, is_small, stored, top_k
from .scopes import Scopes

QUERY_BLOCK = 2048
CHUNK_TILE = 50_000
HIT_SCHEMA = "query_id {q}, chunk_id string, paper_id string, chunk_index int, score double"


def _matrix(vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision and their norms; 0 for a vector of another length."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            out[i] = v
    return out, np.sqrt(np.einsum("ij,ij->i", out, out))


def _column_vectors(column: pa.Array) -> list:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    null = column.is_null().to_numpy(zero_copy_only=False)
    return [None if null[i] else values[offsets[i]:offsets[i + 1]] for i in range(len(column))]


class _Best:
    """Running best k chunks of each query in one task."""

    def __init__(self, ids, vectors, wants, k, floor):
        self.ids, self.k, self.floor = ids, k, floor
        self.wants = [None if w is None else frozenset(w) for w in wants]
        self.blocks = {}
        for size in {len(v) for v in vectors if v is not None and len(v)}:
            rows = [i for i, v in enumerate(vectors) if v is not None and len(v) == size]
            matrix, norms = _matrix([vectors[i] for i in rows], size)
            good = norms > 0
            self.blocks[size] = (np.array(rows)[good], matrix[good], norms[good])
        self.kept = {}

    def _allowed(self, scopes) -> dict:
        """For each distinct want of the queries, which chunks may be returned; distinct sets of scopes are tested once."""
        numbers = {}
        codes = np.array([numbers.setdefault(tuple(s), len(numbers)) for s in scopes], dtype=np.int64)
        return {want: np.array([want.issubset(s) for s in numbers], dtype=bool)[codes]
                for want in set(self.wants) if want is not None}

    def add(self, chunk_ids, paper_ids, indexes, vectors, scopes):
        allowed = self._allowed(scopes)
        for size, (rows, queries, query_norms) in self.blocks.items():
            matrix, norms = _matrix(vectors, size)
            good = norms > 0
            scores = (matrix @ queries.T) / np.outer(np.where(good, norms, 1.0), query_norms)
            floor = max(self.floor, 0.0)
            for j, row in enumerate(rows):
                column = scores[:, j]
                hit = good & (column > 0) & (column >= floor)
                want = self.wants[row]
                if want is not None:
                    hit &= allowed[want]
                old = self.kept.get(row, [])
                if self.k > 0 and len(old) >= self.k:
                    hit &= np.round(column, SCORE_DIGITS) >= -old[self.k - 1][0]
                found = np.flatnonzero(hit)
                if not len(found):
                    continue
                if 0 < self.k < len(found):
                    # ids only for what can be among the best k after rounding
                    least = np.partition(column[found], -self.k)[-self.k]
                    found = found[column[found] >= least - 10.0**-SCORE_DIGITS]
                # same order as the final ranking: rounded score, then id
                new = [(-round(float(column[i]), SCORE_DIGITS), chunk_ids[i], paper_ids[i], indexes[i],
                        float(column[i])) for i in found]
                merged = sorted(old + new)
                self.kept[row] = merged[:self.k] if self.k > 0 else merged

    def table(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(self.ids[q], c, p, n, s) for q, kept in self.kept.items() for _, c, p, n, s in kept]
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow_schema(query_type: pa.DataType) -> pa.Schema:
    return pa.schema([("query_id", query_type), ("chunk_id", pa.string()), ("paper_id", pa.string()),
                      ("chunk_index", pa.int32()), ("score", pa.float64())])


def _feed(best: _Best, batch) -> None:
    best.add(batch.column("chunk_id").to_pylist(), batch.column("paper_id").to_pylist(),
             batch.column("chunk_index").to_pylist(), _column_vectors(batch.column("embedding")),
             [s or () for s in batch.column("scopes").to_pylist()])


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _scored(chunks: DataFrame, queries: DataFrame, floor: float, k: int) -> DataFrame:
    """Candidates of every task; `queries` is (query_id, q_vec, want)."""
    query_type = queries.schema["query_id"].dataType
    schema = HIT_SCHEMA.format(q=query_type.simpleString())
    arrow_type = pa.int64() if query_type.simpleString() == "bigint" else (
        pa.int32() if query_type.simpleString() == "int" else pa.string())
    spark = chunks.sparkSession
    if is_small(queries, QUERY_BLOCK):
        rows = queries.collect()  # at most QUERY_BLOCK rows, checked above
        shared = spark.sparkContext.broadcast(
            ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))

        def best_of_partition(batches):
            ids, vectors, wants = shared.value
            best = _Best(ids, [None if v is None else np.asarray(v, dtype=float) for v in vectors], wants, k, floor)
            for batch in batches:
                _feed(best, batch)
                if k <= 0:  # nothing to keep back: every hit is wanted
                    yield best.table(_arrow_schema(arrow_type))
                    best.kept = {}
            yield best.table(_arrow_schema(arrow_type))

        return chunks.mapInArrow(best_of_partition, schema)

    chunk_tiles = max(1, math.ceil(chunks.count() / CHUNK_TILE))
    query_tiles = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    left = (
        chunks.withColumn("ct", F.pmod(F.xxhash64("chunk_id"), F.lit(chunk_tiles)))
        .withColumn("qt", F.explode(_numbers(query_tiles))))
    right = (
        queries.withColumn("qt", F.pmod(F.xxhash64("query_id"), F.lit(query_tiles)))
        .withColumn("ct", F.explode(_numbers(chunk_tiles))))

    def best_of_tile(chunk_table: pa.Table, query_table: pa.Table) -> pa.Table:
        query_table = query_table.combine_chunks()
        vectors = [None if v is None else np.asarray(v, dtype=float) for v in query_table["q_vec"].to_pylist()]
        best = _Best(query_table["query_id"].to_pylist(), vectors, query_table["want"].to_pylist(), k, floor)
        for batch in chunk_table.to_batches(max_chunksize=10_000):
            _feed(best, batch)
        return pa.Table.from_batches([best.table(_arrow_schema(arrow_type))])

    return left.groupBy("ct", "qt").cogroup(right.groupBy("ct", "qt")).applyInArrow(best_of_tile, schema)


def vector_search(chunks: DataFrame, query_vecs: DataFrame, scopes: Scopes | None = None,
                  min_score: float = 0.0, k: int = 200) -> DataFrame:
    """chunk_hits(query_id, chunk_id, paper_id, chunk_index, score, rank).

    Chunks without a vector, with score <= 0 or below the floor are skipped.
    """
    no_scope = F.lit(None).cast("array<string>")
    pool = chunks.select("chunk_id", "paper_id", "chunk_index", "embedding").filter(F.col("embedding").isNotNull())
    asked = query_vecs.select("query_id", "q_vec")
    if scopes is None:
        pool, asked = pool.withColumn("scopes", no_scope), asked.withColumn("want", no_scope)
    else:
        pool = pool.join(scopes.papers.select("paper_id", "scopes"), "paper_id", "left")
        asked = asked.join(scopes.queries.select("query_id", F.col("scopes").alias("want")), "query_id", "left")
    scored = _scored(pool.select("chunk_id", "paper_id", "chunk_index", "embedding", "scopes"),
                     asked.select("query_id", "q_vec", "want"), min_score, k)
    order = [F.round("score", SCORE_DIGITS).desc(), F.col("chunk_id").asc()]
    return top_k(scored, ["query_id"], order, k, ["chunk_id"])


def shared_vector_search(chunks: DataFrame, query_vecs: DataFrame, k: int = 200) -> DataFrame:
    """`vector_search` without scopes, where many chunks hold the same vector: each is compared once.

    A vector stands with its smallest chunk_id.  Among the best k such vectors are all that hold one of the best k
    chunks; those behind k chunks of better vectors are left out before the chunks of a vector are listed.
    """
    if k <= 0:
        return vector_search(chunks, query_vecs, None, 0.0, k)
    pool = chunks.select("chunk_id", "paper_id", "chunk_index", "embedding").filter(F.col("embedding").isNotNull())
    # of chunks that score alike only the first k by id can be among the best, so a common vector makes no long row
    first = top_k(pool, ["embedding"], [F.col("chunk_id").asc()], k, ["chunk_id"])
    groups = stored(first.groupBy("embedding").agg(
        F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("n"),
        F.collect_list(F.struct("chunk_id", "paper_id", "chunk_index")).alias("chunks")))
    alone = groups.select("chunk_id", F.lit("").alias("paper_id"), F.lit(0).alias("chunk_index"), "embedding")
    hits = vector_search(alone, query_vecs, None, 0.0, k).select("query_id", "chunk_id", "score")
    sized = hits.join(groups.select("chunk_id", "n"), "chunk_id")
    score = F.round("score", SCORE_DIGITS)
    upto = Window.partitionBy("query_id").orderBy(score.desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("query_id", score)
    open_ = sized.withColumn("_before", F.sum("n").over(upto) - F.sum("n").over(same)).filter(F.col("_before") < k)
    listed = open_.select("query_id", "chunk_id", "score").join(
        groups.select("chunk_id", "chunks"), "chunk_id").select("query_id", "score", F.inline("chunks"))
    order = [score.desc(), F.col("chunk_id").asc()]
    return top_k(listed.select("query_id", "chunk_id", "paper_id", "chunk_index", "score"), ["query_id"], order, k, ["chunk_id"])


def chunks_to_papers(chunk_hits: DataFrame, k: int = 200) -> DataFrame:
    """Best chunk score per paper, ranked."""
    best = chunk_hits.groupBy("query_id", "paper_id").agg(F.max("score").alias("score"))
    best = best.withColumn("matched_fields", F.array(F.lit("chunk")))
    return top_k(best, ["query_id"], by_score("score", "paper_id"), k, ["paper_id"])


def rank_chunks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """All chunks of the requested papers, by cosine, or by chunk_index without a vector.

    requests(query_id, paper_id, q_vec); q_vec NULL asks for reading order.
    """
    joined = chunks.select("chunk_id", "paper_id", "chunk_index", "embedding").join(requests, "paper_id")
    scored = joined.withColumn(
        "score", F.when(F.col("q_vec").isNull(), F.lit(0.0)).otherwise(cosine("embedding", "q_vec")))
    order = [F.round("score", SCORE_DIGITS).desc(), F.col("chunk_index").asc(), F.col("chunk_id").asc()]
    return global_rank(scored.drop("embedding", "q_vec"), ["query_id", "paper_id"], order)
