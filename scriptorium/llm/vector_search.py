"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector v by H projections floor((a . v + b) / width) with
Gaussian a, so near vectors tend to share all of them; a bucket is the 64-bit sum
of the H slots times odd constants.  A query visits, in every table, its own bucket and
perturbed ones: moving a projection to the next slot costs the squared distance of the
query's projection to it.  Sets of moves are taken from a heap by their expected cost, given how
distances to slots are spread when sorted, and are applied to the query's own
order of distances: that is the estimated order of success.  The candidates of all
tables are ranked by exact distance and merged.

Sizes.  The width is a multiple of the standard deviation of the projections.  H is
a part of the logarithm of the number of vectors, so that buckets keep their size as the
table grows, and the number of visited buckets grows with a power of it below one.
`exact=True` looks at all vectors instead; `recall` compares both.

How it is spread.  Equal vectors are one entry that keeps its k + 1 smallest
ids, so a vector that a third of all rows share is one row.  Buckets are keys:
an entry is sent, with its vector, to the shard of its bucket in each table, and a query to the shards
of the buckets it visits, so no vector is touched that shares no visited bucket.
A shard with more than SHARD rows (a very full bucket) is dealt into pieces and its queries into
blocks of BLOCK, one task for each pair of them; no bucket and no candidate list is cut short.  Only the k + 1 best
entries of a query leave a task.  No candidate pair is ever a row.

Defined cases: vectors that are null or zero, or that hold null or non-finite
components, take no part; vectors of different lengths are never neighbours, each length has its
own tables; repeated rows (equal id and vector) are one; a query is not its own neighbour; with fewer than k candidates
all are returned; ties go to the smaller id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from scriptorium.scale import BROADCAST_ROWS, small_join

from .store import saved

TABLES = 6
# width of a slot in standard deviations of the projections
WIDTH = 2.2
# projections of a table, for each doubling of the number of vectors
HASHES = 0.75
SHARD = 8_192
BLOCK = 4_096
U64 = np.uint64


def hashes_for(n: int) -> int:
    return max(4, round(HASHES * math.log2(max(n, 2))))


def probes_for(hashes: int) -> int:
    """Buckets that a query visits in each table."""
    return 150 + round(0.37 * 2**hashes)


@lru_cache(maxsize=32)
def perturbations(hashes: int, n: int) -> np.ndarray:
    """The n sets of moves of least expected cost, as rows of places (from 1) in the sorted distances, filled up with 0.

    Place j of 2 * hashes has the expected squared distance j (j + 1) / (4 (H + 1) (H + 2)) of a slot of width 1 if j <= H,
    and place 2H + 1 - j is the move of the same projection to the other side.
    """
    h, last = hashes, 2 * hashes
    cost = [0.0] + [j * (j + 1) / (4 * (h + 1) * (h + 2)) for j in range(1, h + 1)]
    cost += [1 - (last + 1 - j) / (h + 1) + (last + 1 - j) * (last + 2 - j) / (4 * (h + 1) * (h + 2)) for j in range(h + 1, last + 1)]
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[1], (1,))]
    while heap and len(found) < n:
        total, moves = heapq.heappop(heap)
        if all(last + 1 - m not in moves for m in moves):
            found.append(moves)
        top = moves[-1]
        if top < last:
            heapq.heappush(heap, (total - cost[top] + cost[top + 1], (*moves[:-1], top + 1)))
            heapq.heappush(heap, (total + cost[top + 1], (*moves, top + 1)))
    longest = max(map(len, found))
    return np.array([m + (0,) * (longest - len(m)) for m in found], dtype=np.int64).reshape(len(found), longest)


class Table:
    """Buckets of vectors of one length in one table."""

    def __init__(self, dim: int, table: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim, table])
        self.a = rng.standard_normal((dim, hashes)) / width
        self.b = rng.random(hashes)
        self.odd = rng.integers(1, 2**63, hashes, dtype=np.int64).astype(U64) * U64(2) + U64(1)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        slots = np.floor(vectors @ self.a + self.b).astype(np.int64)
        return (slots.view(U64) * self.odd).sum(axis=1, dtype=U64)

    def visits(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """For each vector the n buckets that it visits, its own first."""
        place = vectors @ self.a + self.b
        slots = np.floor(place)
        below = place - slots
        own = (slots.astype(np.int64).view(U64) * self.odd).sum(axis=1, dtype=U64)
        order = np.argsort(np.concatenate((below, 1 - below), axis=1), axis=1)
        moves = np.concatenate((U64(0) - self.odd, self.odd))[order]
        moves = np.concatenate((np.zeros((len(vectors), 1), dtype=U64), moves), axis=1)
        out = np.repeat(own[:, None], n, axis=1)
        sets = perturbations(len(self.odd), n)
        out = out[:, :len(sets)]
        for j in range(sets.shape[1]):
            out += moves[:, sets[:, j]]
        return out


def _usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    return vectors.filter("id is not null and v is not null").filter(~bad & ~zero)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of the vectors of each length."""
    sizes = pc.list_value_length(column).to_numpy()
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield dim, rows, flat.reshape(len(rows), dim).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for dim, rows, matrix in _by_length(batch.column(0)):
            n, sums, squares = total.get(dim, (0, 0.0, 0.0))
            total[dim] = [n + len(rows), sums + matrix.sum(axis=0), squares + (matrix**2).sum()]
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()),
             pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.float64())),
             pa.array([float(t[2]) for t in total.values()], pa.float64())], names=["dim", "n", "sums", "squares"])


def _spread(parts: pa.Table) -> pa.Table:
    n = sum(parts.column("n").to_pylist())
    mean = np.sum(parts.column("sums").to_pylist(), axis=0) / n
    spread = math.sqrt(max(sum(parts.column("squares").to_pylist()) / n - float((mean**2).sum()), 1e-12))
    return pa.table({"dim": parts.column("dim").slice(0, 1), "n": pa.array([n], pa.int64()), "spread": pa.array([spread])})


def _hashed(params: dict, tables: int, seed: int):
    """Entries in every table: dim, table, shard, bucket, and the entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, matrix in _by_length(batch.column(0)):
                hashes, _, width, shards = params[dim]
                taken = batch.take(pa.array(rows))
                for t in range(tables):
                    buckets = Table(dim, t, hashes, width, seed).buckets(matrix)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), dim, dtype=np.int32)), pa.array(np.full(len(rows), t, dtype=np.int32)),
                         pa.array((buckets % U64(shards)).astype(np.int32)), pa.array(buckets.view(np.int64)),
                         taken.column(0), taken.column(1)], names=["dim", "table", "shard", "bucket", "v", "ids"])
    return run


def _visits(params: dict, tables: int, seed: int):
    """Queries in the shards of the buckets they visit: dim, table, shard, buckets, and the query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, matrix in _by_length(batch.column(0)):
                if dim not in params:
                    continue
                hashes, probes, width, shards = params[dim]
                step = max(1, (1 << 22) // probes)
                for t in range(tables):
                    table = Table(dim, t, hashes, width, seed)
                    for at in range(0, len(rows), step):
                        visits = table.visits(matrix[at:at + step], probes)
                        shard = (visits % U64(shards)).astype(np.int32)
                        order = np.argsort(shard, axis=1, kind="stable")
                        visits, shard = np.take_along_axis(visits, order, 1), np.take_along_axis(shard, order, 1)
                        new = np.ones(shard.shape, dtype=bool)
                        new[:, 1:] = shard[:, 1:] != shard[:, :-1]
                        starts = np.flatnonzero(new)
                        owner = starts // visits.shape[1]
                        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, new.size).astype(np.int32)),
                                                         pa.array(visits.ravel().view(np.int64)))
                        taken = batch.take(pa.array(rows[at + owner]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(starts), dim, dtype=np.int32)), pa.array(np.full(len(starts), t, dtype=np.int32)),
                             pa.array(shard.ravel()[starts]), lists, taken.column(0), taken.column(1)],
                            names=["dim", "table", "shard", "buckets", "v", "query_id"])
    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _search_of(k: int, exact: bool):
    none = {"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())}

    def search(held: pa.Table, posed: pa.Table) -> pa.Table:
        if not held.num_rows or not posed.num_rows:
            return pa.table(none)
        held = held.sort_by("bucket")
        matrix, ids = _matrix(held.column("v")), held.column("ids").combine_chunks()
        firsts = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        buckets, starts = np.unique(held.column("bucket").to_numpy(), return_index=True)
        starts = np.append(starts, len(matrix))
        lists = posed.column("buckets").combine_chunks()
        ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        owners, found, scores = [], [], []
        for i, query in enumerate(_matrix(posed.column("v"))):
            if exact:
                near = np.arange(len(matrix))
            else:
                asked = flat[ends[i]:ends[i + 1]]
                at = np.minimum(np.searchsorted(buckets, asked), len(buckets) - 1)
                at = at[buckets[at] == asked]
                sizes = starts[at + 1] - starts[at]
                stop = np.cumsum(sizes)
                near = np.repeat(starts[at] - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)
            distance = np.sqrt(((matrix[near] - query) ** 2).sum(axis=1))
            if len(near) > 4 * k:
                close = np.flatnonzero(distance <= np.partition(distance, k)[k])
                near, distance = near[close], distance[close]
            order = np.lexsort((firsts[near], distance))[:k + 1]
            owners.append(np.full(len(order), i))
            found.append(near[order])
            scores.append(distance[order])
        owners = pa.array(np.concatenate(owners))
        return pa.table({"query_id": posed.column("query_id").combine_chunks().take(owners),
                         "ids": ids.take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(scores))})
    return search


def nearest_vectors(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    k: int = 10, hashes: int | None = None, probes: int | None = None, tables: int = TABLES,
                    width: float = WIDTH, seed: int = 11, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest found, by Euclidean distance."""
    def plain(df: DataFrame) -> DataFrame:
        given = df.schema[vector_col].dataType
        kind = "array<float>" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "array<double>"
        return _usable(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("v")))

    own = plain(vectors)
    # equal vectors: entries with the k + 1 smallest ids
    keyed = own.distinct().withColumn("e", F.xxhash64("v"))
    rank = F.row_number().over(Window.partitionBy("e", "v").orderBy("id"))
    entries = keyed.withColumn("n", rank).filter(F.col("n") <= k + 1).groupBy("e", "v").agg(
        F.array_sort(F.collect_list("id")).alias("ids"))
    entries = saved(entries.select("v", "ids"), "entries")
    # a row for each length of vectors
    stats = entries.select("v").mapInArrow(_moments, "dim int, n bigint, sums array<double>, squares double").groupBy(
        "dim").applyInArrow(_spread, "dim int, n bigint, spread double").collect()
    params = {}
    for s in stats:
        h = hashes or hashes_for(s["n"])
        params[s["dim"]] = (h, probes or probes_for(h), width * s["spread"], max(1, math.ceil(s["n"] / SHARD)))
    few = 2 * tables * sum(p[3] for p in params.values()) <= BROADCAST_ROWS
    vector = entries.schema["v"].dataType.simpleString()
    asked = plain(queries).distinct().select(F.col("v").cast(vector).alias("v"), F.col("id").alias("query_id"))
    if exact:
        sizes = F.size("v").alias("dim")
        shards = F.create_map(*[F.lit(x) for d, p in params.items() for x in (d, p[3])]) if params else F.create_map(F.lit(0), F.lit(1))
        index = entries.select(sizes, F.lit(0).alias("table"), F.pmod(F.xxhash64("v"), shards[F.size("v")]).cast("int").alias("shard"),
                               F.lit(0).cast("bigint").alias("bucket"), "v", "ids")
        every = F.explode(F.sequence(F.lit(0), shards[F.size("v")] - 1))
        visits = asked.filter(shards[F.size("v")].isNotNull()).select(
            sizes, F.lit(0).alias("table"), every.alias("shard"), F.array(F.lit(0).cast("bigint")).alias("buckets"), "v", "query_id")
    else:
        index = entries.mapInArrow(_hashed(params, tables, seed),
                                   f"dim int, table int, shard int, bucket bigint, v {vector}, ids array<bigint>")
        visits = asked.mapInArrow(_visits(params, tables, seed),
                                  f"dim int, table int, shard int, buckets array<bigint>, v {vector}, query_id bigint")
    keys = ["dim", "table", "shard"]
    held = index.groupBy(keys).agg(F.ceil(F.count("*") / (2 * SHARD)).cast("int").alias("pieces"))
    posed = visits.groupBy(keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = saved(held.join(posed, keys), "sizes")

    def dealt(df: DataFrame, own_: str, copies: str) -> DataFrame:
        sized = small_join(df, sizes, keys, spread_by=["v"], fits=few)
        return sized.withColumn(own_[:-1], F.pmod(F.xxhash64("v"), F.col(own_)).cast("int")).withColumn(
            copies[:-1], F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("pieces", "blocks")

    cells = [*keys, "piece", "block"]
    hits = dealt(index, "pieces", "blocks").groupBy(cells).cogroup(dealt(visits, "blocks", "pieces").groupBy(cells)).applyInArrow(
        _search_of(k, exact), "query_id bigint, ids array<bigint>, score double")
    # tables find the same entries; a query id with two vectors keeps the nearer one
    rows = hits.select("query_id", "score", F.explode("ids").alias("id")).filter("id <> query_id").groupBy("query_id", "id").agg(
        F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def recall(vectors: DataFrame, queries: DataFrame, k: int = 10, **options) -> float:
    """Share of the true k nearest of all queries that are found."""
    queries = saved(queries, "asked")
    found = nearest_vectors(vectors, queries, k=k, **options).select("query_id", "id")
    true = saved(nearest_vectors(vectors, queries, k=k, exact=True).select("query_id", "id"), "true")
    return true.join(found, ["query_id", "id"]).count() / max(true.count(), 1)
