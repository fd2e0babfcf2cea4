"""Exact k nearest binary codes in Hamming distance by incremental multi-index hashing.

Codes are arrays of 64-bit words (or single bigints), cut into m segments that are
indexed one by one; m follows from the number of codes, so that a segment has
about as many values as there are codes.  Round r looks, for every query that is not
finished, at all values of each segment at distance r from the query's.  After round r
every code within distance m * (r + 1) - 1 has been met, because one of its segments differs in at
most r bits; a query is finished as soon as its k-th best verified distance is
within that bound, which proves the result exact.  Radii grow until then.

How it is spread.  A segment is indexed in shards by the top bits of its value, which hold
about SHARD codes; a query enters a shard with the radius that its own top bits leave, and
the values at that distance are enumerated inside the task: by masks, or by the distances
of the shard's own distinct values where these are fewer.  So what is shuffled is a
row per query and shard, never a row per probed value, and nothing is broadcast but counts of
shards that were checked to be few.  A shard that holds more codes than SHARD (codes that agree in a segment) is
dealt into pieces, and its queries into blocks of BLOCK; a task has one pair of them.
Only a query's best codes leave a task.

Equal codes are one entry that keeps its k + 1 smallest ids: no other id of the
code can be among the nearest k, so a code shared by a third of all rows is one
row of the index and nothing is lost.  Equal queries are one query.

Result: query_id, rank (from 1), id, distance; nearest first, ties to the smaller
id; a query is not its own neighbour.

Defined cases: rows whose code or id is null, or whose code holds a null, take no part; repeated rows (equal
id and code) are one row; codes with fewer words are filled up with zero bits; fewer than k candidates give fewer
rows; empty tables give an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from scriptorium.scale import BROADCAST_ROWS, small_join

from .store import saved

SHARD = 32_768
BLOCK = 2_048


def sign_code(vector: Column, bits: int | None = None) -> Column:
    """Bit i is set where component i is positive; null for a null vector or one with nulls.

    One bigint for the first `bits` (64 at most) components, or, without `bits`, an array of bigints for all of them.
    """
    def word(first: Column, n: Column) -> Column:
        picked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(
            F.get(vector, first + i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
                F.lit(0).cast("bigint")))
        return F.aggregate(picked, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    if bits is not None:
        code = word(F.lit(0), F.lit(bits))
    else:
        words = F.ceil(F.greatest(F.size(vector), F.lit(1)) / 64).cast("int")
        code = F.transform(F.sequence(F.lit(0), words - 1), lambda j: word(j * 64, F.lit(64)))
    return F.when(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull()), code)


@lru_cache(maxsize=256)
def _masks(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits with `radius` bits set."""
    if radius == 0:
        return np.zeros(1, dtype=np.uint64)
    chosen = np.array(list(combinations(range(width), radius)), dtype=np.uint64).reshape(-1, radius)
    return (np.uint64(1) << chosen).sum(axis=1, dtype=np.uint64)


def cut(bits: int, codes: int) -> list[tuple[int, int, int]]:
    """Segments as (word, shift, width): as wide as the logarithm of the number of codes, none across two words."""
    width = min(max(math.log2(max(codes, 2)), 4), 32)
    out = []
    for word in range(-(-bits // 64)):
        here = min(64, bits - 64 * word)
        n = max(1, round(here / width))
        edges = [here * i // n for i in range(n + 1)]
        out += [(word, a, b - a) for a, b in zip(edges, edges[1:])]
    return out


def _even(bits: int, segments: int) -> list[tuple[int, int, int]]:
    if bits > 64 or bits % segments:
        raise ValueError("segments must divide the bits, of which there are 64 at most; leave it out otherwise")
    return [(0, bits // segments * j, bits // segments) for j in range(segments)]


def _value(codes: np.ndarray, part: tuple[int, int, int]) -> np.ndarray:
    word, shift, width = part
    return (codes[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def search_shard(codes: np.ndarray, queries: np.ndarray, left: np.ndarray, limits: np.ndarray, parts, segment: int,
                 low: int, radius: int):
    """Pairs (query, code, distance) that are met in this segment in round `radius`, and in no earlier place.

    left: errors that each query's top bits leave for the `low` lowest bits of the segment;
    limits: distances beyond which a query does not care.
    """
    part = parts[segment]
    below = np.uint64((1 << low) - 1)
    values, start = np.unique(_value(codes, part) & below, return_inverse=True)
    order = np.argsort(start, kind="stable")
    first = np.searchsorted(start[order], np.arange(len(values) + 1))
    asked = _value(queries, part) & below
    out = []
    for q in range(len(queries)):
        if math.comb(low, int(left[q])) < len(values):
            probes = asked[q] ^ _masks(low, int(left[q]))
            at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
            hit = at[values[at] == probes]
        else:
            hit = np.flatnonzero(np.bitwise_count(values ^ asked[q]) == left[q])
        if not len(hit):
            continue
        sizes = first[hit + 1] - first[hit]
        ends = np.cumsum(sizes)
        met = order[np.repeat(first[hit] - (ends - sizes), sizes) + np.arange(ends[-1])]
        differs = codes[met] ^ queries[q]
        distance = np.bitwise_count(differs).sum(axis=1, dtype=np.int64)
        near = distance <= limits[q]
        met, differs, distance = met[near], differs[near], distance[near]
        # a pair is met once: in the round of its least segment distance, in the first segment that has it
        once = np.ones(len(met), dtype=bool)
        for j, other in enumerate(parts):
            if j != segment:
                errors = np.bitwise_count(_value(differs, other))
                once &= errors > radius if j < segment else errors >= radius
        out.append((np.full(once.sum(), q), met[once], distance[once]))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _matrix(column: pa.ChunkedArray, words: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).view(np.uint64).reshape(-1, words)


def _best(met: DataFrame, k: int) -> DataFrame:
    """The k + 1 first codes of each query by distance and smallest id: they hold its first k + 1 ids."""
    order = Window.partitionBy("query").orderBy("distance", "first_id")
    return met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")


def nearest_codes(rows: DataFrame, queries: DataFrame, id_col: str = "id", code_col: str = "code", k: int = 10,
                  bits: int | None = None, segments: int | None = None) -> DataFrame:
    """`bits` is the number of bits in use, by default all of the words; `segments` by default follows the number of codes."""
    def plain(df: DataFrame, name: str) -> DataFrame:
        given = F.col(code_col)
        code = given.cast("array<bigint>") if isinstance(df.schema[code_col].dataType, ArrayType) else F.array(given.cast("bigint"))
        out = df.select(F.col(id_col).alias(name), code.alias("code"))
        return out.filter(F.col(name).isNotNull() & F.col("code").isNotNull() & ~F.exists("code", lambda x: x.isNull()))

    own, asked = plain(rows, "id"), plain(queries, "query_id")
    words = own.agg(F.max(F.size("code"))).first()[0] or 1
    words = max(words, asked.agg(F.max(F.size("code"))).first()[0] or 1)

    def filled(df: DataFrame) -> DataFrame:
        padded = F.slice(F.concat("code", F.array_repeat(F.lit(0).cast("bigint"), words)), 1, words)
        return df.withColumn("code", padded).distinct()

    # the k + 1 smallest ids of each code
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    first = filled(own).withColumn("n", rank).filter(F.col("n") <= k + 1)
    codes = saved(first.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = saved(filled(asked).withColumnRenamed("code", "query"), "queries")
    n_codes = codes.count()
    bits = bits or 64 * words
    parts = _even(bits, segments) if segments else cut(bits, n_codes)
    top = max(0, math.ceil(math.log2(max(n_codes, 1) / SHARD)))
    tops = [min(top, width) for _, _, width in parts]
    # the number of shards is known, so tables with a row for each can be broadcast or not
    few = len(parts) << top <= BROADCAST_ROWS

    def shards(code: str) -> Column:
        """Segment and top bits of its value."""
        return F.explode(F.array(*[F.struct(
            F.lit(j).alias("segment"), F.lit(tops[j]).alias("bits"),
            F.shiftrightunsigned(F.get(code, F.lit(word)), shift + width - tops[j]).bitwiseAND(
                F.lit((1 << tops[j]) - 1)).alias("top")) for j, (word, shift, width) in enumerate(parts)]))

    index = codes.select("code", F.element_at("ids", 1).alias("first_id"), F.size("ids").alias("n_ids"), shards("code").alias("s"))
    index = saved(index.select("s.segment", "s.top", "code", "first_id", "n_ids"), "index")
    held = saved(index.groupBy("segment", "top").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("pieces")), "shards")
    id_type = rows.schema[id_col].dataType.simpleString()
    out_schema = f"query array<bigint>, code array<bigint>, first_id {id_type}, n_ids int, distance int"
    def search_of(radius: int):
        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({n: pa.array([], t) for n, t in (
                    ("query", pa.list_(pa.int64())), ("code", pa.list_(pa.int64())),
                    ("first_id", left.schema.field("first_id").type), ("n_ids", pa.int32()), ("distance", pa.int32()))})
            segment = left.column("segment")[0].as_py()
            held_, posed = _matrix(left.column("code"), words), _matrix(right.column("query"), words)
            low = parts[segment][2] - tops[segment]
            spare = right.column("left").to_numpy()
            some = np.flatnonzero(spare <= low)
            q, c, distance = search_shard(held_, posed[some], spare[some], right.column("limit").to_numpy()[some], parts,
                                          segment, low, radius)
            q = some[q]
            ids = left.column("first_id").combine_chunks()
            # the k + 1 best of each query
            by_id = np.empty(len(ids), dtype=np.int64)
            by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            order = np.lexsort((by_id[c], distance, q))
            q, c, distance = q[order], c[order], distance[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, c, distance = q[place <= k], c[place <= k], distance[place <= k]
            return pa.table({"query": right.column("query").combine_chunks().take(pa.array(q)),
                             "code": left.column("code").combine_chunks().take(pa.array(c)),
                             "first_id": ids.take(pa.array(c)), "n_ids": left.column("n_ids").combine_chunks().take(pa.array(c)),
                             "distance": pa.array(distance.astype(np.int32))})
        return search

    open_queries = saved(asked.select("query").distinct().withColumn("limit", F.lit(bits)), "open")
    best = None
    for radius in range(max(width for _, _, width in parts) + 1):
        # errors in the top bits, as masks; what is left of the radius is looked for among the lower bits
        masks = {b: [(int(m), e) for e in range(min(radius, b) + 1) for m in _masks(b, e)] for b in set(tops)}
        masks = {b: F.from_json(F.lit("[" + ",".join(f'{{"m":{m},"e":{e}}}' for m, e in some) + "]"),
                                "array<struct<m:bigint,e:int>>") for b, some in masks.items()}
        entering = open_queries.select("query", "limit", shards("query").alias("s"))
        by_bits = F.coalesce(*[F.when(F.col("s.bits") == b, m) for b, m in masks.items()])
        entering = entering.select("query", "limit", "s.segment", "s.top", F.explode(by_bits).alias("x")).select(
            "query", "limit", "segment", F.col("top").bitwiseXOR(F.col("x.m")).alias("top"), (radius - F.col("x.e")).alias("left"))
        asks = entering.groupBy("segment", "top").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        sizes = saved(held.join(asks, ["segment", "top"]), "sizes")

        def dealt(df: DataFrame, by: str, parts_: str, copies: str) -> DataFrame:
            sized = small_join(df, sizes, ["segment", "top"], spread_by=[by], fits=few)
            return sized.withColumn(parts_[:-1], F.pmod(F.xxhash64(by), F.col(parts_)).cast("int")).withColumn(
                copies[:-1], F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("pieces", "blocks")

        keys = ["segment", "top", "piece", "block"]

        met = dealt(index, "code", "pieces", "blocks").groupBy(keys).cogroup(
            dealt(entering, "query", "blocks", "pieces").groupBy(keys)).applyInArrow(search_of(radius), out_schema)
        best = saved(_best(met if best is None else met.unionByName(best), k), "best")
        # proven: k + 1 ids (the query may be one of them) within the distance that is covered
        covered = len(parts) * (radius + 1) - 1
        state = best.groupBy("query").agg(F.sum(F.when(F.col("distance") <= covered, F.col("n_ids"))).alias("n"),
                                          F.max("distance").alias("far"), F.count("*").alias("met"))
        open_queries = saved(open_queries.join(state, "query", "left").filter("n is null or n <= {0}".format(k)).select(
            "query", F.when(F.col("met") > k, F.col("far")).otherwise(F.lit(bits)).alias("limit")), "open")
        if covered >= bits or open_queries.isEmpty():
            break
    hits = (asked.join(best, "query").join(codes, "code").select("query_id", "distance", F.explode("ids").alias("id"))
            .filter("id <> query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
