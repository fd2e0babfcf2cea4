"""Exact ranked lexical search by hashed max-sketches.

Index.  A document's terms are hashed to 64 bits.  Besides its sorted terms with
their counts, a document keeps a sketch: every term falls on one of WIDTH
coordinates, and a coordinate keeps the largest count of its terms.  A term's
impact on a score rises with its count and falls with the document's length
only, so the impact of a coordinate's largest count is the largest impact of its
terms, whatever the corpus counts are; they are applied when the index is read.

Search.  The terms of a block of items are looked up in all sketches of a block
of documents at once: coordinate impacts (documents x WIDTH) times summed term
weights (WIDTH x items) bound every score from above.  Per item, documents are
rescored exactly in the order of falling bounds, until the next bound is below
the item's k-th best score so far; from then on no document of the block can
enter.  A task keeps the k best per item over all its blocks, so thresholds rise
as it goes, and only these leave it; the lists of the tasks are merged by rank.

Scores are 64-bit integers: the sum over the item's terms, repeats included, of
w * ((10**9 * tf) div (1000 * tf + 12 * m)) with w = floor(1000 * ln((2N + 2) / (2df + 1)))
and m = 100 - 25 + (25 * n * N) div L.  Bounds are single-precision sums, raised
by SLACK, which is far above their rounding error.

Size.  Documents are read in their own partitions, nothing is shuffled but k rows
a task and item.  Items come to the driver in blocks of ITEMS at most (and of
TERMS terms, unless one item has more); each block is one pass over the index,
and all that a task is sent is bounded by them.  Terms are compared by hash: with V
distinct terms in the corpus, a wrong match has a chance of V * TERMS / 2**64 a block.

Defined cases: null and empty texts have no terms, so such documents count in no
statistic and such items have no rows; rows without an id take no part; repeated
rows are documents of their own, which share an id and take a rank each; rows of
one item id are one item with the terms of all its different texts; equal scores
go to the smaller id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.scale import top_k

from .store import saved
from .wordhash import U64, Words, blocks, mixed

WIDTH = 1_024
ITEMS = 1_000
TERMS = 200_000
DOCS = 1_024
CHUNK = 64
SLACK = 1.0005
FULL = 255

# terms are made of ASCII letters and digits and of all bytes of non-ASCII characters
_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_INDEX = "id bigint, n bigint, terms binary, counts binary, sketch binary"


def _coordinates(terms: np.ndarray, width: int) -> np.ndarray:
    return (mixed(terms) % U64(width)).astype(np.int64)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value per row, of sizes[i] elements each."""
    offsets = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def _elements(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all binary values, and the bounds of each value among them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw.view(kind) if raw.ctypes.data % size == 0 else raw.copy().view(kind), (offsets - offsets[0]) // size


def _indexed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(block.column("text"), lower=True, breaks=_BREAKS)
            terms, counts, sizes = [], [], []
            sketch = np.zeros((block.num_rows, width), dtype=np.uint8)
            for i in range(block.num_rows):
                found = np.sort(words.hash[words.first[i]:words.first[i + 1]])
                starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, dtype=np.int64)
                terms.append(found[starts])
                counts.append(np.diff(np.append(starts, len(found))).astype(np.uint32))
                sizes.append(len(starts))
            terms, counts, sizes = np.concatenate(terms), np.concatenate(counts), np.array(sizes)
            row = np.repeat(np.arange(block.num_rows), sizes)
            np.maximum.at(sketch, (row, _coordinates(terms, width)), np.minimum(counts, FULL).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [block.column("id").cast(pa.int64()), pa.array(words.counts.astype(np.int64)), _binary(terms, sizes),
                 _binary(counts, sizes), _binary(sketch.ravel(), np.full(block.num_rows, width))],
                names=["id", "n", "terms", "counts", "sketch"])
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, n (terms with repeats), terms, counts and sketch of every document with an id: one pass over the texts."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    return rows.mapInArrow(_indexed(width), _INDEX)


class Items:
    """Terms of a block of items, numbered in the order of their hashes."""

    def __init__(self, texts: list[str]):
        words = Words(pa.array(texts, pa.string()), lower=True, breaks=_BREAKS)
        counted = [Counter(words.hash[a:b].tolist()) for a, b in zip(words.first, words.first[1:])]
        self.hashes = np.unique(words.hash)
        number = {h: i for i, h in enumerate(self.hashes.tolist())}
        self.terms = [np.array([number[h] for h in c], dtype=np.int64) for c in counted]
        self.times = [np.array(list(c.values()), dtype=np.int64) for c in counted]

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among `terms` of those that an item has, and their numbers."""
        if not len(self.hashes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, terms), len(self.hashes) - 1)
        where = np.flatnonzero(self.hashes[at] == terms)
        return where, at[where]


def _document_frequencies(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.hashes), dtype=np.int64)
        for batch in batches:
            total += np.bincount(items.find(_elements(batch.column(0), U64)[0])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])
    return run


class Search:
    """The k best documents of each item among those seen so far."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int, width: int):
        self.items, self.n_docs, self.n_terms, self.k, self.width = items, n_docs, n_terms, k, width
        self.weights = [weights[t] * n for t, n in zip(items.terms, items.times)]
        place = _coordinates(items.hashes, width)
        self.lookup = np.zeros((width, len(items.terms)), dtype=np.float32)
        for q, (t, w) in enumerate(zip(items.terms, self.weights)):
            np.add.at(self.lookup[:, q], place[t], w.astype(np.float32))
        none = np.zeros(0, dtype=np.int64)
        self.best = [(none, none)] * len(items.terms)
        self.least = np.zeros(len(items.terms), dtype=np.int64)
        self.rescored = 0

    def block(self, ids: np.ndarray, n: np.ndarray, terms: pa.Array, counts: pa.Array, sketch: np.ndarray) -> None:
        m = 100 - 25 + (25 * n * self.n_docs) // max(self.n_terms, 1)
        tf = sketch.astype(np.float32)
        impact = 1e6 * tf / (tf + (0.012 * m).astype(np.float32)[:, None])
        impact[sketch == FULL] = 1e6
        bounds = (impact @ self.lookup) * np.float32(SLACK)
        flat, ends = _elements(terms, U64)
        where, number = self.items.find(flat)
        row = np.searchsorted(ends, where, side="right") - 1
        keys = row * len(self.items.hashes) + number
        tf = _elements(counts, np.uint32)[0][where].astype(np.int64)
        values = (10**9 * tf) // (1000 * tf + 12 * m[row])
        visit = (bounds > 0) & (bounds >= self.least.astype(np.float32))
        for q in np.flatnonzero(visit.any(axis=0)).tolist() if len(keys) else ():
            rows = np.flatnonzero(visit[:, q])
            rows = rows[np.argsort(-bounds[rows, q], kind="stable")]
            for at in range(0, len(rows), CHUNK):
                some = rows[at:at + CHUNK]
                if bounds[some[0], q] < self.least[q]:
                    break
                self.rescored += len(some)
                wanted = some[:, None] * len(self.items.hashes) + self.items.terms[q]
                found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                scores = np.where(keys[found] == wanted, values[found] * self.weights[q], 0).sum(axis=1)
                self._add(q, ids[some], scores)

    def _add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.least[q])
        if good.any():
            ids = np.concatenate((self.best[q][0], ids[good]))
            scores = np.concatenate((self.best[q][1], scores[good]))
            order = np.lexsort((ids, -scores))[:self.k]
            self.best[q] = ids[order], scores[order]
            if len(order) == self.k:
                self.least[q] = scores[order[-1]]


def _searched(search_of, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = search_of()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                sketch = _elements(part.column(4), np.uint8)[0].reshape(part.num_rows, width)
                search.block(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2), part.column(3), sketch)
        sizes = [len(ids) for ids, _ in search.best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes)), *[pa.array(np.concatenate(x)) for x in zip(*search.best)]],
            names=["item", "id", "score"])
    return run


def _blocks_of_items(items: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """Items with their texts in blocks of bounded size; a longer item is a block of its own."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).dropna().groupBy("item").agg(
        F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and (len(block) == ITEMS or size + len(row["text"]) // 2 > TERMS):
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row["text"]) // 2
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 20,
           width: int = WIDTH) -> DataFrame:
    """item, rank (from 1), id, score: the k best documents of each item.

    `index` is a stored result of build_index of the same width; it is read twice for each block of items.
    """
    spark = index.sparkSession
    total = index.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 0
    kind = items.schema[item_col].dataType.simpleString()
    hits = spark.createDataFrame([], f"item {kind}, id bigint, score bigint")
    for block in _blocks_of_items(items, item_col, text_col):
        asked = Items([r["text"] for r in block])
        counted = index.select("terms").mapInArrow(_document_frequencies(asked), "term bigint, df bigint").groupBy("term").agg(
            F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(asked.hashes), dtype=np.int64)
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)

        def search_of(asked=asked, weights=weights):
            return Search(asked, weights, n_docs, n_terms, k, width)

        found = index.select("id", "n", "terms", "counts", "sketch").filter("n > 0").mapInArrow(
            _searched(search_of, width), "item bigint, id bigint, score bigint")
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(block)], f"number bigint, item {kind}")
        found = found.withColumnRenamed("item", "number").join(F.broadcast(names), "number").select("item", "id", "score")
        hits = hits.unionByName(found)
    ranked = top_k(hits, ["item"], [F.desc("score"), F.asc("id")], k, ["id"])
    return ranked.select("item", F.col("rank").cast("int").alias("rank"), "id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", k: int = 20) -> DataFrame:
    """Index `docs` in the shared folder and search it for all items."""
    return search(saved(build_index(docs, id_col, text_col), "sketches"), items, item_col, item_text, k)
