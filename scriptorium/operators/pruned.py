"""Exact top k by BM25 without scoring every match, over the blocks of a stored index.

A stored index holds blocks of papers: for each term the papers of a block with their counts and lengths, from
which come their impacts (the part of a score that needs no query).  A batch of queries reads the blocks of its
terms; each block is searched in one task.

For a query, terms are taken in the order of the most that they can add in this block (weight x idf x largest impact),
so rare and heavy terms come first.  As soon as what is left can add a small part of the
k-th best partial score only, the rest is looked up for those papers alone that can still
enter the first k of the block; all others are never scored in full.  A partial score is a lower
bound, partial score plus what is left an upper bound, so nothing is lost.

Filters are posting lists too: a scope lists its papers in each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..scale import SCORE_DIGITS, small_join
from .scopes import Scopes

SCOPE = "scope"
# of the k-th best partial score: terms are summed for all papers until the others can add less
REST = 0.2
STEP = 8


class Block:
    """Postings of one block of papers."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        papers = rows.column("papers").combine_chunks()
        names = papers.flatten()
        names = names.dictionary_encode() if len(names) else pa.array([], pa.string()).dictionary_encode()
        self.names = np.array(names.dictionary.to_pylist(), dtype=object)
        # numbers in the order of the ids, so that ties go to the smaller id
        order = np.argsort(self.names, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.names = self.names[order]
        ids = rank[names.indices.to_numpy()] if len(order) else np.zeros(0, dtype=np.int64)
        ends = papers.offsets.to_numpy() - papers.offsets[0].as_py()
        counts = rows.column("tfs").combine_chunks()
        starts = counts.offsets.to_numpy() - counts.offsets[0].as_py()
        k1, b, tf = rules.BM25_K1, rules.BM25_B, counts.flatten().to_numpy()
        dl = rows.column("dls").combine_chunks().flatten().to_numpy()
        average = np.repeat(rows.column("avgdl").to_numpy(), np.diff(starts))
        impacts = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))
        self.lists, self.scopes = {}, {}
        for i, key in enumerate(zip(rows.column("field").to_pylist(), rows.column("term").to_pylist())):
            mine = ids[ends[i]:ends[i + 1]]
            by_id = np.argsort(mine)
            if key[0] == SCOPE:
                self.scopes[key[1]] = mine[by_id]
            else:
                self.lists[key] = mine[by_id], impacts[starts[i]:starts[i + 1]][by_id]

    def search(self, terms: list[tuple], title_active: bool, wanted: list[str] | None, k: int):
        """Numbers, scores and field bits of the best k papers, and how many were scored in full.

        terms: (field, term, factor); wanted: scopes that a paper must all belong to, None without a filter.
        """
        held = [(f, *self.lists[f, t], w) for f, t, w in terms if (f, t) in self.lists]
        n = len(self.names)
        allowed = np.ones(n, dtype=bool)
        for scope in wanted or ():
            mine = np.zeros(n, dtype=bool)
            mine[self.scopes.get(scope, [])] = True
            allowed &= mine
        if not held or not allowed.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), 0
        most = np.array([w * x.max() for _, _, x, w in held])
        order = np.argsort(-most, kind="stable")
        left = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)
        sums = np.zeros((len(rules.FIELDS), n))

        def low() -> np.ndarray:
            total = sums.sum(axis=0)
            return np.where(sums[0] > 0, total, total * rules.TITLE_MISS_FACTOR) if title_active else total

        at, least = 0, 0.0
        while at < len(order):
            for i in order[at:at + STEP].tolist():
                f, ids, impacts, w = held[i]
                sums[rules.FIELDS.index(f), ids] += w * impacts
            at = min(at + STEP, len(order))
            some = low()[allowed]
            if most[order[-1]] >= 0 and len(some) > k:
                least = np.partition(some, -k)[-k]
                if left[at] <= REST * least:
                    break
        partial = low()
        upper = sums.sum(axis=0) + left[at]
        if title_active and not any(held[i][0] == rules.FIELDS[0] for i in order[at:].tolist()):
            upper = np.where(sums[0] > 0, upper, upper * rules.TITLE_MISS_FACTOR)
        # rounded scores decide, so those that are as good after rounding stay
        open_ = np.flatnonzero(allowed & ((partial > 0) | (left[at] > 0)) & (upper >= least - 10.0**-SCORE_DIGITS))
        for i in order[at:].tolist():
            f, ids, impacts, w = held[i]
            where = np.minimum(np.searchsorted(ids, open_), len(ids) - 1)
            hit = ids[where] == open_
            sums[rules.FIELDS.index(f), open_[hit]] += w * impacts[where[hit]]
        scores = low()[open_]
        best = np.lexsort((open_, -np.round(scores, SCORE_DIGITS)))
        best = best[scores[best] > 0][:k]
        found = open_[best]
        bits = ((sums[:, found] != 0) * (1 << np.arange(len(rules.FIELDS)))[:, None]).sum(axis=0)
        return found, scores[best], bits, len(open_)


def pruned_hits(blocks: DataFrame, weighted: DataFrame, scopes: Scopes | None, k: int) -> DataFrame:
    """(query_id, paper_id, score, matched_fields) of the best k papers of each block.

    weighted(query_id, field, term, factor, title_active) was found small enough to broadcast.
    """
    kind = weighted.schema["query_id"].dataType.simpleString()
    batch: dict = {}
    for query, field, term, factor, title in weighted.select("query_id", "field", "term", "factor", "title_active").collect():
        batch.setdefault(query, [title, []])[1].append((field, term, factor))
    held = small_join(blocks, weighted.select("field", "term").distinct(), ["field", "term"], fits=True).select(
        "block", "field", "term", "papers", "tfs", "dls", "avgdl")
    wants: dict = {}
    if scopes is not None:
        # a row for each query of the batch at most
        wants = {r["query_id"]: r["scopes"] for r in scopes.queries.select("query_id", "scopes").collect()}
        n = blocks.select("blocks").first()
        lists = scopes.papers.select(paper_block(n["blocks"] if n else 1), "paper_id", F.explode("scopes").alias("term"))
        lists = lists.groupBy("block", "term").agg(F.collect_list("paper_id").alias("papers")).select(
            "block", F.lit(SCOPE).alias("field"), "term", "papers", F.array().cast("array<int>").alias("tfs"),
            F.array().cast("array<int>").alias("dls"), F.lit(0.0).alias("avgdl"))
        held = held.unionByName(lists)
    shared = blocks.sparkSession.sparkContext.broadcast((batch, wants))

    def search(rows: pa.Table) -> pa.Table:
        batch, wants = shared.value
        block = Block(rows)
        out = [[], [], [], []]
        for query, (title, terms) in batch.items():
            found, scores, bits, _ = block.search(terms, title, wants.get(query), k)
            out[0] += [query] * len(found)
            out[1] += block.names[found].tolist()
            out[2] += scores.tolist()
            out[3] += bits.tolist()
        types = (query_type(kind), pa.string(), pa.float64(), pa.int64())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("query_id", "paper_id", "score", "bits"), out, types)})

    hits = held.groupBy("block").applyInArrow(search, f"query_id {kind}, paper_id string, score double, bits bigint")
    fields = F.array_compact(F.array(*[
        F.when(F.getbit("bits", F.lit(i)) == 1, F.lit(f)) for i, f in enumerate(rules.FIELDS)]))
    return hits.select("query_id", "paper_id", "score", fields.alias("matched_fields"))


def query_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def paper_block(n: int):
    return F.pmod(F.xxhash64("paper_id"), F.lit(n)).cast("int").alias("block")
