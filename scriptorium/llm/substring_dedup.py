"""Repeated word windows across documents: seeds on winnowed anchors, extended both ways.

A window is `min_words` consecutive words of one document.  A window is a
repeat if the same word sequence also starts earlier: in a document of smaller
id, or in the same document at an earlier word.  Every word covered by a repeat
is removed; what is left of the repeats after merging are the maximal repeats.

Method.  Of the GRAM-word grams of a window the smallest hash (leftmost on
ties) is the window's anchor.  It depends on the window's words alone, so equal
windows have equal anchors at equal offsets, and about one word in
(min_words - GRAM + 2) / 2 starts an anchor.  An anchor stands for the run of
windows that chose it; its seed carries the anchor hash and a hash of all words
of that run, that is of the anchor extended as far as its windows reach.

1. Seeds meet by anchor hash.  Within one anchor, seeds of equal extension are
   one class: all but its first seed are repeats as a whole.  Classes that
   differ share some windows at most, so their first seeds (only these) are
   compared window by window.
2. Those windows meet by the hash of their words together with anchor and
   offset; all but the first are repeats.

Both rounds are a sort inside hash partitions, read as a stream.  Before each
shuffle a task drops from its own rows all but the first seed of a class (the
others are known repeats, and travel as merged spans dealt out evenly), so a
passage that a third of all documents share sends one row per task, not one per
copy.  No pairs are made anywhere.

Defined cases: null and empty texts have no words; rows without an id come after
all others and are told apart by their text; ids are below 2**62 and name one
text each; repeated rows are the same document, so neither is earlier;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import SURROGATE, saved, surrogate_id
from .wordhash import Prefix, Words, blocks, grams, mixed, runs_of

GRAM = 5
FLUSH_ROWS = 1 << 19
_SEED = "k1 bigint, k2 bigint, id bigint, at bigint"
_FOUND = "id bigint, a int, b int, p int, k1 bigint, kind int"
U64 = np.uint64


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _combined(k1, k2, ids, at, a, b) -> Iterator[pa.RecordBatch]:
    """First row of each (k1, k2) of a task, and the spans of the others, merged, as rows with negative `at`."""
    order = np.lexsort((at, ids, k2, k1))
    k1, k2, ids, at, a, b = (x[order] for x in (k1, k2, ids, at, a, b))
    first = runs_of(k1, k2)
    yield _rows(k1[first], k2[first], ids[first], at[first])
    rest = ~first
    # rows of one id and start as the first are the first again (repeated input rows)
    at_first = np.flatnonzero(first)[np.cumsum(first) - 1]
    rest &= (ids != ids[at_first]) | (at != at[at_first])
    if rest.any():
        ids, a, b = _merged(ids[rest], a[rest], b[rest])
        packed = -1 - ((a << 31) | b)
        yield _rows(_signed(mixed(ids.view(U64) + a.astype(U64))), np.zeros_like(ids), ids, packed)


def _merged(ids, a, b):
    """Union of runs of window starts [a, b] per id."""
    order = np.lexsort((b, a, ids))
    ids, a, b = ids[order], a[order], b[order]
    new_id = runs_of(ids)
    # highest end so far inside an id: ids are numbered so that a running maximum restarts
    step = np.cumsum(new_id).astype(np.int64) << 32
    reach = np.maximum.accumulate(b + step) - step
    new = new_id.copy()
    new[1:] |= a[1:] > reach[:-1] + 1
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(ids)) - 1
    return ids[at], a[at], reach[last]


def _rows(k1, k2, ids, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, ids, at)], names=["k1", "k2", "id", "at"])


class _Collector:
    """Arrays gathered over blocks, combined whenever FLUSH_ROWS have come together."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, *arrays) -> Iterator[pa.RecordBatch]:
        self.parts.append(arrays)
        self.n += len(arrays[0])
        if self.n >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            columns = [np.concatenate(c) for c in zip(*self.parts)]
            self.parts, self.n = [], 0
            yield from _combined(*columns)


def anchors(words: Words, min_words: int):
    """Per anchor: word index, first and last window start (global word indexes), text index."""
    width = min_words - GRAM + 1
    h = grams(words.hash, GRAM)
    n = len(words.hash) - min_words + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)), h
    # leftmost argmin over `width` grams by doubling
    best = np.arange(len(h))
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        covered += step
    best = best[:n]
    text = np.repeat(np.arange(len(words.counts)), words.counts)[:n]
    start = np.arange(n)
    valid = start + min_words <= words.first[text + 1]
    start, best, text = start[valid], best[valid], text[valid]
    new = runs_of(best, text) if len(best) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(best)) - 1 if len(at) else at
    return (best[at], start[at], start[last], text[at]), h


def _seed_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Collector()
        for block in blocks(batches, "text"):
            words = Words(block.column("text"))
            (p, lo, hi, text), h = anchors(words, min_words)
            if not len(p):
                continue
            extension = Prefix(words.hash).ranges(lo, hi + min_words) + ((p - lo) * 64 + (hi - lo)).astype(U64)
            ids = block.column("id").to_numpy(zero_copy_only=False)[text].astype(np.int64)
            base = words.first[text]
            p, lo, hi = p - base, lo - base, hi - base
            at = (p << 24) | ((p - lo) << 12) | (hi - lo)
            yield from out.add(_signed(h[p + base]), _signed(mixed(extension)), ids, at, lo, hi)
        yield from out.flush()
    return run


def _unpack_spans(at):
    packed = -1 - at
    return packed >> 31, packed & ((1 << 31) - 1)


def _found(ids, a, b, p, k1, kind) -> pa.RecordBatch:
    n = len(ids)
    fill = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, dtype=t), n))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), fill(a, np.int32), fill(b, np.int32), fill(p, np.int32), fill(k1, np.int64),
         fill(kind, np.int32)], names=["id", "a", "b", "p", "k1", "kind"])


def _seed_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted seeds -> kind 0: repeats as a whole; kind 1: first seeds whose anchor has several extensions."""
    last = None          # k1, k2, id, at of the last first-of-class row
    pending = None       # first seed of the running anchor while it has one class only
    for batch in batches:
        k1, k2, ids, at = (batch.column(i).to_numpy() for i in range(4))
        spans = at < 0
        if spans.any():
            a, b = _unpack_spans(at[spans])
            yield _found(ids[spans], a, b, 0, 0, 0)
            k1, k2, ids, at = (x[~spans] for x in (k1, k2, ids, at))
        if not len(k1):
            continue
        new_anchor, new_class = runs_of(k1), runs_of(k1, k2)
        if last is not None:
            new_anchor[0] = k1[0] != last[0]
            new_class[0] = new_anchor[0] or k2[0] != last[1]
        p = at >> 24
        a = p - ((at >> 12) & 4095)
        b = a + (at & 4095)
        # the first seed of each row's class, for repeated input rows
        where = np.flatnonzero(new_class)
        index = np.cumsum(new_class) - 1
        if len(where):
            seen = where[np.maximum(index, 0)]
            first_id, first_at = ids[seen], at[seen]
        else:
            first_id, first_at = np.empty_like(ids), np.empty_like(at)
        if last is not None:
            first_id = np.where(index < 0, last[2], first_id)
            first_at = np.where(index < 0, last[3], first_at)
        repeat = ~new_class & ((ids != first_id) | (at != first_at))
        if repeat.any():
            yield _found(ids[repeat], a[repeat], b[repeat], 0, 0, 0)
        # anchors with more than one class
        run = np.cumsum(new_anchor)                     # 0: goes on from the batch before
        classes = np.bincount(run, weights=new_class, minlength=run[-1] + 1)
        several = classes > 1
        if not new_anchor[0]:
            several[0] = pending is None or classes[0] > 0
            if several[0] and pending is not None:
                yield _found(*pending, 1)
                pending = None
        unsure = new_class & several[run]
        if unsure.any():
            yield _found(ids[unsure], a[unsure], b[unsure], p[unsure], k1[unsure], 1)
        if several[run[-1]]:
            pending = None
        elif new_anchor.any():
            i = np.flatnonzero(new_anchor)[-1]
            pending = (ids[i:i + 1], a[i:i + 1], b[i:i + 1], p[i:i + 1], k1[i:i + 1])
        i = where[-1] if len(where) else None
        last = (k1[i], k2[i], ids[i], at[i]) if i is not None else last


def _window_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Collector()
        for block in blocks(batches, "text"):
            words = Words(block.column("text"))
            prefix = Prefix(words.hash, base=0xD6E8FEB86659FD93)
            seeds = block.column("seeds")
            flat = seeds.flatten()
            text = np.repeat(np.arange(len(seeds)), np.diff(seeds.offsets.to_numpy()))
            a, b, p, k1 = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            n = b - a + 1
            row = np.repeat(np.arange(len(a)), n)
            start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + a[row]
            text = text[row]
            begin = start + words.first[text]
            fits = begin + min_words <= words.first[text + 1]
            row, start, text, begin = (x[fits] for x in (row, start, text, begin))
            ids = block.column("id").to_numpy(zero_copy_only=False)[text].astype(np.int64)
            anchor = mixed(k1.view(U64)[row] + (p[row] - start).astype(U64))
            content = prefix.ranges(begin, begin + min_words)
            yield from out.add(_signed(content), _signed(anchor), ids, start, start, start)
        yield from out.flush()
    return run


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows -> those that are not the first of their content."""
    last = None
    for batch in batches:
        k1, k2, ids, at = (batch.column(i).to_numpy() for i in range(4))
        spans = at < 0
        if spans.any():
            a, b = _unpack_spans(at[spans])
            yield _found(ids[spans], a, b, 0, 0, 0)
            k1, k2, ids, at = (x[~spans] for x in (k1, k2, ids, at))
        if not len(k1):
            continue
        if last is not None:
            k1, k2, ids, at = (np.concatenate(([v], x)) for v, x in zip(last, (k1, k2, ids, at)))
        new = runs_of(k1, k2)
        at_first = np.flatnonzero(new)[np.cumsum(new) - 1]
        repeat = ~new & ((ids != ids[at_first]) | (at != at[at_first]))
        if repeat.any():
            yield _found(ids[repeat], at[repeat], at[repeat], 0, 0, 0)
        i = at_first[-1]
        last = (k1[i], k2[i], ids[i], at[i])


def _kept(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            texts = block.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            spans = block.column("spans").to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, runs in zip(texts, spans):
                words = text.split()
                n = len(words)
                if runs:
                    left, at = [], 0
                    for a, b in sorted((r["a"], r["b"]) for r in runs):
                        if a > at:
                            left += words[at:a]
                        at = max(at, b + min_words)
                    left += words[at:]
                else:
                    left = words
                n_words.append(n)
                n_removed.append(n - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own, text = F.col(id_col).cast("bigint"), F.col(text_col)
    return docs.select(own.alias("doc_id"), F.coalesce(own, surrogate_id(text)).alias("id"), text.alias("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """Runs of repeated windows: id, a, b (first and last window start); runs may overlap."""
    if min_words <= GRAM or min_words > 1000:
        raise ValueError(f"min_words must be {GRAM + 1} to 1000")
    plain = _documents(docs, id_col, text_col)
    seeds = plain.select("id", "text").mapInArrow(_seed_rows(min_words), _SEED)
    found = saved(seeds.repartition("k1").sortWithinPartitions("k1", "k2", "id", "at")
                  .mapInArrow(_seed_classes, _FOUND), "seeds")
    unsure = found.filter("kind = 1").groupBy("id").agg(F.collect_list(F.struct("a", "b", "p", "k1")).alias("seeds"))
    windows = (plain.select("id", "text").join(unsure, "id").select("id", "text", "seeds")
               .mapInArrow(_window_rows(min_words), _SEED))
    later = (windows.repartition("k1").sortWithinPartitions("k1", "k2", "id", "at")
             .mapInArrow(_later_windows, _FOUND))
    return found.filter("kind = 0").select("id", "a", "b").unionByName(later.select("id", "a", "b"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row; kept words are joined by one space."""
    plain = _documents(docs, id_col, text_col)
    spans = (repeated_windows(docs, id_col, text_col, min_words)
             .groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    rows = plain.join(spans, "id", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_kept(min_words), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """The maximal repeats themselves: doc_id, start_word, end_word (end exclusive), merged per document."""
    runs = repeated_windows(docs, id_col, text_col, min_words)
    struct = F.struct(F.col("a").alias("a"), (F.col("b") + min_words).alias("e"))
    merge = F.aggregate(
        F.array_sort(F.collect_list(struct)), F.array().cast("array<struct<a:int,e:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["a"]),
                              F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                                       F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"),
                                                        F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(x))))
    merged = runs.groupBy("id").agg(merge.alias("spans"))
    return merged.select(F.when(F.col("id") < SURROGATE, F.col("id")).alias("doc_id"), F.explode("spans").alias("s")).select(
        "doc_id", F.col("s.a").alias("start_word"), F.col("s.e").alias("end_word"))
