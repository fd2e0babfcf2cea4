"""Ranked search and packing against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import max_sketch, packing, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search -----------------------------------------------------------------------

def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_ranks(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs if i is not None]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    texts = defaultdict(set)
    for item, text in items:
        if item is not None and text is not None:
            texts[item].add(text)
    out = []
    for item, found in texts.items():
        asked = Counter(t for text in found for t in terms_of(text))
        scores = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * total) // length
            scores.append((-sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                                * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in asked.items() if c[t]), i))
        best = sorted(s for s in scores if s[0] < 0)[:k]
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def search_table(spark, docs, items, k, **more):
    table = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, n int, sketch string").repartition(3)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id string, text string, rank int")
    return sorted(tuple(r) for r in max_sketch.rank_documents(table, asked, k=k, **more).collect())


def sample_texts(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a, b in product(["al", "Be", "ga", "né", "語", "x9"], ["ta", "TA", "mi", "ñu", "0"])]
    weights = [1 / (i + 1) for i in range(len(words))]
    return ["".join(w + rng.choice([" ", ", ", "\n", "-", "_"]) for w in rng.choices(words, weights, k=rng.randrange(60)))
            for _ in range(n)]


@pytest.mark.parametrize("k", [1, 5])
def test_ranks_equal_brute_force(spark, k):
    texts = sample_texts(400, 1)
    docs = list(enumerate(texts)) + [(500, None), (501, ""), (502, " .. "), (None, texts[0]), (503, texts[3]), (3, texts[3])]
    docs += [(600 + i, texts[7]) for i in range(100)] + [(800, " ".join(texts) + " alta" * 70_000)]
    items = [(f"q{i}", t) for i, t in enumerate(sample_texts(12, 2))]
    items += [("q0", "Alta alta"), ("q0", "Alta alta"), (None, "alta"), ("none", None), ("blank", " "), ("new", "unheard")]
    assert search_table(spark, docs, items, k) == brute_ranks(docs, items, k)


def test_blocks_of_items_and_no_rows(spark, monkeypatch):
    docs = list(enumerate(sample_texts(30, 3)))
    items = [(f"q{i}", t) for i, t in enumerate(sample_texts(9, 4))]
    monkeypatch.setattr(max_sketch, "ITEMS", 2)
    assert search_table(spark, docs, items, 4) == brute_ranks(docs, items, 4)
    assert search_table(spark, docs[:0], items[:2], 4) == []
    assert search_table(spark, docs, items[:0], 4) == []


def test_bounds_skip_most_documents():
    """A sketch narrower than the vocabulary skips most documents; one of a single coordinate skips none and finds the same."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5_000)]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(4_000)]
    ask = [" ".join(texts[i].split()[:25]) for i in range(0, 4_000, 400)]
    items = max_sketch.Items(ask)
    results = []
    for width in (1_024, 1):
        batch = pa.RecordBatch.from_arrays([pa.array(range(4_000)), pa.array(texts)], names=["id", "text"])
        parts = list(max_sketch._indexed(width)(iter([batch])))
        df = np.zeros(len(items.hashes), dtype=np.int64)
        for x in max_sketch._document_frequencies(items)(iter([p.select(["terms"]) for p in parts])):
            df[x.column(0).to_numpy()] += x.column(1).to_numpy()
        weights = np.array([math.floor(1000 * math.log(8_002 / (2 * d + 1))) for d in df.tolist()])
        search = max_sketch.Search(items, weights, 4_000, 240_000, 1, width)
        for p in parts:
            sketch = max_sketch._elements(p.column(4), np.uint8)[0].reshape(p.num_rows, width)
            search.block(p.column(0).to_numpy(), p.column(1).to_numpy(), p.column(2), p.column(3), sketch)
        results.append([(i.tolist(), s.tolist()) for i, s in search.best])
        if width == 1_024:
            assert search.rescored < 0.2 * 4_000 * len(ask)
    assert results[0] == results[1]
    assert [r[0][0] for r in results[0]] == list(range(0, 4_000, 400))


# --- packing -----------------------------------------------------------------------------

def padded(n, window):
    return 0 if n & (n - 1) == 0 else window - n


def brute_cost(places, costs, window):
    best = [0] + [math.inf] * (len(places) - 1)
    for j in range(1, len(places)):
        best[j] = costs[j] + min(best[i] + padded(places[j] - places[i], window) for i in range(j) if places[j] - places[i] <= window)
    return best[-1]


def test_cuts_are_the_best_ones():
    rng = random.Random(6)
    for window in (8, 16, 64):
        for _ in range(60):
            places = np.cumsum([0] + [rng.randrange(1, window // 2) for _ in range(rng.randrange(1, 60))])
            costs = np.array([0] + [rng.choice([0, 1, 4, 9]) for _ in places[1:]])
            ends = packing.choose(places, costs, window)
            cuts = [0, *ends]
            at = {p: c for p, c in zip(places.tolist(), costs.tolist())}
            assert cuts[-1] == places[-1] and all(0 < b - a <= window for a, b in zip(cuts, cuts[1:]))
            assert sum(padded(b - a, window) + at[b] for a, b in zip(cuts, cuts[1:])) == brute_cost(places.tolist(), costs, window)


def reference_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary()[0])
    tokenizer.encode_special_tokens = True
    return [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packed(rows, ids, window=1024):
    """Every id lies in exactly one piece, sequences have no gaps, and little is padded."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= window
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc])
            part = np.array(ids[doc][r.start:r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids[doc])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += padded(at, window)
    return padding / sum(map(len, ids.values()))


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([d.doc_id for d in docs], reference_ids([d.text for d in docs])))
    rows = queries.QUERIES["op13_packing"](spark, SF).collect()
    assert check_packed(rows, ids) < 0.03


def test_odd_rows_are_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 3_000)
    monkeypatch.setattr(packing, "PART", 5_000)
    rng = random.Random(8)
    texts = ["", None, "One. Two! Three?\n\n", "words without an end " * 4_000, "x" * 9_000, " " * 4_000, "。".join(["句子"] * 300),
             "<|endoftext|> stays text", *sample_texts(60, 9)]
    texts += ["".join(rng.choice("ab é.\n 's12") for _ in range(7_000)) for _ in range(3)]
    table = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, start int, ids string")
    packed = packing.pack(table.repartition(2)).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_packed(packed, dict(enumerate(reference_ids(texts)))) < 0.05
    assert packing.pack(table.filter("doc_id < 0")).collect() == []
    twice = packing.pack(spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b")], "doc_id long, text string").coalesce(1))
    assert sorted((r.doc_id or 0, r.start, r.length, r.doc_tokens) for r in twice.collect()) == [(0, 0, 2, 2)] * 2 + [(1, 0, 2, 2)] * 2


def test_whole_vocabulary_has_the_same_ids():
    encoder = packing.encoder(*packing.default_vocabulary())
    assert encoder.fast is not None
    strings = [encoder.tokenizer.decode([i]) for i in range(50_256)]
    assert [encoder._ids(s).tolist() for s in strings] == [
        e.ids for e in encoder.tokenizer.encode_batch(strings, add_special_tokens=False)]
