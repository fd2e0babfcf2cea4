"""Spelling variants against brute force on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import queries, spelling

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """One inserted, deleted or replaced character."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute_pairs(words):
    """Near pairs of distinct words through their forms with one character left out."""
    holes = {}
    for w in words:
        for key in {(w, -1)} | {(w[:i] + w[i + 1:], i) for i in range(len(w))}:
            holes.setdefault(key[0], set()).add(w)
    return {(a, b) for some in holes.values() for a in some for b in some if near(a, b)}


def brute_groups(counts, ratio):
    partners = {}
    for a, b in brute_pairs(counts):
        partners.setdefault(a, set()).add(b)
    forms = {}
    for w, n in counts.items():
        best = min(partners.get(w, ()), key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        form = forms[w]
        out.append((w, n, len(partners.get(w, ())), form, counts[form] if form else None, root))
    return sorted(out)


def brute_words(docs, every=31):
    counts = Counter()
    for i, text in docs:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def some_words(n, seed, letters="abcé", low=1, high=9):
    rng = random.Random(seed)
    out = {"".join(rng.choices(letters, k=rng.randrange(low, high))) for _ in range(n)}
    return sorted(out | {w[:i] + rng.choice(letters) + w[i:] for w in list(out)[::3] for i in (0, len(w))})


@pytest.mark.parametrize("letters,high", [("ab", 8), ("abcé", 9), ("aaab", 14), ("abcdefghijkl", 30)])
def test_schemes_find_each_near_pair_once(letters, high):
    words = some_words(500, 1, letters, 1, high)
    asked = words[::2] + ["zzzz", "a" * 40]
    found = []
    for backwards in (False, True):
        q, w = spelling.near_words(pa.array(asked), pa.array(words), backwards)
        found += [(asked[i], words[j]) for i, j in zip(q.tolist(), w.tolist())]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in asked for b in words if near(a, b)}


def test_no_words_and_long_words():
    none = pa.array([], pa.string())
    for backwards in (False, True):
        assert spelling.near_words(none, none, backwards)[0].tolist() == []
        assert spelling.near_words(pa.array(["abc"]), none, backwards)[0].tolist() == []
    long = ["x" * 3_000 + "abc", "x" * 3_000 + "abd", "y" + "x" * 3_000 + "abc", "x" * 3_001 + "abc"]
    found = set()
    for backwards in (False, True):
        q, w = spelling.near_words(pa.array(long), pa.array(long), backwards)
        found |= set(zip(q.tolist(), w.tolist()))
    assert found == {(i, j) for i, a in enumerate(long) for j, b in enumerate(long) if near(a, b)}


@pytest.mark.parametrize("group", [16_000, 40])
def test_groups_equal_brute_force(spark, group):
    """Also with groups so small that most halves are dealt into pieces."""
    rng = np.random.default_rng(3)
    words = some_words(500, 4, "abcd", 3, 10)
    counts = {w: int(10 ** rng.uniform(0, 5)) for w in words}
    table = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long").repartition(3)
    found = spelling.group_variants(table, group=group).select("word", "n", "n_near", "form", "form_n", "root")
    expected = brute_groups(counts, 10)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert any(r[5] != r[3] and r[3] for r in expected)


def test_counts_of_odd_rows(spark):
    docs = [(1, "Général généraux GÉNÉRAL Strasse-strasse straßen"), (2, None), (3, ""), (None, "strasse strasse generals"),
            (1, "généraux général"), (4, "generals2generals generals_generals"), (5, "q" * 50_000 + " " + "q" * 50_000), (6, "short " * 9)]
    table = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, word string").repartition(2)
    for every in (31, 2, None):
        found = spelling.count_words(table, typos_every=every)
        assert {r.word: r.n for r in found.collect()} == brute_words(docs, every)
    none = spelling.count_words(table.filter("doc_id > 99"))
    assert spelling.group_variants(none).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_groups(brute_words(docs), 10)
    rows = queries.QUERIES["op12_spelling_variants"](spark, SF).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(tuple(r) for r in rows.collect()) == expected
    assert rows.filter(F.col("form").isNotNull()).count() >= 5
