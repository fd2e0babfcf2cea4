"""Code and vector search, URL rules, toxicity and the pipeline on small tables."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import hamming_search, toxicity, url_filter, vector_search

SF = "/root/testdata/sf0.001"


# --- codes -----------------------------------------------------------------------------

def brute_codes(rows, queries, k):
    own = sorted({(i, c) for i, c in rows if i is not None and c is not None})
    out = []
    for q, c in sorted({(i, c) for i, c in queries if i is not None and c is not None}):
        near = sorted((bin((c ^ d) & (2**64 - 1)).count("1"), i) for i, d in own if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_nearest_codes_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.getrandbits(64) - 2**63) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(200)]                      # one code of very many rows
    rows += [(600 + i, rows[1][1] ^ (1 << rng.randrange(63))) for i in range(40)]
    rows += [(700, None), (None, 5), rows[3], rows[3]]
    table = spark.createDataFrame([(i, c, 0) for i, c in rows], "id long, code long, distance int").repartition(4)
    asked = table.filter("id % 20 = 0")
    found = hamming_search.nearest_codes(table, asked, k=10)
    assert sorted(tuple(r) for r in found.collect()) == brute_codes(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 10)


def test_few_codes_and_none(spark):
    table = spark.createDataFrame([(0, 1), (1, 3), (2, -1)], "id long, code long")
    found = hamming_search.nearest_codes(table, table.filter("id = 0"), k=10, bits=64, segments=8)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 1), (0, 2, 2, 63)]
    none = table.filter("id > 5")
    assert hamming_search.nearest_codes(none, none).collect() == []


@pytest.mark.parametrize("shard,block,segments", [(32_768, 2_048, None), (16, 8, None), (16, 2_048, 8)])
def test_long_codes_in_small_shards(spark, monkeypatch, shard, block, segments):
    """Codes of more than 64 bits that differ behind the 64th, and shards far smaller than the table."""
    monkeypatch.setattr(hamming_search, "SHARD", shard)
    monkeypatch.setattr(hamming_search, "BLOCK", block)
    rng = np.random.default_rng(4)
    signs = rng.standard_normal((240, 72 if segments is None else 64))
    signs[100:140, :64] = signs[7, :64]                                      # forty codes that agree in their first word
    signs[150:180] = signs[8]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(signs)] + [(900, [1.0] * 3), (901, [])], "id long, v array<double>")
    table = vectors.select("id", hamming_search.sign_code(F.col("v")).alias("code")).repartition(3)
    if segments is None:
        assert table.filter("id = 7").first().code != table.filter("id = 100").first().code
    found = hamming_search.nearest_codes(table, table.filter("id % 6 = 0"), k=7, segments=segments)
    bits = {i: (v > 0).tolist() + [False] * (80 - len(v)) for i, v in enumerate(signs)} | {900: [True] * 3 + [False] * 77, 901: [False] * 80}
    expected = []
    for q in (i for i in bits if i % 6 == 0):
        near = sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits if i != q)[:7]
        expected += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_sign_code(spark):
    table = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0],), (None,), ([1.0, None, 1.0, 1.0],)], "v array<double>")
    assert [r[0] for r in table.select(hamming_search.sign_code(F.col("v"), 4)).collect()] == [9, None, None]


# --- vectors ---------------------------------------------------------------------------

def test_nearest_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((3000, 24)).astype(np.float32)
    data[1000:1400] = data[7]                                                # one very common vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(data)]
    rows += [(5000, None, "x"), (5001, [0.0] * 24, "x"), (5002, [math.nan] * 24, "x"), (5003, [math.inf] + [1.0] * 23, "x"),
             (5004, [None] + [1.0] * 23, "x"), (None, [1.0] * 24, "x"), (5005, [1.0, 2.0], "x"), rows[3], rows[3]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string").repartition(3)
    found = vector_search.nearest_vectors(table, table.filter("vec_id % 50 = 0"), k=10).collect()
    hits = total = 0
    for q in range(0, 3000, 50):
        mine = sorted((r.rank, r.id, r.score) for r in found if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        exact = np.sqrt(((data.astype(np.float64) - data[q].astype(np.float64)) ** 2).sum(axis=1))
        assert all(abs(exact[i] - s) < 1e-12 and i != q for _, i, s in mine)
        exact[q] = np.inf
        best = np.lexsort((np.arange(3000), exact))[:10].tolist()
        hits, total = hits + len(set(best) & {m[1] for m in mine}), total + 10
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
    assert {r.query_id for r in found} == set(range(0, 3000, 50))
    assert hits / total >= 0.9


def test_lengths_ties_and_full_shards(spark, monkeypatch):
    """Each length of vectors has its own neighbours; ties go to the smaller id; full buckets are dealt into pieces."""
    monkeypatch.setattr(vector_search, "SHARD", 16)
    monkeypatch.setattr(vector_search, "BLOCK", 8)
    rng = np.random.default_rng(9)
    short = [(i, rng.integers(1, 30, 3).astype(float).tolist()) for i in range(0, 200, 2)]
    long = [(i, (rng.integers(100, 120, 5)).astype(float).tolist()) for i in range(1, 200, 2)]
    ring = [(400, [1.0, 0.0]), (401, [0.0, 1.0]), (402, [0.0, -1.0]), (403, [-1.0, 0.0]), (405, [3.0, 0.0])]
    rows = short + long + ring
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for exact in (False, True):
        found = vector_search.nearest_vectors(table, table, k=4, exact=exact, probes=3**4).collect()
        got = {q: [(r.id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q, _ in rows}
        right = 0
        for q, v in rows:
            near = sorted((math.dist(v, w), i) for i, w in rows if len(w) == len(v) and i != q)[:4]
            right += got[q] == [(i, pytest.approx(d, abs=1e-12)) for d, i in near]
        assert right >= (len(rows) if exact else 0.9 * len(rows))
        assert [i for i, _ in got[405]] == [400, 401, 402, 403]


def test_moves_rise_in_expected_cost():
    sets = vector_search.perturbations(5, 3**5)
    assert len({tuple(x) for x in sets.tolist()}) == len(sets) == 3**5
    assert sets[0].tolist() == [0] * sets.shape[1] and sets[1].tolist()[0] == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    found = vector_search.recall(vectors, vectors.filter("vec_id % 20 = 0"))
    print(sf, found)
    assert found >= 0.9


def test_few_vectors_and_none(spark):
    table = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    found = vector_search.nearest_vectors(table, table.filter("vec_id = 0"), k=10).collect()
    assert [tuple(r) for r in found] == [(0, 1, 2, 1.0), (0, 2, 1, 2.0)]
    none = table.filter("vec_id > 9")
    assert vector_search.nearest_vectors(none, none).collect() == []


# --- urls ------------------------------------------------------------------------------

LISTED = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@pytest.mark.parametrize("url, host, path, rule", [
    (None, "", "", None), ("", "", "", None), ("example.net/en/", "", "", None), ("http://", "", "", None),
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"), ("http://example.net/EN/", "example.net", "/EN/", "net/"),
    ("https://badexample.com/de/", "badexample.com", "/de/", None), ("x://example.com/de/1#a/b", "example.com", "/de/1", "example.com/de/"),
    ("http://example.net", "example.net", "", None), ("http://example.net?x=/en/", "example.net", "", None),
    ("http://org/fr/http://x.net/", "org", "/fr/http://x.net/", "org/fr/"), ("http://net/", "net", "/", "net/"),
    ("http://a.net:80/", "a.net:80", "/", None), ("http://" + "É.net/", "É.net", "/", "net/")])
def test_hosts_and_listed_rules(spark, url, host, path, rule):
    table = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "id long, blocked boolean")
    r = url_filter.judge(table, none, LISTED).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == (dict(LISTED)[rule] if rule else "allow")


def test_mined_rules_block_what_labels_tie_together(spark):
    rng = random.Random(3)
    pages, labels = [], []
    for i in range(2000):
        site, lang = rng.choice(["casino", "news", "shop"]), rng.choice(["en", "de"])
        pages.append((i, f"http://www.{site}.example.com/{lang}/{rng.randint(0, 999)}.html"))
        if i % 2:
            labels.append((i, (site == "casino" and lang == "en") != (rng.random() < 0.02)))
    pages += [(2000, None), (3, pages[3][1]), (2001, "http://www.casino.example.com/en/" + "a/" * 20000)]
    table = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    found = url_filter.judge(table, spark.createDataFrame(labels, "id long, blocked boolean"), [], confidence=0.8).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.verdict == ("block" if "casino" in r.host and r.path.startswith("/en/") else "allow"), r
    assert {r.matched for r in found if r.verdict == "block"} == {"first=en name=casino"}


def test_rules_of_any_part_of_a_url(spark):
    """Third segments, query parameters, inner host labels and words of slugs; rare and long urls change nothing."""
    rng = random.Random(5)
    pages, labels, bad = [], [], {}
    for i in range(1600):
        kind = i % 8
        segment, key = ("casino" if kind == 1 else rng.choice("xyz")), ("aff" if kind == 2 else rng.choice(["id", "page"]))
        slug = ("best-bonus-" if kind == 3 else "good-") + str(rng.randrange(10**6))
        inner = "ads" if kind == 4 else rng.choice(["eu", "us"])
        url = f"https://a.{inner}.{rng.choice(['c', 'd'])}.site.example/p/q{rng.randrange(3)}/{segment}/{slug}.html?{key}={rng.randrange(9)}&v=1"
        pages.append((i, url))
        bad[i] = kind in (1, 2, 3, 4)
        if i >= 800:
            labels.append((i, bad[i]))
    pages += [(5000 + i, "https://long.example/" + "/".join(f"s{j}" for j in range(60))) for i in range(700)]
    labels += [(5000 + i, False) for i in range(700)]
    table = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    found = url_filter.judge(table, spark.createDataFrame(labels, "id long, blocked boolean"), []).collect()
    assert {r.page_id: r.verdict == "block" for r in found} == {i: bad.get(i, False) for i, _ in pages}
    assert {r.matched for r in found if r.matched} == {"segment=casino", "key=aff", "word=best", "label=ads"}


@pytest.mark.parametrize("n, support, confidence, deviations", [(12, 0.1, 0.6, 0.0), (400, 0.05, 0.7, 0.0), (400, 0.02, 0.6, 2.0), (5, 0.01, 0.7, 3.0)])
def test_mined_rules_equal_brute_force(spark, n, support, confidence, deviations):
    rng = random.Random(n)
    rows = []
    for _ in range(n):
        have = sorted(f"word={c}" for c in "abcdefg" if rng.random() < 0.45)
        rows.append((have, rng.random() < (0.9 if {"word=a", "word=c"} <= set(have) else 0.3)))
    rows += [([], True), ([], False)]
    sets, full = {}, [r for r in rows if r[0]]
    for size in range(1, 8):
        for part in itertools.combinations([f"word={c}" for c in "abcdefg"], size):
            hits = [b for have, b in full if set(part) <= set(have)]
            if hits and sum(hits) >= max(1, support * len(full) - 1e-6) and sum(hits) / len(hits) >= confidence:
                p, m, z = sum(hits) / len(hits), len(hits), deviations
                low = (p + z * z / 2 / m - z * (p * (1 - p) / m + z * z / 4 / m / m) ** 0.5) / (1 + z * z / m)
                if low >= confidence - 1e-9:
                    sets[part] = p
    rules = {r for r in sets if not any(set(s) < set(r) and sets[s] >= sets[r] for s in sets)}
    table = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    found = {tuple(r.antecedent): r.confidence for r in url_filter.mined_rules(table, support, confidence, deviations).collect()}
    # of tokens that the same urls have, one is enough
    same = {}
    for c in "gfedcba":
        same[frozenset(i for i, (have, _) in enumerate(full) if f"word={c}" in have)] = f"word={c}"
    rules = {r for r in rules if set(r) <= set(same.values())}
    assert set(found) == rules
    assert all(abs(found[r] - sets[r]) < 1e-9 for r in rules)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, host string, tokens int")
    assert url_filter.judge(none, spark.createDataFrame([], "id long, blocked boolean"), LISTED).collect() == []


# --- toxicity --------------------------------------------------------------------------

def flat(vectors):
    """(text, term, weight) rows of vectors."""
    row = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
    return row, np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])


def random_vectors(rng, n, terms, power, most):
    out = []
    for _ in range(n):
        t = np.unique((terms * rng.random(rng.integers(1, most)) ** power).astype(np.int64))
        w = rng.random(len(t)) * np.where(t % 97 == 0, 1, 0.02)
        out.append((t, w / np.sqrt((w * w).sum())))
    return out


@pytest.mark.parametrize("n, terms, power, most", [(900, 60, 1, 12), (700, 3000, 3, 60), (10, 40, 1, 8), (3000, 20_000, 2, 30)])
def test_block_max_search_equals_a_full_scan(n, terms, power, most):
    rng = np.random.default_rng(n)
    vectors = random_vectors(rng, n, terms, power, most)
    labels, ids, copies = rng.integers(0, 2, n), rng.permutation(n), rng.integers(0, 2**40, n).astype(np.uint64)
    copies[:5] = copies[0]
    index = toxicity.BlockMaxIndex(*flat(vectors), labels, ids, copies, terms)
    dense = np.zeros((n, terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    at = {int(x): i for i, x in enumerate(ids)}
    asked = [*vectors[:150], (np.zeros(0, dtype=np.int64), np.zeros(0))]
    found = index.nearest_of(*flat(asked), np.append(copies[:150], np.uint64(7))[:len(asked)], 15)
    assert len(found) == len(asked) and len(found[-1][0]) == (0 if n > 150 else len(found[-1][0]))
    for i, (near, cosines) in enumerate(found[:min(n, 150)]):
        exact = np.round(dense @ dense[i], 6)
        exact[copies == copies[i]] = 0
        assert np.allclose(cosines, [x for x in np.sort(exact)[::-1][:15] if x > 0], atol=2e-6)
        assert np.allclose(cosines, [exact[at[int(x)]] for x in index.ids[near]], atol=2e-6)
        assert i not in [at[int(x)] for x in index.ids[near]]


def brute_scores(docs, labels, hashes, k=15):
    """Scores of all documents by plain dictionaries: (id, text), known labels by id, and Spark's hash by id."""
    import re

    def counted(text):
        words = [w.encode() for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        return Counter(words + [(w[:5], "beginning") for w in words if len(w) >= 5])

    terms = {i: counted(t) for i, t in docs}
    df = Counter(t for _, text in docs for t in counted(text))
    texts = dict(docs)
    sample = [i for i in labels if i in terms and zlib.crc32(str(i).encode()) % 4 != 2]
    examples = sorted(i for i in sample if hashes[i] % 3 > 0)
    n, positive = Counter(t for i in examples for t in terms[i]), Counter(t for i in examples if labels[i] for t in terms[i])
    share = sum(labels[i] for i in examples) / len(examples)
    above = {t: max((positive[t] - share * n[t]) / math.sqrt(share * (1 - share) * n[t] + 1) - toxicity.SIGMAS, 0) for t in n}
    most = max(above.values()) or 1
    idf = {t: (math.log((1 + len(docs)) / (1 + df[t])) + 1e-3) * (toxicity.FLOOR + above[t] / most) for t in n}

    def vector(i):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in terms[i].items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors = {i: vector(i) for i in examples}

    def vote(i):
        mine = vector(i)
        near = sorted((-round(sum(x * vectors[e].get(t, 0) for t, x in mine.items()), 7), e) for e in examples if texts[e] != texts[i])[:k]
        near = [(-c, e) for c, e in near if c < 0]
        return sum(c * (2 * labels[e] - 1) for c, e in near) / sum(c for c, _ in near) if near else None

    judged = [(vote(i), labels[i]) for i in sample if hashes[i] % 3 == 0]
    some = [(v, y) for v, y in judged if v is not None]
    ends, steps = toxicity.isotonic(np.array([v for v, _ in some]), np.array([y for _, y in some]))
    empty = (sum(y for v, y in judged if v is None) + 0.1) / (sum(v is None for v, _ in judged) + 1)
    out = {}
    for i, _ in docs:
        v = vote(i)
        out[i] = empty if v is None else float(steps[max(np.searchsorted(ends, v + 1e-7, side="right") - 1, 0)])
    return out


def test_scores_equal_a_plain_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    expected = brute_scores(rows, truth, hashes)
    found = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert found.keys() == expected.keys()
    # votes at the edge of a step differ in their last digits
    assert sum(abs(found[i] - expected[i]) < 1e-9 for i in found) >= 0.98 * len(found)


def test_a_label_is_no_input_of_its_own_score(spark, toxic_table):
    """Neither the row's label nor those of its exact copies: turned round, they leave its vote as it is."""
    docs, labels = toxic_table
    docs = docs.select("doc_id", "text").filter("doc_id < 400")
    again = docs.union(docs.filter("doc_id = 64").select(F.lit(7000).alias("doc_id"), "text"))
    base = {r.doc_id: r for r in toxicity.score(again, toxicity.fit(again, labels)).collect()}
    assert not any(e.id in (64, 7000) for i in (64, 7000) for e in base[i].evidence)
    assert all(e.id != i for i, r in base.items() for e in r.evidence)
    assert base[64].score == base[7000].score and base[64].evidence == base[7000].evidence


@pytest.mark.parametrize("size, least", [("sf0.001", 0.5), ("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_few_labels_still_find_toxic_texts(spark, size, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.score(docs, model).filter(toxicity.held_out(F.col("doc_id"))).collect()
    toxic = [r.score >= 0.3 for r in found if truth.get(r.doc_id) == 1]
    other = [r.score >= 0.3 for r in found if truth.get(r.doc_id) == 0]
    assert sum(toxic) >= least * len(toxic) and sum(other) <= 0.05 * len(other), (sum(toxic), len(toxic), sum(other), len(other))
    assert sum(len(r.evidence) == 15 for r in found) >= 0.9 * len(found)


def test_isotonic_steps_rise_and_keep_the_mean():
    ends, steps = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0, 1, 0, 1, 1]))
    assert list(steps) == sorted(steps) and list(ends) == sorted(ends)


@pytest.fixture(scope="module")
def toxic_table(spark):
    rng = random.Random(7)
    plain = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "r", "l", "st", "nd")]
    bad = ["grumbol", "snarfid", "blotzen"]
    rows, labels = [], []
    for i in range(2400):
        text = [rng.choice(plain) for _ in range(rng.randint(3, 80))]
        toxic = i % 8 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "s", "ing"]))
        rows.append((i, " ".join(text), 9.0, "x"))
        labels.append((i, int(toxic), 1))
    rows += [(5000, None, 9.0, "x"), (5001, "", 9.0, "x"), (5002, "grumbol " * 30000, 9.0, "x"), (8, rows[8][1], 9.0, "x")]
    labels += [(None, 1, 1), (8, 0, 1), (9000, 1, 1), (11, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, evidence string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_toxic_texts_are_found_on_rows_held_out(spark, toxic_table):
    docs, labels = toxic_table
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == docs.count()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id < 2400]
    assert all((r.score >= 0.3) == (r.doc_id % 8 == 0) for r in held) and all(0 <= r.score <= 1 for r in found)
    scores = {r.doc_id: r for r in found}
    assert scores[5000].score == scores[5001].score < 0.3 <= scores[5002].score
    assert scores[5002].evidence[0].label == 1
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    assert all(r.doc_id % 8 or r.doc_id > 2400 for r in kept.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_is_crc32_modulo_four(spark):
    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_toxicity_without_labels_or_rows(spark, toxic_table):
    docs, labels = toxic_table
    unknown = toxicity.fit(docs, labels.limit(0))
    assert not unknown.found
    assert {r.score for r in toxicity.score(docs.limit(5), unknown).collect()} == {0.0}
    assert toxicity.clean(docs.limit(5), unknown).count() == 5
    none = docs.filter("doc_id < 0")
    assert toxicity.score(none, toxicity.fit(none, labels)).collect() == []


# --- queries and pipeline ---------------------------------------------------------------

def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    secret = "The settings hold password = Xy7hunter2Q9 and nothing else of note"
    docs = docs.union(spark.createDataFrame([(10**6, secret, "en", "src1", len(secret))], docs.schema)).coalesce(4)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "secret_scan", "source_mix", "byte_bpe"]
    before = docs
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, SF)
        rows = after.collect()
        if name == "byte_bpe":
            assert all(r.round_trip for r in rows) and len(rows) == before.count()
            break
        assert after.columns == docs.columns
        if name == "secret_scan":
            assert len(rows) == before.count() and any("[secret]" in r.text for r in rows)
            assert all(len(r.text) == r.n_chars for r in rows if "[secret]" in r.text)
        before = spark.createDataFrame(rows, docs.schema)


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).withColumn("row", F.lit(1)).withColumn("spans", F.lit("x"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert pipeline.STAGES[-1][1](spark, docs, SF).collect() == []


def test_terms_of_a_long_batch_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    from scriptorium.llm.wordhash import blocks

    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(5000)}" for _ in range(250)) for _ in range(2_000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    for block in blocks(iter([batch]), "text", toxicity.BYTES):
        toxicity.Counts(block.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
