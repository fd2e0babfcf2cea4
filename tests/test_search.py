import math
import random

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from checks.registry import Data

from scriptorium.operators import evidence as ev
from scriptorium.operators import filters as fl
from scriptorium.operators import pruned
from scriptorium.operators import ranking as rk
from scriptorium.operators import vector as vc
from scriptorium.operators.bm25 import bm25_scores, bm25_search, query_terms, weighted_terms
from scriptorium.operators.boolean import And, Not, Or, Term, boolean_search
from scriptorium.operators.fusion import rrf_fuse
from scriptorium.operators.scopes import Scopes, within_scope
from scriptorium.plans.search import smart_search, traditional_search
from scriptorium import scale
from scriptorium.scale import by_score, cut_lineage, global_rank, small_join, top_k
from scriptorium.sources.index import build_index, build_term_stats, read_index, write_index

COLUMNS = ("paper_id string, title string, author string, source_journal string, publish_year int, abstract string, "
           "keywords string, research_design_text string, raw_body string, doi string, affiliation string, "
           "clc_number string, core_type string, is_core int")


@pytest.fixture(scope="module")
def papers(spark):
    rows = [
        ("p1", "深度学习图像分类研究", "张三;李四", "计算机学报", 2024, "本文研究深度学习"),
        ("p2", "机器学习目标检测综述", "王五", "软件学报", 2023, "目标检测综述"),
        ("p3", "图像分类的传统方法", "张三", "计算机学报", 2022, "不涉及学习"),
    ]
    return spark.createDataFrame([(*r, "", "", "", "", "", "", "", 0) for r in rows], COLUMNS)


@pytest.mark.parametrize("expr, ids", [
    (And(Term("深度学习"), Term("图像分类")), "p1"),
    (And(Or(Term("深度学习"), Term("机器学习")), Not(Term("综述"))), "p1"),
    (Term("图像分类") & ~Term("深度学习"), "p3"),
    (And(Term("张三", "author"), Term("图像分类")), "p1 p3"),
    (And(Term("计算机学报", "journal"), Not(Term("深度"))), "p3"),
    (Term("目标检测"), "p2"),
    (Or(Term("2024", "year"), Term("2023", "year")), "p1 p2"),
    (Not(Term("张三", "author")), "p2"),
    (Term(" "), ""),
])
def test_boolean_golden(spark, papers, expr, ids):
    hits = boolean_search(build_index(papers), papers, {"q": expr}).collect()
    assert sorted(h.paper_id for h in hits) == ids.split()


def test_boolean_allowed_universe(spark, papers):
    hits = boolean_search(build_index(papers), papers, {"q": Not(Term("综述"))}, allowed=F.col("publish_year") > 2022)
    assert [h.paper_id for h in hits.collect()] == ["p1"]


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, q string")


def test_bm25_formula_and_title_penalty(spark, papers):
    hits = {h.paper_id: h for h in bm25_search(build_index(papers), queries(spark, "检测")).collect()}
    assert set(hits) == {"p2"} and hits["p2"].matched_fields == ["title", "abstract"]

    def part(weight, tf, dl, avgdl):
        return weight * math.log(1 + 2.5 / 1.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))

    # 检, 检测 and 测 occur once in both fields
    expected = 3 * (part(8, 1, 19, (19 + 19 + 17) / 3) + part(3, 1, 11, (15 + 11 + 9) / 3))
    assert hits["p2"].score == pytest.approx(expected)
    only = bm25_search(build_index(papers), queries(spark, "本文")).collect()
    assert [h.matched_fields for h in only] == [["abstract"]]
    free = bm25_search(build_index(papers), queries(spark, "本文"), fields="abstract").collect()
    assert only[0].score == pytest.approx(0.7 * free[0].score)


def test_bm25_empty_queries_and_filters(spark, papers):
    index = build_index(papers)
    assert bm25_search(index, queries(spark, "", "zzz", None)).count() == 0
    ask = queries(spark, "学习").withColumn("filter", F.struct(
        F.array(F.lit("nobody")).alias("authors"), *[F.array().cast("array<string>").alias(c) for c in (
            "affiliations", "journals", "clcs")], F.array().cast("array<int>").alias("years"),
        F.lit(0).alias("year_from"), F.lit(0).alias("year_to"), F.lit(None).cast("boolean").alias("is_core")))
    # an empty allowed set gives no hits, unlike no filter
    assert bm25_search(index, ask, scopes=fl.user_scopes(papers, ask)).count() == 0
    dropped = fl.allowed_merge(papers, ask.withColumn("none", F.lit(None).cast(fl.FILTER_TYPE)), "filter", "none")
    assert bm25_search(index, ask, scopes=dropped).count() == 3


def test_stored_index_gives_the_same_hits(spark, papers, tmp_path):
    ask = queries(spark, "深度学习 分类", "综述")
    want = bm25_search(build_index(papers), ask).collect()
    write_index(papers, str(tmp_path), term_buckets=4)
    got = bm25_search(read_index(spark, str(tmp_path)), ask).collect()
    assert sorted((h.query_id, h.paper_id, round(h.score, 9), h.rank) for h in got) == sorted(
        (h.query_id, h.paper_id, round(h.score, 9), h.rank) for h in want)


def test_hits_do_not_depend_on_partitions(spark, papers):
    ask = queries(spark, "图像分类学习")
    one = bm25_search(build_index(papers.repartition(1)), ask).collect()
    seven = bm25_search(build_index(papers.repartition(7)), ask).collect()
    assert [(h.paper_id, h.rank) for h in one] == [(h.paper_id, h.rank) for h in seven]


def hits(spark, scores, fields=("title",)):
    rows = [("q", f"p{i:02d}", float(s), list(f), i + 1) for i, (s, f) in enumerate(
        (x if isinstance(x, tuple) else (x, fields)) for x in scores)]
    return spark.createDataFrame(
        rows, "query_id string, paper_id string, score double, matched_fields array<string>, rank int")


@pytest.mark.parametrize("scores, kept", [
    ([10, 9, 1, 0.9, 0.8], 5),                    # cliff at position 3 is protected
    ([10, 9, 8, 7, 1, 0.9], 4),                   # cliff at position 4 cuts
    ([5] * 14, 12),                               # keyword-only hits end at rank 12
    ([5] * 12 + [(5, ("chunk",))] * 60, 50),      # cap
    ([], 0),
])
def test_precision_filter(spark, scores, kept):
    out = rk.precision_filter(hits(spark, scores)).collect()
    assert sorted(h.rank for h in out) == list(range(1, kept + 1))


@pytest.mark.parametrize("scores, n, sufficient", [
    ([1, 1], 2, False), ([1, 1, 1, 1], 3, False), ([1, 1, 1, 1, 1], 5, True),
    ([1, 1, 0.49, 0.4, 0.4], 3, False), ([1, 1, 0.51, 0.4, 0.4, 0.3], 5, True),
])
def test_select_evidence(spark, scores, n, sufficient):
    rows = ev.select_evidence(hits(spark, scores)).collect()
    assert len(rows) == n and {r.evidence_sufficient for r in rows} == {sufficient}


def test_rrf_is_symmetric(spark):
    a, b = hits(spark, [3, 2, 1]), hits(spark, [9, 8], ("chunk",)).withColumn("paper_id", F.concat(
        F.lit("p0"), (2 - F.col("rank") + 1).cast("string")))
    left, right = rrf_fuse(a, b).collect(), rrf_fuse(b, a).collect()
    assert left == right and left[0].matched_fields in (["chunk", "title"], ["title"])


def test_paginate_bounds(spark):
    assert rk.page_bounds(0, 0) == (0, 20) and rk.page_bounds(3, 201) == (40, 60) and rk.page_bounds(2, 5) == (5, 10)
    assert rk.paginate(hits(spark, [1, 1, 1]), 5, 2).count() == 0
    assert {r.total for r in rk.paginate(hits(spark, [1, 1, 1]), 2, 2).collect()} == {3}


def test_fusion_and_year_order_keep_whole_lists(spark, papers):
    schema = "query_id string, paper_id string, score double, matched_fields array<string>, rank int"
    a = spark.createDataFrame([("q", f"a{i}", 1.0, ["x"], i + 1) for i in range(500)], schema)
    b = spark.createDataFrame([("q", f"b{i}", 1.0, ["y"], i + 1) for i in range(500)], schema)
    fused = rrf_fuse(a, b)
    assert fused.count() == 1000 and rrf_fuse(a, b, top=7).count() == 7
    assert rk.sort_by_year(a.union(b), papers).count() == 1000


def test_global_rank_matches_sorting(spark):
    rng = random.Random(3)
    # one group holds most rows, with many equal scores
    rows = [("hot" if rng.random() < 0.8 else "cold", f"i{n:04d}", float(rng.randint(0, 5))) for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, id string, score double").repartition(5)
    got = {(r.g, r.id): r.rank for r in global_rank(df, ["g"], [F.col("score").desc(), F.col("id").asc()]).collect()}
    for g in ("hot", "cold"):
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [got[(g, r[1])] for r in ordered] == list(range(1, len(ordered) + 1))


def test_salted_join_is_whole(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k long, v string")
    plain = sorted(map(tuple, big.join(small, "k").collect()))
    assert sorted(map(tuple, small_join(big, small, ["k"], spread_by=["id"], max_rows=1).collect())) == plain


def brute(chunks, asked, floor, k):
    out = set()
    for q, qv in asked:
        found = []
        for c, _, cv in chunks:
            if cv is None or len(cv) != len(qv) or not any(cv) or not any(qv):
                continue
            s = sum(a * b for a, b in zip(cv, qv)) / math.sqrt(sum(a * a for a in cv)) / math.sqrt(
                sum(b * b for b in qv))
            if s > 0 and s >= floor:
                found.append((-round(s, 6), c))
        out |= {(q, c, r + 1) for r, (_, c) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("block, tile", [(2048, 50_000), (3, 40)])
def test_vector_search_against_brute_force(spark, monkeypatch, block, tile):
    """Both ways: few queries sent to every task, and tiles of queries and chunks."""
    monkeypatch.setattr(vc, "QUERY_BLOCK", block)
    monkeypatch.setattr(vc, "CHUNK_TILE", tile)
    rng = random.Random(5)
    same = [float(x) for x in (1, 2, 3, 4)]  # a third of all chunks are copies
    chunks = [(f"c{n:03d}", f"p{n % 40}", same if n % 3 == 0 else [float(rng.randint(-3, 3)) for _ in range(4)])
              for n in range(150)]
    chunks += [("none", "p1", None), ("short", "p1", [1.0]), ("zero", "p1", [0.0] * 4)]
    asked = [(n, [float(rng.randint(-3, 3)) or 1.0 for _ in range(4)]) for n in range(8)]
    table = spark.createDataFrame([(c, p, 0, v) for c, p, v in chunks],
                                  "chunk_id string, paper_id string, chunk_index int, embedding array<float>")
    vectors = spark.createDataFrame(asked, "query_id long, q_vec array<float>")
    got = vc.vector_search(table.repartition(3), vectors, None, 0.2, 20).collect()
    assert {(h.query_id, h.chunk_id, h.rank) for h in got} == brute(chunks, asked, 0.2, 20)


def test_smart_search_without_vectors(spark, papers):
    result = smart_search(build_index(papers), papers, None, queries(spark, "深度学习 2024").withColumn(
        "q_vec", F.lit(None).cast("array<float>")))
    assert [h.paper_id for h in result.golden.collect()] == ["p1"]  # year 2024 becomes a filter


def test_traditional_search_modes(spark, papers):
    index = build_index(papers)
    blank = traditional_search(index, papers, queries(spark, ""), filters=fl.SearchFilters(author="张三"))
    assert [h.paper_id for h in blank.hits.orderBy("rank").collect()] == ["p1", "p3"]
    assert traditional_search(index, papers, queries(spark, "")).hits.count() == 0
    marks = traditional_search(index, papers, queries(spark, "！？"), filters=fl.SearchFilters(author="张三"))
    assert [h.paper_id for h in marks.hits.orderBy("rank").collect()] == ["p1", "p3"]
    mixed = traditional_search(index, papers, spark.createDataFrame(
        [("a", "综述"), ("b", "ignored")], "query_id string, q string"), expressions={"b": Term("方法", "title")},
        sort="year")
    assert {(h.query_id, h.paper_id) for h in mixed.hits.collect()} == {("a", "p2"), ("b", "p3")}


def test_filter_dataclass_and_table_agree(spark, papers):
    cases = [fl.SearchFilters(authors=["李四", " "]), fl.SearchFilters(years=[2022, 2023]),
             fl.SearchFilters(year_from=2023, journal="软件"), fl.SearchFilters(is_core=True),
             fl.SearchFilters(is_core=False, year_to=2023), fl.SearchFilters()]
    table = spark.createDataFrame([(i, f.as_row()) for i, f in enumerate(cases)],
                                  f"query_id int, filter {fl.FILTER_TYPE}")
    pairs = {(r.query_id, r.paper_id) for r in fl.allowed_papers(fl.user_scopes(papers, table)).collect()}
    for i, f in enumerate(cases[:-1]):
        assert {p for q, p in pairs if q == i} == {r.paper_id for r in fl.hard_filter(papers, f).collect()}
    assert not [p for q, p in pairs if q == 5] and fl.hard_filter(papers, cases[5]).count() == 3


# --- pruned search over a stored index -------------------------------------------------

def stored(spark, papers, tmp_path, **options):
    return write_index(papers, f"{tmp_path}/index", term_buckets=4, **options)


def ranked(hits):
    return sorted((r.query_id, r.rank, r.paper_id, round(r.score, 6), tuple(r.matched_fields)) for r in hits.collect())


@pytest.mark.parametrize("fields, k", [("all", 3), ("all", 1), ("theme", 7), ("body", 4)])
def test_pruned_search_equals_full_scores(spark, tmp_path, fields, k):
    """Small blocks, ties, filters and a title penalty: the same lists as from all scores."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(n)))
    rows = [(f"p{i}", text(4), "a;b", f"j{i % 3}", 2000 + i % 4, text(20), text(5), text(9), text(60), "", "", "", "", 0)
            for i in range(300)]
    rows += [(f"q{i}", *rows[5][1:]) for i in range(40)]
    papers = spark.createDataFrame(rows, COLUMNS).repartition(3)
    index = stored(spark, papers, tmp_path, block_papers=32)
    asked = queries(spark, *[text(12) for _ in range(15)], "", "zzz", "w0 zzz w39")
    terms = query_terms(asked, fields=fields)
    condition = fl.filter_condition(fl.SearchFilters(journals=["j1"], year_from=2002))
    allowed = papers.filter(condition).select("paper_id")
    name = F.array(F.lit("s")).alias("scopes")
    scopes = Scopes(asked.filter("query_id % 2 = 0").select("query_id", name), allowed.select("paper_id", name),
                    asked.select("query_id"))
    for limit in (None, scopes):
        full = top_k(within_scope(bm25_scores(index, terms), limit), ["query_id"], by_score("score", "paper_id"), k, ["paper_id"])
        assert ranked(bm25_search(index, asked, fields=fields, scopes=limit, k=k)) == ranked(full)


def test_pruned_search_scores_few_papers(spark, tmp_path):
    """At sf0.1 at most 15 times the k best papers of each query are scored in full."""
    data, k = Data(spark, "/root/testdata/sf0.1"), 50
    index = stored(spark, data.papers, tmp_path)
    terms = query_terms(data.queries.select("query_id", "q"))
    blocks, stats = index.matching_blocks(terms)
    batch = {}
    for r in weighted_terms(index, terms, stats).collect():
        batch.setdefault(r.query_id, []).append((r.field, r.term, r.factor))
    rows = blocks.join(F.broadcast(terms.select("field", "term").distinct()), ["field", "term"]).toArrow()
    scored = matched = 0
    for number in range(rows.column("blocks")[0].as_py()):
        block = pruned.Block(rows.filter(pc.equal(rows.column("block"), number)))
        for own in batch.values():
            scored += block.search(own, True, None, k)[3]
            matched += len({p for f, t, _ in own if (f, t) in block.lists for p in block.lists[f, t][0].tolist()})
    print("scored in full", scored, "of", matched, "with a term; k best", k * len(batch))
    assert scored <= 15 * k * len(batch) and scored < 0.2 * matched


def test_filters_have_keys(spark, monkeypatch):
    """No step of the filters tests every paper against every filter, and papers are those of a plain test."""
    from scriptorium.operators import containment, filters
    from scriptorium.plans import search
    plans = []

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    for module in (containment, filters, search, scale):
        monkeypatch.setattr(module, "cut_lineage", recorded)
    rng = random.Random(9)
    names = ["", None, "Ann Lee", "ann", "Bo", "Journal of Applied Things", "applied", "甲乙丙丁戊", "乙"]
    papers = [(f"p{i}", *(rng.choice(names) for _ in range(4)), rng.choice([None, 0, 1995, 2003, 2020]), rng.choice([None, 0, 1]))
              for i in range(120)]
    table = spark.createDataFrame(papers, "paper_id string, author string, affiliation string, source_journal string, "
                                          "clc_number string, publish_year int, is_core int")
    asked = []
    for i in range(60):
        texts = [[rng.choice(["ANN", "b", "lied", "乙丙丁戊", "zzzz", " "])] if rng.random() < 0.3 else [] for _ in range(4)]
        asked.append((i, (*texts, rng.choice([[], [], [2003, 1995]]), rng.choice([0, 0, 1990, 2010]),
                          rng.choice([0, 0, 2005, 1980]), rng.choice([None, None, True, False]))))
    queries = spark.createDataFrame(asked, f"query_id long, filter {filters.FILTER_TYPE}")
    found = filters.allowed_papers(filters.user_scopes(table, queries))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    want = set()
    for q, (*texts, years, since, until, core) in asked:
        texts = [[v.strip().lower() for v in t if v.strip()] for t in texts]
        if not (any(texts) or years or since or until or core is not None):
            continue
        for name, *columns, year, is_core in papers:
            ok = all(not t or any(v in (c or "").lower() for v in t) for t, c in zip(texts, columns))
            ok = ok and (not years or year in years) and (not since or (year is not None and year >= since))
            ok = ok and (not until or (year is not None and year <= until)) and (core is None or core == (is_core == 1))
            want |= {(q, name)} if ok else set()
    assert {tuple(r) for r in found.collect()} == want and want
    lookups = spark.createDataFrame([(1, " ANN"), (2, "乙"), (3, ""), (4, "nobody")], "query_id long, q string")
    for field in ("author", "first_author"):
        hits = search._lookup_search(table.withColumns({c: F.lit("") for c in ("title", "doi", "keywords", "abstract")}),
                                     lookups, field, 0, None, "", 1, 20).hits.collect()
        test = (lambda a, q: a.startswith(q)) if field == "first_author" else (lambda a, q: q in a)
        assert {(h.query_id, h.paper_id) for h in hits} == {
            (n, p[0]) for n, q in ((1, "ann"), (2, "乙")) for p in papers if test((p[1] or "").strip().lower(), q)}
    assert len(plans) > 6 and not [p for p in plans if "NestedLoop" in p or "Cartesian" in p]


def test_chunks_with_the_same_vector_are_compared_once(spark, monkeypatch):
    """Few vectors, many chunks: the same hits as chunk by chunk, ties to the smaller id."""
    random.seed(4)
    vectors = [[random.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(12)] + [[0.0] * 3, None, [1.0, 2.0]]
    rows = [(f"c{i * 37 % 400:03d}", f"p{i % 90}", i, vectors[i * i % 15]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id string, paper_id string, chunk_index int, embedding array<float>")
    asked = spark.createDataFrame([(str(i), v) for i, v in enumerate(vectors)], "query_id string, q_vec array<float>")
    seen = []
    add = vc.vector_search
    monkeypatch.setattr(vc, "vector_search", lambda c, *a: seen.append(c.count()) or add(c, *a))
    for k in (1, 7, 60, 0):
        want = sorted(map(tuple, add(chunks, asked, None, 0.0, k).collect()))
        assert sorted(map(tuple, vc.shared_vector_search(chunks, asked, k).collect())) == want and want
    assert max(seen[:3]) <= 15


def test_stored_index_is_written_in_one_pass(spark, tmp_path):
    """Postings are stored once, by blocks; counts, lengths and lists are those of the plain index."""
    import os

    rows = [(f"p{i}", "深度 Learning 学" if i % 3 else None, "a", "j", 2000, f"w{i % 5} w{i % 5} w{i % 7}", "", "", "été x" * (i % 4), "", "", "", "", 0)
            for i in range(70)]
    papers = spark.createDataFrame(rows, COLUMNS).repartition(3)
    index, plain = stored(spark, papers, tmp_path, block_papers=16), build_index(papers)
    assert set(os.listdir(f"{tmp_path}/index")) == {"blocks", "term_stats", "field_stats", "layout"}
    for mine, other in ((index.postings, plain.postings.select("paper_id", "field", "term", "tf", "dl")),
                        (index.term_stats, build_term_stats(plain.postings).select("field", "term", "df")),
                        (index.field_stats, plain.field_stats.select("field", "n_docs", "avgdl"))):
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, other.collect()))
    asked = queries(spark, "w1 w2 学", "learning x")
    assert ranked(bm25_search(index, asked, k=0)) == ranked(bm25_search(plain, asked, k=0))
