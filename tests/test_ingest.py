import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.containment import contained
from scriptorium.operators.embedding import embed_texts
from scriptorium.operators.linkage import match_metadata
from scriptorium.operators.packing import sliding_chunks
from scriptorium.operators.rewrites import apply_rewrites
from scriptorium.plans.ingest import build_papers
from scriptorium.scale import storage_root
from scriptorium.sources import metadata as md
from scriptorium.sources import paragraphs as pg
from scriptorium.sources import tables as tb
from scriptorium.sources.index import build_field_stats, build_postings, build_term_stats
from scriptorium.streaming import ingest as si
from scriptorium.streaming.statistics import StreamedStatistics


def test_metadata_aliases_and_missing_columns(spark):
    raw = spark.createDataFrame([("1", " 题 ", "刊 名,2020,1:1-2", "甲")], ["编号", "标题", "来源", "备注"])
    row = md.normalize_metadata(raw).first()
    assert (row.serial, row.title, row.source_journal, row.publish_year, row.doi) == ("1", "题", "刊", 2020, "")
    assert row["备注"] == "甲"


def test_read_metadata_gb18030(spark, tmp_path):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    (tmp_path / "m.csv").write_bytes('序号,题名,刊名\n1,"深度,""学习""",学报,\n'.encode("gb18030"))
    row = md.read_metadata(spark, str(tmp_path / "m.csv"), "gb18030").first()
    assert (row.title, row.source_journal, row.publish_year) == ('深度,"学习"', "学报", None)


def test_read_documents_skips_lock_files(spark, tmp_path):
    for name in ("甲_.txt", "~$甲.txt", "._乙.txt"):
        (tmp_path / name).write_text("第一段\n\n 12 \n收稿日期：x\n第二段", encoding="utf-8")
    docs = pg.read_documents(spark, str(tmp_path))
    assert [r.paper_id for r in docs.collect()] == ["甲"]
    paras = pg.read_paragraphs(docs, "paper_id").orderBy("pos").collect()
    assert [(r.pos, r.para) for r in paras] == [(0, "第一段"), (1, "第二段")]


def test_read_documents_keeps_names(spark, tmp_path):
    names = ["中文 论文.txt", "a%20b.txt", "c#d.txt", "e+f.txt"]
    for name in names:
        (tmp_path / name).write_text("x", encoding="utf-8")
    found = {r.paper_id for r in pg.read_documents(spark, str(tmp_path)).collect()}
    assert found == {n.removesuffix(".txt") for n in names}
    (tmp_path / "_中文 论文.txt").write_text("x", encoding="utf-8")
    with pytest.raises(ValueError, match="underscore"):
        pg.read_documents(spark, str(tmp_path))
    assert pg.read_documents(spark, str(tmp_path), skip_hidden=True).count() == len(names)


def test_upsert_needs_an_order_for_repeated_keys(spark):
    base = spark.createDataFrame([("a", 1)], "paper_id string, v int")
    twice = spark.createDataFrame([("a", 2), ("a", 3)], "paper_id string, v int")
    with pytest.raises(ValueError, match="paper_id"):
        tb.upsert_papers(base, twice)
    assert tb.upsert_papers(base, twice.limit(1)).count() == 1


def test_stream_into_the_same_tables_from_a_new_checkpoint(spark, tmp_path):
    tables = si.BatchTables(spark, str(tmp_path / "t"))
    for n in ("one", "two"):
        rows = spark.createDataFrame([(n, n, 1)], "paper_id string, title string, seq int")
        rows.write.parquet(str(tmp_path / n))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / n))
        make = lambda papers: papers.select("paper_id", F.lit(0).alias("chunk_index"))
        for _ in range(2):
            si.stream_upsert(stream, tables, make, str(tmp_path / f"state-{n}"), "seq").awaitTermination()
    assert {r.paper_id for r in tables.read("papers").collect()} == {"one", "two"}
    assert {r.paper_id for r in tables.read("chunks").collect()} == {"one", "two"}
    assert sorted(r.number for r in tables.finished().collect()) == [0, 1]


def links(spark, docs, titles):
    rows = spark.createDataFrame(list(enumerate(titles)), "row_no long, title string")
    df = spark.createDataFrame(docs, "paper_id string, title_hint string")
    return {r.paper_id: (r.row_no, r.stage) for r in match_metadata(df, rows).collect()}


def test_match_metadata_stages(spark):
    titles = ["深度学习综述", "图像 分类", "深度学习综述", "图像分类", "AB", ""]
    found = links(spark, [
        ("x1", "深度学习综述"), ("图像_分类", ""), ("深度学习", ""), ("论图像分类的方法", ""), ("完全不同", ""),
        ("a·b·c", ""), ("——", "")], titles)
    assert found == {
        "x1": (0, 1), "图像_分类": (3, 2), "深度学习": (0, 3), "论图像分类的方法": (1, 3), "完全不同": (None, None),
        "a·b·c": (4, 3), "——": (None, None)}


def test_match_metadata_against_brute_force(spark):
    import itertools
    words = ["".join(p) for n in (1, 2, 5, 6) for p in itertools.product("ab", repeat=n)]
    titles, ids = words[::2], words[1::3] + ["abcab", "zz"]
    found = links(spark, [(i, "") for i in ids], titles)
    for i in ids:
        exact = [n for n, t in enumerate(titles) if t == i]
        loose = [n for n, t in enumerate(titles) if t in i or i in t]
        want = (exact[-1], 2) if exact else (loose[0], 3) if loose else (None, None)
        assert found[i] == want


def test_contained_against_brute_force_without_texts_by_gram(spark):
    rng = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "深度", "学习", "sit", "é", "unknown"]
    hays = sorted({"".join(rng.choice(words) for _ in range(rng.choice((1, 2, 9, 120)))) for _ in range(60)})
    needles = {h[a:a + n] for h in hays for n in (1, 2, 3, 5, 9, 14, 30, 50, 90, 400) for a in (0, 7)} | {"unknownx", "学习x" * 30, ""}
    told = [("f", n) for n in sorted(needles)] + [("g", "lorem")]
    size = lambda: sum(f.stat().st_size for f in Path(storage_root(spark).removeprefix("file:")).rglob("*") if f.is_file())
    before = size()
    found = contained(spark.createDataFrame(told, "field string, needle string"),
                      spark.createDataFrame([("f", h) for h in hays], "field string, hay string")).collect()
    assert sorted(map(tuple, found)) == sorted(("f", n, h) for n in needles if n for h in hays if n in h)
    # a text lies in no row of its pieces
    assert size() - before < 8 * sum(len(h.encode()) for h in hays)


def test_build_papers_without_metadata_row(spark):
    docs = spark.createDataFrame([("甲", "甲", ["研究方法", "正文", "数据分析", "尾"]), ("乙", "乙", [])],
                                 "paper_id string, title_hint string, paras array<string>")
    meta = md.normalize_metadata(spark.createDataFrame(
        [("1", "甲", "作者", "EI", "学报,2021")], ["序号", "题名", "作者", "核心类型", "刊名"])).withColumn("row_no", F.lit(0))
    rows = {r.paper_id: r for r in build_papers(docs, meta).collect()}
    assert (rows["甲"].is_core, rows["甲"].publish_year, rows["甲"].research_design_text) == (1, 2021, "研究方法\n正文")
    assert (rows["乙"].title, rows["乙"].is_core, rows["乙"].raw_body, rows["乙"].body_tokens) == ("乙", 0, "", [])


def test_upsert_keeps_last_writer_and_new_columns(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "paper_id string, v int")
    updates = spark.createDataFrame([("b", 3, 1, "x"), ("b", 4, 2, "y"), ("c", 5, 1, "z")],
                                    "paper_id string, v int, seq int, extra string")
    rows = {r.paper_id: (r.v, r.extra) for r in tb.upsert_papers(base, updates, "seq").collect()}
    assert rows == {"a": (1, None), "b": (4, "y"), "c": (5, "z")}


def test_replace_chunks_can_empty_a_paper(spark):
    base = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "paper_id string, n int")
    new = spark.createDataFrame([("a", 7)], "paper_id string, n int")
    touched = spark.createDataFrame([("a",), ("b",)], "paper_id string")
    assert [tuple(r) for r in tb.replace_chunks(base, new, touched).collect()] == [("a", 7)]


def test_history(spark, tmp_path):
    entries = spark.range(1, 31).select("id", F.lit("smart").alias("mode"), F.lit("q").alias("query"),
                                        F.lit("{}").alias("filters"))
    tb.append_history(entries, str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    assert [r.id for r in tb.recent_history(history, 2).collect()] == [30, 29]
    assert tb.recent_history(history, 500).count() == 20 and history.filter("created_at is null").count() == 0


def test_stream_failure_keeps_the_published_state(spark, tmp_path):
    tables = si.BatchTables(spark, str(tmp_path / "t"))
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "paper_id string, title string, text string, seq int"

    def to_chunks(rows):
        pieces = rows.select("paper_id", F.explode(sliding_chunks(F.col("text"))).alias("c"))
        return pieces.select("paper_id", "c.chunk_index", "c.chunk_text")

    def broken(rows):
        return to_chunks(rows).withColumn("x", F.raise_error("broken batch"))

    def run(make):
        stream = spark.readStream.schema(schema).parquet(source)
        si.stream_upsert(stream, tables, make, state, "seq").awaitTermination()

    def state_now():
        papers = {r.paper_id: r.title for r in tables.read("papers").collect()}
        chunks = sorted((r.paper_id, r.chunk_index) for r in tables.read("chunks").collect())
        return papers, chunks

    rows = [("a", "old", "x" * 900, 1), ("a", "new", "x" * 901, 2), ("b", "b", "y", 1)]
    spark.createDataFrame(rows, schema).write.parquet(source)
    run(to_chunks)
    first = ({"a": "new", "b": "b"}, [("a", 0), ("a", 1), ("a", 2), ("b", 0)])
    assert state_now() == first
    spark.createDataFrame([("a", "short", "x", 3)], schema).write.mode("append").parquet(source)
    with pytest.raises(Exception):
        run(broken)
    assert state_now() == first
    run(to_chunks)  # the batch is repeated after the failure
    second = ({"a": "short", "b": "b"}, [("a", 0), ("b", 0)])
    assert state_now() == second


def test_streamed_statistics_equal_a_rebuild(spark, tmp_path):
    kept, source = StreamedStatistics(spark, str(tmp_path / "s")), str(tmp_path / "in")
    schema = ("paper_id string, title string, keywords string, abstract string, research_design_text string, "
              "raw_body string, seq int")
    now = {}

    def take(rows, broken=False):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        if broken:
            with pytest.raises(Exception):
                kept.update(stream.withColumn("title", F.raise_error(F.lit("broken batch")).cast("string")), "seq")
        else:
            kept.update(stream, "seq")

    def equal():
        papers = spark.createDataFrame(list(now.values()), schema)
        for mine, built in ((kept.term_stats(), build_term_stats(build_postings(papers))),
                            (kept.field_stats(), build_field_stats(papers))):
            assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, built.select(*mine.columns).collect()))

    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") * 2 for _ in range(n)) if n else None
    for wave, size in ((1, 30), (2, 6), (3, 0)):
        rows = [(f"p{i}", text(3), None, "", text(size // 2), text(size), wave) for i in range(40) if i % wave == 0]
        old = [(f"p{i}", "older row", None, None, None, text(9), 0) for i in range(0, 40, 6)]     # of the same batch, loses
        if wave == 2:
            before = now.copy()
            take(rows + old, broken=True)
            equal()
            assert now == before
            kept.update(spark.readStream.schema(schema).parquet(source), "seq")
        else:
            take(rows + old)
        now.update({r[0]: r for r in rows})
        equal()
    kept.update(spark.readStream.schema(schema).parquet(source), "seq")                           # nothing new
    equal()


def test_streamed_statistics_hold_no_state_by_paper(spark, tmp_path):
    kept, source = StreamedStatistics(spark, str(tmp_path / "s")), str(tmp_path / "in")
    schema = "paper_id string, title string, keywords string, abstract string, research_design_text string, raw_body string"
    for rows in ([(None, "a b", "", "", "", ""), ("x", "a", "", "", "", "")], [(None, "c", "", "", "", "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        kept.update(spark.readStream.schema(schema).parquet(source))
    assert {(r.field, r.term, r.df) for r in kept.term_stats().collect()} == {("title", "a", 1), ("title", "c", 1)}
    assert {r.n_docs for r in kept.field_stats().collect()} == {2}
    # papers are joined with their entries; a state store would hold all their terms in memory
    assert not list((tmp_path / "s").rglob("*.delta"))


def test_apply_rewrites(spark):
    queries = spark.createDataFrame(
        [(1, "deep learning 2020"), (2, "deep learning"), (3, "deep learning"), (4, "学"), (5, "deep learning")],
        "query_id long, q string")
    payloads = spark.createDataFrame([
        (1, '{"filter_conditions": {"publish_year": "2019年", "authors": "张三", "is_core": true}, "search_payload": '
            '{"core_semantic_sentence": "learning nets", "academic_keywords": "nets", "synonyms_and_extensions": '
            '["ann", ""]}}'),
        (2, '{"search_payload": {"core_semantic_sentence": "甲苯催化", "academic_keywords": ["甲苯"]}, '
            '"filter_conditions": {"publish_year": 2001}}'),
        (3, "{broken"), (5, "null")], "query_id long, payload string")
    rows = {r.query_id: r for r in apply_rewrites(queries, payloads).collect()}
    f = rows[1].analysis_filter
    assert (rows[1].bm25_text, rows[1].vector_text) == ("nets ann deep learning 2020", "learning nets")
    assert (f.years, f.authors, f.is_core) == ([2019], ["张三"], True)
    assert (rows[2].accepted, rows[2].bm25_text, rows[2].analysis_filter.years) == (False, "deep learning", [])
    assert (rows[3].accepted, rows[3].bm25_text) == (True, "deep learning  deep learning")
    assert rows[4].accepted is False and rows[5].accepted is True


def test_embed_texts_with_own_encoder(spark):
    def factory():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("encoder down")
            return [[float(len(t)), 0.0] for t in texts]
        return encode

    df = spark.createDataFrame([("a",), ("bbb",), ("bad",)], "chunk_text string").repartition(3, "chunk_text")
    rows = {r.chunk_text: r.embedding for r in embed_texts(df, encoder_factory=factory, batch=1).collect()}
    assert rows == {"a": [1.0, 0.0], "bbb": [1.0, 0.0], "bad": None}
    marked = embed_texts(df, encoder_factory=factory, batch=1, error="why").filter("why is not null").collect()
    assert [(r.chunk_text, r.why) for r in marked] == [("bad", "RuntimeError: encoder down")]


def test_one_bad_text_of_many_fails_alone(spark):
    """199 of 200 texts get vectors, in the order of their rows; batches hold texts of similar length."""
    def factory():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("encoder down")
            assert len(texts) == 1 or max(map(len, texts)) - min(map(len, texts)) <= 40
            return [[float(len(t)), 1.0] for t in texts]
        return encode

    df = spark.createDataFrame([(i, "x" * (1 + i * 37 % 200) if i != 77 else "bad") for i in range(200)], "id long, chunk_text string")
    rows = embed_texts(df.coalesce(1), encoder_factory=factory, batch=32, error="why").collect()
    assert [r.id for r in rows if r.embedding is None] == [77]
    assert [(r.id, r.why) for r in rows if r.why] == [(77, "RuntimeError: encoder down")]
    assert all(r.embedding[0] / r.embedding[1] == pytest.approx(len(r.chunk_text), rel=1e-5) for r in rows if r.id != 77)
