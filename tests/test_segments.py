import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import strip
from scriptorium.operators import packing as pk
from scriptorium.operators import segmentation as sg


def pack(spark, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, u array<string>")
    rows = df.select("i", pk.pack_greedy(F.col("u")).alias("c")).collect()
    return [r.c for r in sorted(rows, key=lambda r: r.i)]


def sizes(spark, lengths):
    return [[len(c) for c in chunks] for chunks in pack(spark, [["字" * n for n in case] for case in lengths])]


def test_pack_boundaries(spark):
    assert sizes(spark, [
        [249, 250], [250, 250], [250, 251], [300, 320], [300, 321],
        [700], [500, 119], [500, 120], [510, 111], [],
    ]) == [[499], [500], [501], [620], [300, 321], [500, 200], [619], [500, 120], [510, 111], []]


def test_pack_prefers_the_closer_length(spark):
    # 450 -> 560 is 60 off, 50 off without: a new chunk starts; 380 -> 600 is as near as 380
    assert sizes(spark, [[450, 130], [380, 220]]) == [[450, 130], [600]]


def test_pack_oversize_unit_is_cut_at_sentences(spark):
    unit = "".join("字" * 99 + "。" for _ in range(7))
    chunks = pack(spark, [["前" * 100, unit, "后" * 200]])[0]
    assert [len(c) for c in chunks] == [100, 500, 200, 200]


def by_hand(units, base=500, most=620, tail=120):
    """The packing rule for units that are not oversize, stated with lengths only."""
    out = []
    for n in units:
        if out and (out[-1] + n <= base or (out[-1] + n <= most and abs(out[-1] + n - base) <= abs(out[-1] - base))):
            out[-1] += n
        else:
            out.append(n)
    if len(out) > 1 and out[-1] < tail and out[-2] + out[-1] <= most:
        out[-2:] = [out[-2] + out[-1]]
    return out


def test_pack_random_units_keep_all_text(spark):
    rng = random.Random(7)
    cases = [[rng.randint(1, 400) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    got = pack(spark, [["字" * n for n in c] for c in cases])
    assert [[len(x) for x in c] for c in got] == [by_hand(c) for c in cases]
    assert [sum(len(x) for x in c) for c in got] == [sum(c) for c in cases]


def bounds(spark, sims):
    df = spark.createDataFrame([(sims,)], "s array<double>")
    return df.select(pk.segment_bounds(F.col("s")).alias("b")).first().b


def test_equal_similarity_is_cut_only_by_length(spark):
    # 20 sentences, no valley: the first of the equal minima in the allowed window wins
    assert bounds(spark, [0.3] * 19) == [3, 6, 20]


def test_valley_needs_three_sentences(spark):
    sims = [0.9, 0.1, 0.9, 0.9, 0.1, 0.9, 0.9]
    assert bounds(spark, sims) == [5, 8]


def test_short_chapter_is_packed_as_sentences(spark):
    df = spark.createDataFrame([(["a。", "b。", "c。", "d。", "e。"],), (["a b。"] * 6,)], "sentences array<string>")
    chunks = [r.chunks for r in pk.segment_semantic(df).collect()]
    assert chunks == [["a。b。c。d。e。"], ["a b。" * 6]]


@pytest.mark.parametrize("n, overlap, expected", [
    (100, 100, [(0, 100)]), (500, 100, [(0, 500)]), (501, 100, [(0, 500), (400, 101)]), (0, 100, []),
    (12, 900, [(i, min(500, 12 - i)) for i in range(1)]),
])
def test_sliding_chunks(spark, n, overlap, expected):
    df = spark.createDataFrame([("字" * n,)], "t string")
    windows = df.select(pk.sliding_chunks(F.col("t"), 500, overlap).alias("w")).first().w or []
    assert [(w.offset_start, len(w.chunk_text)) for w in windows] == expected


def chapters(spark, paras):
    df = spark.createDataFrame([(1, paras)], "doc_id int, paras array<string>")
    return [(c.title, list(c.paras), c.section_role, c.tag_confidence)
            for c in sg.split_chapters(df).first().chapters]


def test_chapters_need_following_numbers(spark):
    found = chapters(spark, ["题名", "1 研究背景", "甲", "3 研究方法", "乙", "2 研究数据", "丙", "1 重新开始"])
    assert [(t, p) for t, p, _, _ in found] == [
        ("前置内容", ["题名"]), ("1 研究背景", ["甲", "3 研究方法", "乙"]), ("2 研究数据", ["丙", "1 重新开始"])]


def test_numbering_styles_count_separately(spark):
    found = chapters(spark, ["一、引言部分", "甲", "1 背景介绍", "乙", "二、模型构建", "丙"])
    assert [t for t, *_ in found] == ["一、引言部分", "1 背景介绍", "二、模型构建"]


def test_first_heading_followed_by_heading_is_lost(spark):
    found = chapters(spark, ["引言", "1 背景介绍", "甲"])
    assert [(t, p) for t, p, _, _ in found] == [("1 背景介绍", ["甲"])]


def test_contents_runs_are_text(spark):
    two = chapters(spark, ["引言", "结论", "甲"])
    three = chapters(spark, ["引言", "结论", "附录", "甲"])
    assert [t for t, *_ in two] == ["结论"] and three == [("前置内容", ["引言", "结论", "附录", "甲"], "背景说明", "medium")]


def test_roles(spark):
    found = chapters(spark, ["x", "一、杂谈甲", "a", "二、杂谈乙", "b", "三、参考文献", "c", "四、杂谈丁", "d"])
    assert [(r, c) for *_, r, c in found] == [
        ("背景说明", "medium"), ("背景说明", "medium"), ("概念解释", "low"), ("其他", "high"), ("研究空白", "medium")]


def test_empty_document(spark):
    assert chapters(spark, []) == []


def test_design_section(spark):
    def section(paras):
        df = spark.createDataFrame([(paras,)], "p array<string>")
        return df.select(sg.design_section(F.col("p")).alias("s")).first().s

    assert section(["a", "研究设计与结果分析", "b", "数据分析", "c"]) == "研究设计与结果分析\nb"
    assert section(["a", "数据来源", "b"]) == "数据来源\nb" and section(["a"]) == ""


def test_chunk_papers_offsets_and_ids(spark):
    docs = spark.createDataFrame(
        [("p", ["题名", "1 研究背景", "字" * 400, "字" * 400, "2 研究方法", "字" * 50]), ("empty", [])],
        "paper_id string, paras array<string>")
    rows = sorted(pk.chunk_papers(docs, "greedy").collect(), key=lambda r: r.chunk_index)
    assert [(r.chunk_id, r.offset_start, len(r.chunk_text), r.chapter_index) for r in rows] == [
        ("p::0", 0, 2, 0), ("p::1", 2, 400, 1), ("p::2", 402, 400, 1), ("p::3", 802, 50, 2)]
    with pytest.raises(ValueError):
        pk.chunk_papers(docs, "other")


def test_chapter_role_computes_a_title_once(spark):
    rows = spark.createDataFrame([
        (" 研究方法 ", 0, 5), ("前置内容", 3, 5), ("方法与参考文献", 2, 5), ("plain", 0, 5), ("plain", 2, 5), ("plain", 4, 5),
        ("一般", 2, 5), (None, 2, 5), ("", 4, 5), ("结果", 0, 0)], "title string, pos int, total int")
    role, confidence = sg.chapter_role(strip("title"), F.col("pos"), F.col("total"))
    out = rows.select(role.alias("role"), confidence.alias("confidence"))
    # once for each of the two columns, not for every word
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2
    assert [tuple(r) for r in out.collect()] == [
        ("方法依据", "high"), ("背景说明", "medium"), ("其他", "high"), ("背景说明", "medium"), ("概念解释", "low"),
        ("研究空白", "medium"), ("概念解释", "low"), ("概念解释", "low"), ("研究空白", "medium"), ("经验证据", "high")]
