import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.payload import list_at, parse_object, text_at, year_at
from scriptorium.functions.vectors import add_hashed_vectors, cosine
from scriptorium.operators import segmentation as sg
from scriptorium.operators.generations import strip_preamble


def one(spark, value, column, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, tokens", [
    ("Deep学习ABC，图像分类 x1 々〇 Ünder",
     "deep 学 学习 习 abc 图 图像 像 像分 分 分类 类 x1 々 々〇 〇 nder"),
    ("Ärger K1-b_2 ＡＢ", "rger k1 b 2"),
    ("", ""), (None, ""), ("，。", ""),
])
def test_tokenize(spark, text, tokens):
    assert one(spark, text, tx.tokenize("v")) == tokens.split()


def test_strip_removes_all_unicode_space(spark):
    assert one(spark, "　  \tbare text\t 　", tx.strip("v")) == "bare text"


@pytest.mark.parametrize("fn, text, expected", [
    (tx.split_multi, " a，b;;c、 d/e|f ", ["a", "b", "c", "d", "e", "f"]),
    (tx.split_multi, None, []),
    (tx.split_authors, "张三；李四,王 赵六、A", ["张三", "李四", "赵六"]),
    (tx.split_keywords, "a b，a;c", ["a", "b", "c"]),
    (tx.clean_key, "  A_b·（C）— d? ", "abcd"),
    (tx.extract_year, "刊,2021,46", 2021), (tx.extract_year, "1850", None),
    (tx.to_int_year, " 2020 ", 2020), (tx.to_int_year, "年1999版", 1999), (tx.to_int_year, "12", 12),
    (tx.to_int_year, "", None),
    (tx.extract_journal, " 计算机学报,2024", "计算机学报"), (tx.extract_journal, "软件 学报", "软件"),
    (tx.derive_is_core, "CSSCI;x", 1), (tx.derive_is_core, "cssci", 0), (tx.derive_is_core, None, 0),
    (tx.derive_paper_id, "/a/b/__name.v2_.docx", "name.v2"),
    (tx.clc_code, "TP391(计算)", "TP391"), (tx.clc_code, "（x）y", "（x）y"),
    (tx.abstract_preview, "字" * 201, "字" * 200 + "..."), (tx.abstract_preview, "字" * 200, "字" * 200),
])
def test_scalars(spark, fn, text, expected):
    assert one(spark, text, fn("v")) == expected


@pytest.mark.parametrize("text, expected", [
    ("第三章 方法", ("di", 3)), ("第二十一部分", ("di", 21)), ("十一、结果", ("cn", 11)), ("2 数据", ("ar", 2)),
    ("百、其他", None), ("第2024章", ("di", 2024)), ("1.1 小节", None), ("结论", None), ("二十、x", ("cn", 20)),
])
def test_heading_ordinal(spark, text, expected):
    found = one(spark, text, sg.heading_ordinal(F.col("v")))
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize("text, expected", [
    ("引言", True), ("1 研究背景", True), ("1.1 研究背景", False), ("2 0 2 5 年 6 期", False), ("（一）背景", False),
    ("一、数据。", False), ("结论与展望以及很长补充说明", True), ("结论" + "字" * 9, False), ("第五章", True), ("", False),
])
def test_is_heading(spark, text, expected):
    assert one(spark, text, sg.is_heading(F.col("v"))) is expected


def test_split_sentences(spark):
    text = "a。b!c. d 3.5x; e"
    assert one(spark, text, sg.split_sentences(F.col("v"))) == ["a。", "b!", "c.", "d 3.5x;", "e"]


def test_join_fragments(spark):
    paras = ["前半", " 后半。 ", "", "下一"]
    assert one(spark, paras, sg.join_fragments(F.col("v")), "v array<string>") == "前半后半。\n下一"


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([], []), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r.x for r in df.select(cosine("a", "b").alias("x")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_hashed_vectors_are_unit_or_null(spark):
    df = spark.createDataFrame([(1, "deep learning deep"), (2, "，"), (3, None)], "id int, t string")
    rows = {r.id: r.v for r in add_hashed_vectors(df, "t", "v").collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-12 and len(rows[1]) == 64
    assert rows[2] is None and rows[3] is None


def test_payload_shapes(spark):
    raw = '```json\n{"a": ["x", " ", 3], "b": "y", "c": 7, "d": null, "year": "in 2011", "n": 2012.0}\n```'
    doc = parse_object(F.col("v"))
    columns = [list_at(doc, "a"), list_at(doc, "b"), list_at(doc, "c"), list_at(doc, "d"), text_at(doc, "b"),
               year_at(doc, "year"), year_at(doc, "n"), year_at(doc, "a")]
    row = spark.createDataFrame([(raw,)], "v string").select(*columns).first()
    assert list(row) == [["x", "3"], ["y"], [], [], "y", 2011, 2012, None]


def test_strip_preamble(spark):
    assert one(spark, "好的，开始\n\n正文", strip_preamble(F.col("v"))) == "正文"
    assert one(spark, "好的", strip_preamble(F.col("v"))) == "好的"
    assert one(spark, "好的" + "字" * 50 + "\n正文", strip_preamble(F.col("v"))).startswith("好的")
