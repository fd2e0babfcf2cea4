"""Prompt-context strings assembled from evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import blank_to_null, cut, strip


def _or(c: str, other: Column | str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(other) if isinstance(other, str) else other)


def _doi() -> Column:
    return _or("doi", F.concat(F.lit("PaperID:"), F.coalesce("paper_id", F.lit(""))))


def _title() -> Column:
    return _or("title", F.coalesce(F.col("paper_id"), F.lit("")))


def _year() -> Column:
    return F.coalesce(F.col("publish_year").cast("string"), F.lit(rules.UNKNOWN_YEAR))


def _joined(rows: DataFrame, order: list[str]) -> DataFrame:
    """One string per query from a few evidence blocks, in order."""
    blocks = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*order, "block"))).alias("b"))
    return blocks.select("query_id", F.array_join(F.col("b.block"), "\n\n").alias("context"))


def review_contexts(evidence: DataFrame) -> DataFrame:
    """Review context: one block per paper, numbered by position."""
    block = F.concat(
        F.lit("【核心文献 "), F.col("rank").cast("string"), F.lit("】\n标题: "), _title(), F.lit(" | DOI: "), _doi(),
        F.lit(" | 发表年份: "), _year(), F.lit("\n作者: "), _or("author", rules.NOT_PROVIDED),
        F.lit("\n关键词: "), _or("keywords", rules.NOT_PROVIDED), F.lit("\n摘要: "),
        _or("abstract", rules.NOT_PROVIDED), F.lit("\n相关语义片段: "), _or("top_chunk_text", rules.NOT_PROVIDED),
        F.lit("\n独立研究设计原文: "), _or("research_design_text", rules.NOT_PROVIDED), F.lit("\n"))
    return _joined(evidence.withColumn("block", block), ["rank"])


def qa_contexts(evidence: DataFrame, design_limit: int = 800) -> DataFrame:
    """Answer context: one block per numbered chunk; per paper where a query has none.

    Designs are cut at `design_limit` characters, 0 keeps them whole.
    """
    head = F.concat(_title(), F.lit("|"), _doi(), F.lit("|"), _year())
    flat = evidence.select("query_id", head.alias("head"), F.explode("chunks").alias("c"))
    fine = flat.select("query_id", F.col("c.ref_id").alias("n"), F.concat(
        F.lit("【证据"), F.col("c.ref_id").cast("string"), F.lit("】（段落作用: "),
        F.coalesce(F.nullif(F.col("c.section_role"), F.lit("")), F.lit(rules.UNLABELLED_ROLE)), F.lit(" | 章节: "),
        F.coalesce(F.nullif(F.col("c.chapter_title"), F.lit("")), F.lit(rules.UNKNOWN_CHAPTER)), F.lit("）"),
        F.col("head"), F.lit("\n"), strip(F.col("c.text"))).alias("block"))
    bare = evidence.join(fine.select("query_id").distinct(), "query_id", "left_anti")
    design = _or_cut("research_design_text", design_limit)
    coarse = bare.select("query_id", F.col("rank").alias("n"), F.concat(
        F.lit("【证据"), F.col("rank").cast("string"), F.lit("】"), head, F.lit("\n摘要片段: "),
        _or("top_chunk_text", rules.NOT_PROVIDED), F.lit("\n研究设计: "), design).alias("block"))
    return _joined(fine.unionByName(coarse), ["n"])


def _or_cut(c: str, limit: int) -> Column:
    return F.coalesce(F.nullif(_limited(strip(F.coalesce(c, F.lit(""))), limit), F.lit("")), F.lit(rules.NOT_PROVIDED))


def _limited(text: Column, limit: int) -> Column:
    return cut(text, limit) if limit > 0 else text


def paper_contexts(papers: DataFrame, task: str = "summary", question: Column | None = None,
                   body_limit: int | None = None) -> DataFrame:
    """Context of a single paper: header, design (chat only), body.

    The body is cut at `body_limit` characters: 6000 for a summary and 8000 for a
    chat unless given, 0 keeps it whole.
    """
    if body_limit is None:
        body_limit = 6000 if task == "summary" else 8000
    header = F.concat(
        F.lit("标题: "), _title(), F.lit("\n作者: "), _or("author", rules.NOT_PROVIDED), F.lit("\nDOI: "),
        _or("doi", rules.NOT_PROVIDED), F.lit(" | 期刊: "), _or("source_journal", rules.NOT_PROVIDED),
        F.lit(" | 年份: "), _year(), F.lit("\n关键词: "), _or("keywords", rules.NOT_PROVIDED),
        F.lit("\n摘要: "), _or("abstract", rules.NOT_PROVIDED))
    full = strip(F.coalesce("raw_body", F.lit("")))
    if task == "summary":
        body = F.coalesce(F.nullif(_limited(full, body_limit), F.lit("")), blank_to_null("abstract"), F.lit(rules.NO_FULL_TEXT))
        text = F.concat(header, F.lit("\n\n论文全文：\n"), body)
    else:
        body = F.coalesce(F.nullif(_limited(full, body_limit), F.lit("")), F.lit(rules.NO_FULL_TEXT))
        text = F.concat(header, F.lit("\n\n研究设计原文: "), _or("research_design_text", rules.NOT_PROVIDED),
                        F.lit("\n\n论文全文：\n"), body)
        if question is not None:
            text = F.concat(text, F.lit("\n\n用户问题："), question)
    return papers.select("paper_id", text.alias("context"))
