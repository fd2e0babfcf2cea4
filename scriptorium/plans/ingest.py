"""From documents and metadata rows to the papers table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import derive_is_core, strip, to_int_year
from ..operators.linkage import match_metadata
from ..operators.segmentation import design_section
from ..sources.index import with_tokens


def build_papers(docs: DataFrame, metadata: DataFrame, tokens: bool = True) -> DataFrame:
    """docs(paper_id, title_hint, paras) and metadata(row_no, ...) -> papers.

    Documents without a metadata row keep their id as the title.
    """
    links = match_metadata(docs, metadata).select("paper_id", "row_no")

    def given(column):
        return strip(F.coalesce(F.col(column).cast("string"), F.lit("")))

    fields = metadata.select(
        "row_no", given("title").alias("title"), given("author").alias("author"),
        given("keywords").alias("keywords"), given("abstract").alias("abstract"), given("doi").alias("doi"),
        given("source_journal").alias("source_journal"), given("affiliation").alias("affiliation"),
        given("db_class").alias("core_type"), given("subject_code").alias("clc_number"),
        to_int_year("publish_year").alias("publish_year"))
    texts = docs.select(
        "paper_id", design_section(F.col("paras")).alias("research_design_text"),
        F.array_join("paras", "\n\n").alias("raw_body"))
    joined = texts.join(links, "paper_id", "left").join(fields, "row_no", "left")

    def text(c):
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    papers = joined.select(
        "paper_id", F.coalesce(F.nullif("title", F.lit("")), F.col("paper_id")).alias("title"), text("doi"),
        "publish_year", text("author"), text("keywords"), text("abstract"), text("source_journal"),
        text("affiliation"), text("core_type"), derive_is_core("core_type").alias("is_core"), text("clc_number"),
        text("research_design_text"), text("raw_body"))
    return with_tokens(papers) if tokens else papers
