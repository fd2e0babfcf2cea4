"""Cleaning and checking of text produced by a generator."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.payload import kind_at, list_at, parse_object, strip_codefence, text_at
from ..functions.text import SPACE, let, split_keywords, strip


def strip_preamble(c: Column) -> Column:
    """Drop a short first line that starts like small talk when text follows."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), rf"^[{SPACE}]+", "")
    first = F.regexp_extract(text, r"^([^\n]*)", 1)
    rest = F.regexp_replace(F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1), rf"^[{SPACE}]+", "")
    small_talk = reduce(or_, [first.startswith(m) for m in rules.PREAMBLE_MARKERS])
    drop = (F.length(first) <= rules.PREAMBLE_MAX_CHARS) & small_talk & (rest != "")
    return F.when(drop, rest).otherwise(text)


def load_generations(outputs: DataFrame, papers: DataFrame) -> DataFrame:
    """outputs(gen_id, paper_id, task, raw) -> clean typed rows.

    Task `summary` is parsed into summary, method, result and keywords, falling
    back per field to the paper; every other task gives its text only.
    """
    shown = papers.select("paper_id", strip(F.coalesce("abstract", F.lit(""))).alias("_abstract"),
                          split_keywords(F.coalesce("keywords", F.lit(""))).alias("_keywords"))
    joined = outputs.join(shown, "paper_id", "left")
    is_summary = F.col("task") == "summary"
    staged = joined.withColumn("_doc", F.when(is_summary, parse_object(F.col("raw"))))
    doc = F.col("_doc")

    def field(name, fallback):
        return strip(F.coalesce(F.nullif(text_at(doc, name), F.lit("")), fallback))

    words = F.when(kind_at(doc, "keywords") == "STRING", split_keywords(text_at(doc, "keywords"))).otherwise(
        list_at(doc, "keywords"))
    own = F.coalesce("_keywords", F.array().cast("array<string>"))
    return staged.select(
        "gen_id", "paper_id", "task",
        F.when(~is_summary, strip_preamble(strip_codefence(F.col("raw")))).alias("text"),
        F.when(is_summary, field("summary", F.coalesce("_abstract", F.lit("")))).alias("summary"),
        F.when(is_summary, field("method", F.lit(""))).alias("method"),
        F.when(is_summary, field("result", F.lit(""))).alias("result"),
        F.when(is_summary, F.when(doc.isNotNull() & (F.size(words) > 0), words).otherwise(own)).alias("keywords"))


_HEADING = rf"(?m)^##[{SPACE}]*({'|'.join(rules.ANSWER_ROLES)})[：:{SPACE}]*$"


def answer_sections(answers: DataFrame) -> DataFrame:
    """answers(query_id, text) -> (query_id, section_no, role, body); text before
    the first heading is the preamble with number 0."""
    mark = "\x02"
    flagged = F.regexp_replace(F.coalesce("text", F.lit("")), _HEADING, f"{mark}$1{mark}")

    def sections(parts):
        # parts alternate: text, role, text, role, text ...
        count = ((F.size(parts) + 1) / 2).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
            i.alias("section_no"),
            F.when(i == 0, F.lit("preamble")).otherwise(F.get(parts, i * 2 - 1)).alias("role"),
            F.when(count == 1, F.get(parts, i * 2)).otherwise(strip(F.get(parts, i * 2))).alias("body")))

    rows = answers.select("query_id", F.explode(let(F.split(flagged, mark), sections)).alias("s"))
    return rows.select("query_id", "s.section_no", "s.role", "s.body")


def citation_marks(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Every [n] of every section, with the cited chunk; unknown numbers flagged."""
    found = answer_sections(answers).select(
        "query_id", "section_no", "role",
        F.explode(F.regexp_extract_all("body", F.lit(r"\[([0-9]{1,3})\]"), F.lit(1))).alias("_n"))
    marks = found.groupBy("query_id", "section_no", "role", F.col("_n").cast("int").alias("ref_id")).agg(
        F.count(F.lit(1)).alias("uses"))
    known = citations.select("query_id", "ref_id", "paper_id", "chunk_id")
    return marks.join(known, ["query_id", "ref_id"], "left").withColumn("known", F.col("chunk_id").isNotNull())


def citation_audit(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Per answer: sections present, citations used, unknown numbers, papers cited."""
    sections = answer_sections(answers).groupBy("query_id").agg(
        F.countDistinct(F.when(F.col("section_no") > 0, F.col("role"))).alias("sections"))
    marks = citation_marks(answers, citations).groupBy("query_id").agg(
        F.sum("uses").alias("marks"),
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("uses"))), F.lit(0)).alias("unknown"),
        F.countDistinct("paper_id").alias("papers"))
    joined = sections.join(marks, "query_id", "left")
    return joined.select("query_id", "sections", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("marks", "unknown", "papers")])
