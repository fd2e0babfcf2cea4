"""Evidence tables for generation: selection, packing, citations, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules
from ..functions.text import cut, split_keywords, strip
from ..functions.vectors import cosine
from ..scale import SCORE_DIGITS, top_k
from .ranking import matched_by

FULL, PART = 5, 3
CLIFF = 0.5


def select_evidence(golden: DataFrame) -> DataFrame:
    """Top 5 papers, or 3 and insufficient when there are few hits or a cliff.

    Only ranks 1 to 5 decide, so longer lists are cut before the shuffle.
    """
    # five rows per query at most
    whole = Window.partitionBy("query_id")
    at = {r: F.max(F.when(F.col("rank") == r, F.col("score"))).over(whole) for r in (2, 3)}
    enough = (F.count(F.lit(1)).over(whole) >= FULL) & ~(at[3] < at[2] * CLIFF)
    head = golden.filter(F.col("rank") <= FULL).withColumn("evidence_sufficient", enough)
    return head.filter(F.col("evidence_sufficient") | (F.col("rank") <= PART))


def pack_evidence(selected: DataFrame, papers: DataFrame, chunks: DataFrame, query_vecs: DataFrame,
                  per_paper: int = 3, top_papers: int = 0) -> DataFrame:
    """Best chunks of every selected paper, with global reference numbers.

    One row per query and paper: display columns, top chunk, score and
    chunks array<struct<ref_id, chunk_id, chunk_index, text, section_role,
    chapter_title, score>>, which is empty when per_paper is 1.  Without a query
    vector the longest chunks (in bytes) are taken.
    """
    per_paper = max(per_paper, 1)
    if top_papers > 0:
        selected = selected.filter(F.col("rank") <= top_papers)
    asked = selected.join(query_vecs.select("query_id", "q_vec"), "query_id", "left")
    title = F.col("chapter_title") if "chapter_title" in chunks.columns else F.lit("")
    usable = chunks.filter(F.coalesce("section_role", F.lit("")) != rules.ROLE_OTHER).select(
        "paper_id", "chunk_id", "chunk_index", "chunk_text", "section_role", title.alias("chapter_title"),
        "embedding")
    vector = F.coalesce(F.size("q_vec"), F.lit(0)) > 0
    # left join: a paper without a usable chunk keeps its row
    scored = asked.join(usable, "paper_id", "left").withColumn(
        "_score", F.when(vector, cosine("embedding", "q_vec")).otherwise(F.lit(0.0)))
    weight = F.when(vector, F.round("_score", SCORE_DIGITS)).otherwise(
        F.octet_length(F.coalesce("chunk_text", F.lit(""))).cast("double"))
    order = [F.col("_weight").desc(), F.col("chunk_index"), F.col("chunk_id")]
    taken = top_k(scored.withColumn("_weight", weight).drop("embedding", "q_vec"), ["query_id", "paper_id"], order,
                  per_paper, ["chunk_id"], "_n")
    # at most a handful of papers times per_paper rows per query from here on
    running = Window.partitionBy("query_id").orderBy("rank", "paper_id", "_n").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    numbered = taken.withColumn("ref_id", F.count("chunk_id").over(running).cast("int"))
    entry = F.struct(
        "ref_id", "chunk_id", "chunk_index", F.coalesce("chunk_text", F.lit("")).alias("text"),
        F.coalesce("section_role", F.lit("")).alias("section_role"),
        F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), F.col("_score").alias("score"))
    best = F.col("_n") == 1
    carried = [c for c in selected.columns if c not in ("query_id", "paper_id")]
    grouped = numbered.groupBy("query_id", "paper_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), entry))).alias("chunks"),
        F.coalesce(F.max(F.when(best, F.col("chunk_text"))), F.lit("")).alias("top_chunk_text"),
        F.coalesce(F.max(F.when(best & F.col("chunk_id").isNotNull(), F.col("_score"))), F.lit(0.0)).alias(
            "relevance_score"),
        *[F.first(c).alias(c) for c in carried])
    if per_paper < 2:
        grouped = grouped.withColumn("chunks", F.slice("chunks", 1, 0))
    text = ["title", "doi", "author", "keywords", "abstract", "research_design_text"]
    shown = papers.select(
        "paper_id", *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        F.coalesce("source_journal", F.lit("")).alias("journal"),
        F.coalesce("publish_year", F.lit(0)).alias("publish_year"))
    return grouped.join(shown, "paper_id")


def pasted_evidence(requests: DataFrame) -> DataFrame:
    """User text as the only evidence: requests(query_id, title, author, doi, publish_year, text)."""
    text = strip("text")
    title = F.coalesce(F.nullif(strip(F.coalesce("title", F.lit(""))), F.lit("")), F.lit("用户提供文本"))
    return requests.filter(text != "").select(
        "query_id", F.lit("").alias("paper_id"), F.lit(1).alias("rank"), title.alias("title"),
        strip(F.coalesce("author", F.lit(""))).alias("author"), strip(F.coalesce("doi", F.lit(""))).alias("doi"),
        F.lit("").alias("keywords"), F.lit("").alias("journal"), F.coalesce("publish_year", F.lit(0)).alias(
            "publish_year"),
        text.alias("abstract"), text.alias("research_design_text"), text.alias("top_chunk_text"),
        F.lit(0.0).alias("relevance_score"))


def chunk_citations(evidence: DataFrame) -> DataFrame:
    flat = evidence.select(
        "query_id", "paper_id", "title", "author", F.col("publish_year").alias("year"), "journal", "doi",
        F.explode("chunks").alias("c"))
    return flat.select(
        "query_id", "c.ref_id", "c.chunk_id", "c.chunk_index", "paper_id", "title", "author", "year", "journal",
        "doi", "c.chapter_title", "c.section_role", "c.text")


def paper_citations(evidence: DataFrame) -> DataFrame:
    return evidence.select("query_id", "paper_id", "title", "author", "keywords", "abstract", "doi",
                           "publish_year", "relevance_score", "top_chunk_text")


def qa_references(evidence: DataFrame, selected: DataFrame, keyword_hits: DataFrame,
                  vector_hits: DataFrame) -> DataFrame:
    """Reference list of an answer: rank, paper, how it was found, score, snippet."""
    order = Window.partitionBy("query_id").orderBy("rank")
    listed = evidence.select(
        "query_id", "paper_id", "title", "author", F.col("publish_year").alias("year"), "doi", "journal",
        F.col("top_chunk_text").alias("snippet"), F.row_number().over(order).alias("rank"))
    scores = selected.select("query_id", "paper_id", "score")
    return matched_by(listed.join(scores, ["query_id", "paper_id"]), keyword_hits, vector_hits)


def question_terms(question: Column) -> Column:
    return F.filter(split_keywords(question), lambda t: F.length(t) >= 2)


def pick_snippets(requests: DataFrame, papers: DataFrame, body: str = "raw_body", n: int = 3,
                  limit: int = 300) -> DataFrame:
    """First n paragraphs holding a question term: requests(query_id, paper_id, question).

    Paragraphs are searched inside the paper row; the join is on paper_id.
    """
    asked = requests.select("query_id", "paper_id", question_terms(F.coalesce("question", F.lit(""))).alias("_terms"))
    joined = asked.join(papers.select("paper_id", F.coalesce(body, F.lit("")).alias("_body")), "paper_id")
    paras = F.filter(F.transform(F.split(strip("_body"), "\n"), strip), lambda p: p != "")
    hits = F.filter(paras, lambda p: F.exists("_terms", lambda t: p.contains(t)))
    found = joined.withColumn("_hits", F.slice(hits, 1, n))
    rows = found.select("query_id", "paper_id", F.posexplode("_hits").alias("pos", "para"))
    return rows.select("query_id", "paper_id", (F.col("pos") + 1).alias("snippet_no"),
                       cut(F.col("para"), limit).alias("snippet"))
