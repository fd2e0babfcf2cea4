"""Table maintenance: upsert, child replacement, history, paper detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import top_k

HISTORY_LIMIT = 20
HISTORY_MAX = 200


def latest(updates: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The last writer per key, ties by the rows' content; the limit of one row applies before the shuffle."""
    order = [F.col(order_col).desc(), F.xxhash64(*updates.columns).asc()]
    first = top_k(updates, keys, order, 1, [order_col], "_rank")
    return first.drop("_rank")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """Insert or replace whole rows by key; new columns are added, never dropped.

    Without `order_col` the keys of the updates must be unique.
    """
    if order_col is None and not updates.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"several updates of one {', '.join(keys)}: name the column that orders them")
    fresh = latest(updates, keys, order_col).drop(order_col) if order_col else updates
    kept = base.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_papers(base: DataFrame, updates: DataFrame, order_col: str | None = None) -> DataFrame:
    return upsert(base, updates, ["paper_id"], order_col)


def replace_children(base: DataFrame, updates: DataFrame, parents: DataFrame | None = None,
                     parent_key: str = "paper_id") -> DataFrame:
    """Drop all children of the re-ingested parents, then add the new ones.

    `parents` lists re-ingested parents, including those that now have no
    children; by default the parents seen in `updates`.
    """
    touched = (updates if parents is None else parents).select(parent_key).distinct()
    return base.join(touched, parent_key, "left_anti").unionByName(updates, allowMissingColumns=True)


def replace_chunks(base: DataFrame, updates: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    return replace_children(base, updates, parents, "paper_id")


def history_rows(events: DataFrame) -> DataFrame:
    """(id, mode, query, filters, created_at) ready to append."""
    return events.select("id", "mode", "query", "filters", "created_at")


def append_history(entries: DataFrame, path: str) -> None:
    """Append log entries; the time is set here when the entry has none."""
    if "created_at" not in entries.columns:
        entries = entries.withColumn("created_at", F.current_timestamp())
    history_rows(entries).write.mode("append").parquet(path)


def recent_history(history: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest entries first; a limit outside 1-200 means 20."""
    limit = limit if 1 <= limit <= HISTORY_MAX else HISTORY_LIMIT
    return history.orderBy(F.col("id").desc()).limit(limit)


DETAIL_TEXT = ("title", "doi", "author", "keywords", "abstract", "source_journal", "affiliation", "core_type",
               "clc_number", "research_design_text", "raw_body")


def paper_detail(papers: DataFrame, chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested papers, NULLs replaced, with their chunks in reading order."""
    wanted = ids.select("paper_id").distinct()
    entry = F.struct(
        F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), "chunk_id",
        F.coalesce("chunk_text", F.lit("")).alias("chunk_text"),
        F.coalesce("section_role", F.lit("")).alias("section_role"))
    gathered = chunks.join(wanted, "paper_id", "left_semi").groupBy("paper_id").agg(
        F.array_sort(F.collect_list(entry)).alias("chunks"))
    shown = papers.join(wanted, "paper_id", "left_semi").select(
        "paper_id", *[F.coalesce(c, F.lit("")).alias(c) for c in DETAIL_TEXT],
        F.coalesce("publish_year", F.lit(0)).alias("publish_year"), F.coalesce("is_core", F.lit(0)).alias("is_core"))
    return shown.join(gathered, "paper_id", "left")
