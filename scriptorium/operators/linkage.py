"""Record linkage between documents and metadata rows, and column backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_key, strip
from ..scale import cut_lineage
from .containment import contained

def match_metadata(docs: DataFrame, rows: DataFrame, id_column: str = "paper_id", hint_column: str = "title_hint",
                   order_column: str = "row_no", title_column: str = "title") -> DataFrame:
    """(paper_id, row_no, stage) for every document; NULL when nothing fits.

    1 clean hint equals a clean title, first row wins; 2 clean id equals a clean
    title, last row wins; 3 the first row, in file order, whose clean title
    contains the clean id or is contained in it.
    """
    titles = (
        rows.select(clean_key(title_column).alias("key"), F.col(order_column).alias("row_no"))
        .filter(F.col("key") != "")
        .groupBy("key").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))
    )
    titles = cut_lineage(titles)
    keyed = docs.select(
        F.col(id_column).alias("paper_id"), clean_key(id_column).alias("id_key"),
        clean_key(hint_column).alias("hint_key"))
    by_hint = titles.select(F.col("key").alias("hint_key"), F.col("first_row").alias("_hint"))
    by_id = titles.select(F.col("key").alias("id_key"), F.col("last_row").alias("_id"))
    # keys only, no texts: stored once for the branches below
    exact = cut_lineage(keyed.join(by_hint, "hint_key", "left").join(by_id, "id_key", "left"))
    # distinct keys: copies of one document are linked once
    open_keys = exact.filter(
        F.col("_hint").isNull() & F.col("_id").isNull() & (F.col("id_key") != "")).select("id_key").distinct()
    title_keys = titles.select("key")
    one = F.lit("key").alias("field")
    inside_title = contained(open_keys.select(one, F.col("id_key").alias("needle")), title_keys.select(one, F.col("key").alias("hay")))
    holds_title = contained(title_keys.select(one, F.col("key").alias("needle")), open_keys.select(one, F.col("id_key").alias("hay")))
    pairs = (
        inside_title.select(F.col("needle").alias("id_key"), F.col("hay").alias("key"))
        .unionByName(holds_title.select(F.col("hay").alias("id_key"), F.col("needle").alias("key"))))
    loose = (pairs.join(titles.select("key", "first_row"), "key")
             .groupBy("id_key").agg(F.min("first_row").alias("_loose")))
    joined = exact.join(loose, "id_key", "left")
    stage = (
        F.when(F.col("_hint").isNotNull(), 1).when(F.col("_id").isNotNull(), 2).when(F.col("_loose").isNotNull(), 3))
    return joined.select(
        "paper_id", F.coalesce("_hint", "_id", "_loose").alias("row_no"), stage.alias("stage"))


def backfill_column(base: DataFrame, meta: DataFrame, links: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Fill `column` of base from the linked metadata row where that is not blank.

    Returns the new table and a one-row report(total, matched, filled, have).
    """
    given = meta.select("row_no", strip(F.col(column)).alias("_new"))
    linked = links.select("paper_id", "row_no").filter(F.col("row_no").isNotNull())
    joined = base.join(linked, "paper_id", "left").join(given, "row_no", "left")
    usable = F.coalesce(F.col("_new"), F.lit("")) != ""
    updated = joined.withColumn(column, F.when(usable, F.col("_new")).otherwise(F.col(column)))
    report = updated.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("row_no").isNotNull()).alias("matched"),
        F.count_if(usable).alias("filled"),
        F.count_if(F.coalesce(F.col(column), F.lit("")) != "").alias("have"),
    )
    return updated.select(*base.columns), report


__all__ = ["match_metadata", "backfill_column"]
