"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import history_rows, latest


FINISHED = "number bigint, run string, batch bigint"


class BatchTables:
    """papers and chunks: one Parquet folder for each ingested batch, and a table that lists the finished batches.

    Batches are numbered on over all runs, so a new or reset checkpoint, which numbers its batches from 0
    again, loses nothing.  Readers take finished batches only: the newest row of a paper counts, and of
    its chunks those written with that row, so a paper that shrinks loses its old chunks.  A batch
    that fails is not listed and changes nothing; its folder is overwritten by the next one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], FINISHED).write.mode("ignore").parquet(f"{path}/finished")

    def finished(self) -> DataFrame:
        return self.spark.read.schema(FINISHED).parquet(f"{self.path}/finished")

    def finish(self, number: int, run: str, batch: int) -> None:
        """List a batch: one row in one file, which appears whole or not at all."""
        row = self.spark.createDataFrame([(number, run, batch)], FINISHED)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/finished")

    def write(self, table: str, df: DataFrame, number: int) -> DataFrame:
        folder = f"{self.path}/{table}/number={number}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    def read(self, table: str) -> DataFrame | None:
        """Current rows of papers or chunks; None before the first batch."""
        finished = self.finished().select("number")
        if finished.isEmpty():
            return None

        def rows(name: str) -> DataFrame:
            stored = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}")
            return stored.withColumn("number", F.col("number").cast("bigint")).join(finished, "number", "left_semi")

        # reads paper_id and the partition value only
        newest = rows("papers").groupBy("paper_id").agg(F.max("number").alias("number"))
        return rows(table).join(newest, ["paper_id", "number"], "left_semi").drop("number")


def apply_batch(tables: BatchTables, papers: DataFrame, to_chunks: Callable[[DataFrame], DataFrame],
                run: str, batch: int) -> None:
    """Write changed papers and their chunks as one batch and list it as finished.

    Only a batch that this run has finished before is skipped.  Chunks are made
    from the papers as written, so both tables hold the same rows.
    """
    mine = (F.col("run") == run) & (F.col("batch") == batch)
    last, done = tables.finished().agg(F.max("number"), F.coalesce(F.bool_or(mine), F.lit(False))).first()
    if done:
        return
    number = 0 if last is None else last + 1
    written = tables.write("papers", papers, number)
    tables.write("chunks", to_chunks(written), number)
    tables.finish(number, run, batch)


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """Id of the run that a checkpoint folder belongs to."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def stream_upsert(stream: DataFrame, tables: BatchTables, to_chunks: Callable[[DataFrame], DataFrame],
                  checkpoint: str, order_col: str | None = None, **trigger) -> StreamingQuery:
    """Run a stream of paper rows into `tables`; `to_chunks` makes their chunks.

    Several rows of one paper in a batch are settled by `order_col`, ties by
    the rows' content.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch, ["paper_id"], order_col).drop(order_col) if order_col else batch
        apply_batch(tables, rows, to_chunks, _run_of(tables.spark, checkpoint), batch_id)

    trigger = trigger or {"availableNow": True}
    return (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def stream_history(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of log entries to the history table."""
    rows = history_rows(stream) if "created_at" in stream.columns else history_rows(
        stream.withColumn("created_at", F.current_timestamp()))
    trigger = trigger or {"availableNow": True}
    return (rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**trigger).start())
