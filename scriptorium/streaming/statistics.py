"""Statistics of the index kept up to date by a stream of changed papers.

A batch writes two folders of its own.  The first holds what each of its papers adds to the
statistics: the distinct terms and the length of each field.  The second holds the
changes by field and term: what the batch's papers add now, less what their newest entries of
earlier batches added.  Readers sum the changes.  A repeated batch reads earlier batches only and
overwrites its own folders, so a batch that fails changes nothing and a repeated one counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules
from ..sources.index import TOKEN_COLUMNS, with_tokens

PAPERS = "paper_id string, fields array<struct<field: string, dl: int, terms: array<string>>>"
# a row with a term counts the papers that hold it, one without counts papers and tokens of the field
CHANGES = "field string, term string, papers bigint, tokens bigint"


def _signed(papers: DataFrame, sign: int) -> DataFrame:
    """What papers add to the statistics, times sign: a row for every field and one for every term of it."""
    fields = papers.select(F.explode("fields").alias("f"))
    rows = fields.select("f.field", "f.dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), "f.terms")).alias("term"))
    tokens = F.when(F.col("term").isNull(), F.col("dl")).otherwise(F.lit(0)) * sign
    return rows.select("field", "term", F.lit(sign).cast("bigint").alias("papers"), tokens.cast("bigint").alias("tokens"))


class StreamedStatistics:
    """Document frequencies, lengths and number of papers below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # both folders can be read before the first batch
        for folder, schema in (("papers", PAPERS), ("changes", CHANGES)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{folder}/batch=-1")

    def stream_changes(self, stream: DataFrame, order_col: str | None = None, **trigger) -> StreamingQuery:
        """Changes that a stream of whole paper rows makes.

        A later batch replaces an earlier one; several rows of one paper in a batch are settled by
        `order_col`, ties by the rows' content, as in `stream_upsert`.
        """
        order = F.col(order_col).cast("double") if order_col else F.lit(0.0)
        place = F.struct(F.coalesce(order, F.lit(float("-inf"))), F.bitwise_not(F.xxhash64(*stream.columns)))
        fields = F.array(*[
            F.struct(F.lit(f).alias("field"), F.size(F.col(c)).alias("dl"), F.array_distinct(F.col(c)).alias("terms"))
            for f, c in TOKEN_COLUMNS.items()])

        def on_batch(rows: DataFrame, batch: int) -> None:
            newest = rows.groupBy("paper_id").agg(F.max_by(F.struct(*rows.columns), place).alias("row")).select("row.*")
            (with_tokens(newest).select("paper_id", fields.alias("fields"))
             .write.mode("overwrite").parquet(f"{self.path}/papers/batch={batch}"))
            stored = self._read("papers", PAPERS)
            now, earlier = stored.filter(F.col("batch") == batch), stored.filter(F.col("batch") < batch)
            # rows without an id are one paper
            same = F.col("paper_id").eqNullSafe(F.col("_id"))
            last = (earlier.select("paper_id", "batch").join(now.select(F.col("paper_id").alias("_id")), same, "left_semi")
                    .groupBy(F.col("paper_id").alias("_id")).agg(F.max("batch").alias("_batch")))
            replaced = earlier.join(last, same & (F.col("batch") == F.col("_batch")))
            both = _signed(now, 1).unionByName(_signed(replaced, -1))
            changes = both.groupBy("field", "term").agg(F.sum("papers").alias("papers"), F.sum("tokens").alias("tokens"))
            (changes.filter("papers <> 0 or tokens <> 0")
             .write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}"))

        return (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{self.path}/state")
                .trigger(**(trigger or {"availableNow": True})).start())

    def update(self, stream: DataFrame, order_col: str | None = None) -> None:
        """Take in what a stream holds by now."""
        self.stream_changes(stream, order_col).awaitTermination()

    def _read(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{folder}")

    def _totals(self) -> DataFrame:
        return self._read("changes", CHANGES).groupBy("field", "term").agg(
            F.sum("papers").alias("papers"), F.sum("tokens").alias("tokens"))

    def term_stats(self) -> DataFrame:
        """field, term, df; as `build_term_stats` over all current papers."""
        return self._totals().filter(F.col("term").isNotNull() & (F.col("papers") > 0)).select(
            "field", "term", F.col("papers").alias("df"))

    def field_stats(self) -> DataFrame:
        """field, n_docs, avgdl; as `build_field_stats` over all current papers."""
        fields = self.spark.createDataFrame([(f,) for f in rules.FIELDS], "field string")
        held = fields.join(self._totals().filter(F.col("term").isNull()).drop("term"), "field", "left")
        n = F.coalesce("papers", F.lit(0).cast("bigint"))
        return held.select("field", n.alias("n_docs"), F.coalesce(F.try_divide("tokens", n), F.lit(0.0)).alias("avgdl"))
