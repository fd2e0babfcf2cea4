"""The inverted index: postings, document frequencies, field lengths."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import has_han, tokenize
from ..scale import small_join
from .split import TEXT_COLUMNS, TOKEN_COLUMNS, split_tokens

# papers of a block: their postings for the terms of a batch are searched in one task
BLOCK_PAPERS = 2_048
# n papers hold the term, `total` times in all
BLOCK_ROWS = ("block int, blocks int, field string, term string, papers array<string>, tfs array<int>, dls array<int>, n bigint, "
              "total bigint")
BLOCK_SCHEMA = f"{BLOCK_ROWS}, term_bucket int"


@dataclass(frozen=True)
class Index:
    """postings(paper_id, field, term, tf, dl), term_stats(field, term, df),
    field_stats(field, n_docs, avgdl).

    Statistics always cover the whole corpus, whatever a search is filtered to.
    For an index that was not stored, `term_stats` is None and `occurrences`
    holds the tokens: a query batch then counts only the terms it asks for.
    """

    postings: DataFrame
    term_stats: DataFrame | None
    field_stats: DataFrame
    occurrences: DataFrame | None = None
    buckets: int = 0
    # `BLOCK_SCHEMA` and avgdl: the postings of a stored index by blocks of papers
    blocks: DataFrame | None = None
    # paper_id and the `token_sources` of all fields, one row a paper; of an index that is not stored
    tokens: DataFrame | None = None

    def matching(self, terms: DataFrame, fits: bool) -> tuple[DataFrame, DataFrame]:
        """Postings holding the (field, term) pairs given, and their document frequencies.

        `fits` tells whether the terms were found few enough to broadcast.
        """
        wanted = terms.select("field", "term").distinct()
        keys = ["field", "term"]
        if self.term_stats is None:
            found = count_terms(small_join(self.occurrences, wanted, keys, spread_by=["paper_id"], fits=fits))
            # counts are few; bringing a paper together here saves shuffling its scores per query
            return found.repartition("paper_id"), build_term_stats(found)
        if self.blocks is not None:
            # lists are chosen whole; bringing a paper together here saves shuffling its scores per query
            held = small_join(self._partitions(self.blocks, wanted), wanted, keys, spread_by=["block"], fits=fits)
            return block_postings(held).repartition("paper_id"), small_join(self.term_stats, wanted, keys, fits=fits)
        return self.postings, small_join(self.term_stats, wanted, keys, fits=fits)

    def _partitions(self, stored: DataFrame, wanted: DataFrame) -> DataFrame:
        # at most `buckets` numbers: lets the scan skip all other partitions
        needed = [r[0] for r in wanted.select(term_bucket(self.buckets)).distinct().collect()]
        return stored.filter(F.col("term_bucket").isin(needed))

    def matching_blocks(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks in the partitions of the terms given (few enough to broadcast), and their document frequencies."""
        wanted = terms.select("field", "term").distinct()
        return self._partitions(self.blocks, wanted), small_join(self.term_stats, wanted, ["field", "term"], fits=True)


def with_tokens(papers: DataFrame) -> DataFrame:
    """Add the token array of every searchable field that has none yet."""
    missing = {
        column: tokenize(rules.FIELD_COLUMNS[field])
        for field, column in TOKEN_COLUMNS.items() if column not in papers.columns
    }
    return papers.withColumns(missing) if missing else papers


def token_sources(papers: DataFrame) -> DataFrame:
    """paper_id and for every field its text, for a task to split, or the tokens: those given, and those of texts with Han characters."""
    columns = []
    for field, column in TOKEN_COLUMNS.items():
        if column in papers.columns:
            columns.append(F.col(column))
            continue
        text = F.col(rules.FIELD_COLUMNS[field])
        # only a text with longer characters than ASCII is searched for them
        han = F.when(F.octet_length(text) > F.length(text), has_han(text)).otherwise(F.lit(False))
        columns += [F.when(~han, text).alias(TEXT_COLUMNS[field]), F.when(han, tokenize(text)).alias(column)]
    return papers.select("paper_id", *columns)


def field_tokens(papers: DataFrame) -> DataFrame:
    """Long form: one row per paper and field."""
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(c).alias("tokens"), F.size(F.col(c)).alias("dl"))
        for f, c in TOKEN_COLUMNS.items()
    ])
    tokens = with_tokens(papers).select("paper_id", F.explode(fields).alias("f"))
    return tokens.select("paper_id", "f.field", "f.tokens", "f.dl")


def term_occurrences(papers: DataFrame) -> DataFrame:
    return field_tokens(papers).select("paper_id", "field", "dl", F.explode("tokens").alias("term"))


def count_terms(occurrences: DataFrame) -> DataFrame:
    """Occurrences -> postings; combined before the shuffle, a paper lies in one row."""
    return occurrences.groupBy("paper_id", "field", "term").agg(
        F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"))


def build_postings(papers: DataFrame) -> DataFrame:
    return count_terms(term_occurrences(papers))


def build_field_stats(papers: DataFrame) -> DataFrame:
    """Average length over all papers, empty ones included."""
    totals = with_tokens(papers).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in TOKEN_COLUMNS.values()],
    )
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(c).alias("total")) for f, c in TOKEN_COLUMNS.items()
    ])
    return totals.select("n_docs", F.explode(fields).alias("f")).select(
        "f.field", "n_docs",
        F.when(F.col("n_docs") > 0, F.col("f.total") / F.col("n_docs")).otherwise(F.lit(0.0)).alias("avgdl"),
    )


def build_term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def build_index(papers: DataFrame) -> Index:
    return Index(build_postings(papers), None, build_field_stats(papers), term_occurrences(papers),
                 tokens=token_sources(papers))


def term_bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("term_bucket")


def block_postings(blocks: DataFrame) -> DataFrame:
    """(paper_id, field, term, tf, dl) of the lists in blocks."""
    rows = F.arrays_zip(F.col("papers").alias("paper_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))
    return blocks.select("field", "term", F.inline(rows)).select("paper_id", "field", "term", "tf", "dl")


def write_index(papers: DataFrame, path: str, term_buckets: int = 64, block_papers: int = BLOCK_PAPERS) -> Index:
    """Store the index: for blocks of about `block_papers` papers the papers, counts and field lengths of every term.

    Lists are partitioned by a hash of the term, so a query batch reads only the partitions of its own terms, and no
    common term gathers in one task.  The texts are read and shuffled once, in place of the postings that come of them.
    """
    spark = papers.sparkSession
    n_papers = papers.count()
    write_blocks(papers, path, n_papers, term_buckets, block_papers)
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    stored.groupBy("field", "term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/term_stats")
    lengths = stored.groupBy("field").agg(F.sum("total").alias("total"))
    fields = spark.createDataFrame([(f,) for f in rules.FIELDS], "field string")
    n = F.lit(n_papers)
    # totals from the stored lists: the texts are read once
    (fields.join(lengths, "field", "left")
     .select("field", n.alias("n_docs"), F.coalesce(F.try_divide("total", n), F.lit(0.0)).alias("avgdl"))
     .write.mode("overwrite").parquet(f"{path}/field_stats"))
    spark.createDataFrame([(term_buckets,)], "term_buckets int").write.mode("overwrite").parquet(f"{path}/layout")
    return read_index(spark, path)


def write_blocks(papers: DataFrame, path: str, n_papers: int, term_buckets: int, block_papers: int) -> None:
    """Each block's texts come together in a task, which splits and inverts them."""
    n = max(1, math.ceil(n_papers / block_papers))

    def invert(rows: pa.Table) -> pa.Table:
        batch = rows.combine_chunks().to_batches()[0]
        ids = batch.column("paper_id").dictionary_encode()
        number = ids.indices.to_numpy()
        first = np.unique(number, return_index=True)[1]
        out = []
        for field in rules.FIELDS:
            length = np.zeros(batch.num_rows, dtype=np.int64)
            where, tokens = [], []
            for size, words in split_tokens(batch, field):
                length += size
                where.append(np.repeat(number, size))
                tokens.append(words.cast(pa.large_string()))
            terms = pa.chunked_array(tokens, pa.large_string()).combine_chunks().dictionary_encode()
            # by term, then by paper
            key, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(first) + np.concatenate(where), return_counts=True)
            term, paper = key // len(first), key % len(first)
            ends = np.searchsorted(term, np.arange(len(terms.dictionary) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (
                ids.dictionary.take(pa.array(paper)), pa.array(tf, pa.int32()), pa.array(length[first][paper], pa.int32()))]
            size = len(terms.dictionary)
            out.append(pa.table({
                "block": pa.array(np.full(size, batch.column("block")[0].as_py()), pa.int32()), "blocks": pa.array(np.full(size, n), pa.int32()),
                "field": pa.array([field] * size, pa.string()), "term": terms.dictionary.cast(pa.string()),
                "papers": lists[0], "tfs": lists[1], "dls": lists[2], "n": pa.array(np.diff(ends), pa.int64()),
                "total": pa.array(np.diff(np.append(0, np.cumsum(tf))[ends]), pa.int64())}))
        return pa.concat_tables(out)

    block = F.pmod(F.xxhash64("paper_id"), F.lit(n)).cast("int").alias("block")
    texts = papers.select("paper_id", *{*rules.FIELD_COLUMNS.values(), *TOKEN_COLUMNS.values()} & set(papers.columns))
    (token_sources(texts).select(block, "*").groupBy("block").applyInArrow(invert, BLOCK_ROWS)
     .select("*", term_bucket(term_buckets)).write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/blocks"))


def read_index(spark: SparkSession, path: str) -> Index:
    """Open a stored index."""
    lengths = spark.read.parquet(f"{path}/field_stats")
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # five rows, one per field
    blocks = stored.join(F.broadcast(lengths.select("field", "avgdl")), "field")
    return Index(
        block_postings(stored), spark.read.parquet(f"{path}/term_stats"), lengths,
        buckets=spark.read.parquet(f"{path}/layout").first()[0], blocks=blocks)
