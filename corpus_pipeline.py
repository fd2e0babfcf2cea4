"""Training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next one.  All but the last return the
columns of `documents`; whatever else the table holds passes through.

1. toxicity      rejects documents of score 0.3 or more; labels are learnt from `labels`
2. near_dedup    keeps the smallest id of each component of near duplicates
3. secret_scan   masks secrets in the texts and counts their characters anew
4. source_mix    repeats or drops documents until each source has its target of words
5. byte_bpe      encodes the texts, and decodes the ids to prove the round trip

An empty table passes through all stages; null texts and ids have the results
that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, toxicity
from scriptorium.llm.near_dedup import one_of_each
from scriptorium.llm.secret_scan import redacted, scan
from scriptorium.llm.source_mix import mix
from scriptorium.llm.store import saved


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model, threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, size=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = scan(docs.select("text", F.struct("*").alias("row")), keep=("row",))
    text = redacted(F.col("row.text"), F.col("spans"))
    changed = found.select("row", text.alias("masked"), (F.size("spans") > 0).alias("changed"))
    new = {"text": F.col("masked"),
           "n_chars": F.when(F.col("changed"), F.length("masked").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return changed.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    narrow = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    taken = mix(narrow, share=1.5, weights=(3.0, 1.0, 2.0), epochs=2.0, keep=("row",)).filter("_times > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = bpe.default_ranks()
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", "source", text.alias("text"), F.md5(text.cast("binary")).alias("digest"))
    both = bpe.encode(texts, keep=("doc_id", "source", "digest"), path=path, pattern=pattern, decoded="decoded")
    return both.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                       (F.md5("decoded") == F.col("digest")).alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_texts),
]

# the draws and models have no SQL twin; tests/llm compares the operators with brute force and checks what the stages do
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
