"""Tables that several steps of one operator read: written once to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.scale import storage_root

# ids from here on stand for rows without an id; real ids are smaller
SURROGATE = 2**62


def surrogate_id(text: Column) -> Column:
    """Stands in for a missing id: after all real ids, equal for equal texts."""
    return F.lit(SURROGATE) + F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(SURROGATE - 1))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{storage_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet to the shared folder and read it again.

    Unlike a cached or local copy the files survive lost executors, and unlike
    checkpoint() they are columnar and compressed.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
