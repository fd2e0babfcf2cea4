"""Join, ranking and storage helpers shared by the operators.

They hold the rules that keep jobs whole and even on large clusters: a side is
broadcast only after its row count was checked, a hot key is spread by a salt,
and a ranked group is cut on the map side or ranked by range partitions instead
of being sorted in one task.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 200_000
SALT = 32
# Catalyst pushes row_number() <= k below the shuffle up to this k
GROUP_LIMIT_MAX = 1000
SCORE_DIGITS = 6
# rows of whole lists that are shuffled at once: bounds the shuffle files that exist at a time
BATCH_ROWS = 40_000_000
PART_ROWS = 10_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def storage_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only in local mode where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{storage_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, fixes partition contents."""
    storage_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Rows as Parquet files in the shared folder: for long lists, which compressed columns keep many times smaller than a checkpoint."""
    path = scratch_path(df.sparkSession, "stored")
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    """Append to Parquet files; the shuffle files of the write go with its end, not with some later garbage collection."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
               spread_by: list[str] | None = None, max_rows: int = BROADCAST_ROWS,
               fits: bool | None = None) -> DataFrame:
    """Equi-join with a side that is usually small (a batch of queries).

    `fits` is the result of an earlier is_small() on a table with at least as
    many rows as `small`.

    Within the checked bound it is broadcast and `big` is not shuffled.  Beyond
    it, inner joins are salted so that a key held by a third of `big` is spread
    over SALT tasks; other joins are left to adaptive execution.
    """
    if is_small(small, max_rows) if fits is None else fits:
        return big.join(F.broadcast(small), keys, how)
    if how != "inner" or not spread_by:
        return big.join(small, keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALT)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def _many_partitions(df: DataFrame) -> bool:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) > 64


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int,
          spread_by: list[str], rank: str = "rank") -> DataFrame:
    """The first k rows of every group, numbered from 1; k <= 0 keeps all.

    The limit is applied before the shuffle.  With many partitions a salted
    first round keeps the last task at SALT * k rows per group.
    """
    if k <= 0:
        return global_rank(df, groups, order, rank)
    if _many_partitions(df):
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALT)))
        first = Window.partitionBy(*groups, "_salt").orderBy(*order)
        df = df.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n", "_salt")
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def global_rank(df: DataFrame, groups: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Number all rows of every group without gathering a group in one task."""
    return rank_batches([df], groups, order, rank)


def in_batches(df: DataFrame, groups: list[str], rows: int | None = None) -> list[DataFrame]:
    """`df` in parts of about BATCH_ROWS rows, each holding whole groups; for tables that are cheap to read several times."""
    n = max(1, math.ceil((df.count() if rows is None else rows) / BATCH_ROWS))
    return [df] if n == 1 else [df.filter(F.pmod(F.xxhash64(*groups), F.lit(n)) == i) for i in range(n)]


def rank_batches(batches: list[DataFrame], groups: list[str], order: list[Column | tuple[Column, bool]],
                 rank: str = "rank", rows: int | None = None) -> DataFrame:
    """`global_rank` over tables that share no group; each is shuffled by itself.

    Rows are range-partitioned by group and order, sorted and numbered inside a partition, stored, and shifted by the
    number of rows the group has in earlier partitions.  Rows are shuffled once.  A pair in `order` is an expression and
    whether it rises: it is computed once a row, where a sort would compute it in every comparison.  `rows`, where it is
    known, keeps short lists in few partitions.
    """
    spark = batches[0].sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    if rows is not None:
        parts = max(1, min(parts, math.ceil(rows / PART_ROWS)))
    costly = {f"_order{i}": o[0] for i, o in enumerate(order) if isinstance(o, tuple)}

    def keys(known: dict[str, Column]) -> list[Column]:
        pairs = [(known.get(f"_order{i}"), o) for i, o in enumerate(order)]
        return [*[F.col(g) for g in groups], *[o if c is None else c.asc() if o[1] else c.desc() for c, o in pairs]]

    path = scratch_path(spark, "stored")
    for i, df in enumerate(batches):
        ranged = df.repartitionByRange(parts, *keys(costly)).withColumns(costly)
        ranged = ranged.sortWithinPartitions(*keys({c: F.col(c) for c in costly})).drop(*costly)
        # stored, so that it is fixed which rows sit in which partition; the id's lower 33 bits count rows
        numbered = ranged.withColumns({
            "_part": F.spark_partition_id() + F.lit(i * parts),
            "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        _write(numbered, path)
    fixed = spark.read.schema(numbered.schema).parquet(path)
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(fixed.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")))
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    offsets = counts.withColumn("_shift", shift).drop("_rows", "_first")
    if is_small(counts):
        offsets = F.broadcast(offsets)
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("_part", *groups)]
    joined = fixed.alias("n").join(offsets.alias("o"), same)
    columns = [F.col(f"n.{c}") for c in batches[0].columns]
    return joined.select(*columns, (F.col("n._at") + F.col("o._shift")).cast("bigint").alias(rank))


def ranked_by_score(batches: list[DataFrame]) -> DataFrame:
    """Hits in the order of `by_score`, whole."""
    return rank_batches(batches, ["query_id"], [(F.round("score", SCORE_DIGITS), False), F.col("paper_id").asc()])


def by_score(score: str = "score", *ids: str) -> list[Column]:
    """Order of every ranked list: rounded score downwards, then id."""
    return [F.round(F.col(score), SCORE_DIGITS).desc(), *[F.col(i).asc() for i in ids]]
