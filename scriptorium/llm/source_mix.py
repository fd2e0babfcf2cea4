"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source has a weight and a cap, `epochs` times its size.  The budget is
given out by weight; sources above their cap are clamped at it, and the excess
goes to the others by weight, until none is above.  A source's target then fixes
how often its documents are repeated: the whole part of target / size for every
document, the fractional part for a seeded sample of documents.

The fractional sample is the documents of a source in order of a seeded hash, as
many as bring the source's words nearest to its target.  To find where it ends,
words are summed by bucket of the hash (BUCKETS a source, before the shuffle
already), the running sum of a source's buckets tells the bucket in which it
ends, and only the documents of that one bucket are ordered; one document is
then added or dropped to close what is left.  So a source that
holds a third of all rows is never sorted in one task.  The hash covers id and
text; reruns agree.

Defined cases: a null text has size 0; null is a source of its own, the last
one; sources of size 0 have target 0; repeated rows (equal id
and text) are taken or left together; an empty table gives an empty result; other columns pass through where
asked for, and `_`-prefixed names are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import saved

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ordered_number(sources: DataFrame, key: str, out: str) -> DataFrame:
    """Number rows from 0 by key, nulls last, without gathering them: ranges, then offsets per range."""
    parts = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    order = F.col(key).asc_nulls_last()
    ranged = saved(sources.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return (ranged.withColumn("_n", inside).join(offsets.select("_part", "_before"), "_part")
            .withColumn(out, F.col("_n") + F.col("_before") - 1).drop("_part", "_n", "_before"))


def water_fill(sources: DataFrame, budget: float, epochs: float = 2.0) -> DataFrame:
    """Rows with `size` and `weight` -> the same rows with `target`.

    Each round divides what is left among the sources that are not clamped yet;
    sums are taken by the cluster, and rounds end when no source is above its
    cap.  A round clamps at least one source, few rounds suffice in practice.
    """
    cap = F.col("size") * F.lit(float(epochs))
    level = 0.0
    while True:
        # a source is clamped where level x weight has reached its cap; the level only rises
        clamped = (F.lit(level) * F.col("weight") >= cap) if level else (cap <= 0)
        sums = sources.agg(F.sum(F.when(clamped, cap)).alias("given"),
                           F.sum(F.when(~clamped, F.col("weight"))).alias("weights"),
                           F.count(F.when(~clamped, True)).alias("free")).first()
        if not sums["free"]:
            break
        risen = max((budget - (sums["given"] or 0.0)) / sums["weights"], 0.0)
        if risen <= level:
            break
        level = risen
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap).cast("double"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), epochs: float = 2.0,
        seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        keep: tuple[str, ...] = ()) -> DataFrame:
    """The `keep` columns, _id, _source, _size, _source_size, _target, _times of every document.

    Sources in order of their name (code points, null last) take the weights in
    turn.  The budget is `share` of all words; _times is how often the mix takes
    the document.
    """
    rows = docs.select(*[F.col(c) for c in keep], F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                       word_count(F.col(text_col)).alias("_size"),
                       F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"))
    narrow = saved(rows.select("_id", "_source", "_size", "_hash"), "sizes")
    bucket = F.shiftrightunsigned("_hash", 64 - BUCKETS.bit_length() + 1)
    sums = saved(narrow.groupBy("_source", bucket.alias("_bucket")).agg(
        F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_docs")), "sums")
    sources = sums.groupBy("_source").agg(F.sum("_words").alias("size"))
    numbered = saved(ordered_number(sources, "_source", "_number"), "sources")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_number") % len(weights) + 1).cast("int"))
    total = numbered.agg(F.sum("size")).first()[0] or 0
    targets = saved(water_fill(numbered.withColumn("weight", cycle), share * total, epochs), "targets")
    fraction = targets.select(
        "_source", F.col("size").alias("_source_size"), F.col("target").alias("_target"),
        F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).alias("_whole"))
    fraction = fraction.withColumn("_part", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    # where the fractional sample ends: the bucket whose words reach it
    running = Window.partitionBy("_source").orderBy("_bucket")
    ends = _null_safe(sums, fraction, "_source").withColumn("_upto", F.sum("_words").over(running))
    ends = ends.withColumn("_before", F.col("_upto") - F.col("_words"))
    edge = ends.filter((F.col("_upto") > F.col("_part")) & (F.col("_before") <= F.col("_part"))).groupBy("_source").agg(
        F.min("_bucket").alias("_edge"), F.min_by("_before", "_bucket").alias("_edge_before"))
    plan = saved(_null_safe(fraction, edge, "_source", "left"), "plan")
    last = _null_safe(narrow.withColumn("_bucket", bucket), plan.filter("_edge is not null"), "_source").filter(
        "_bucket = _edge")
    last = last.groupBy("_source", "_hash").agg(F.sum("_size").alias("_size"), F.first("_edge_before").alias("_edge_before"),
                                                F.first("_part").alias("_part"))
    order = Window.partitionBy("_source").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)
    # a document of the last bucket is taken if that brings the words nearer to the target
    last = last.withColumn("_taken", F.col("_edge_before") + F.coalesce(F.sum("_size").over(order), F.lit(0)))
    last = last.filter(F.col("_taken") + F.col("_size") / 2 <= F.col("_part"))
    cut = last.groupBy("_source").agg(F.max("_hash").alias("_cut"))
    plan = saved(_null_safe(plan, cut, "_source", "left"), "plan")
    picked = (F.coalesce(bucket < F.col("_edge"), F.col("_part") > 0)
              | F.coalesce((bucket == F.col("_edge")) & (F.col("_hash") <= F.col("_cut")), F.lit(False)))
    plan = saved(_corrected(narrow, plan, picked), "plan")
    picked = picked != F.coalesce(F.col("_hash") == F.col("_swap"), F.lit(False))
    out = _null_safe(rows if keep else narrow, plan, "_source")
    return out.select(*keep, "_id", "_source", "_size", "_source_size", "_target",
                      (F.col("_whole") + F.when(picked, 1).otherwise(0)).cast("bigint").alias("_times"))


def _corrected(narrow: DataFrame, plan: DataFrame, picked: Column) -> DataFrame:
    """The plan with `_swap`: hash of the one document of each source to add or to drop, if that helps.

    What the sample lacks (or has too much) is at most half a long document; the
    document outside (or inside) the sample whose size is nearest to that closes it.
    """
    drawn = _null_safe(narrow, plan, "_source").withColumn("_picked", picked)
    lack = drawn.groupBy("_source").agg(
        (F.first("_part") - F.sum(F.when(F.col("_picked"), F.col("_size")).otherwise(0))).alias("_lack"))
    lack = saved(lack.filter("_lack <> 0"), "lack")
    open_docs = _null_safe(drawn.select("_source", "_hash", "_size", "_picked"), lack, "_source").filter(
        F.col("_picked") == (F.col("_lack") < 0))
    miss = F.abs(F.col("_size") - F.abs("_lack"))
    best = open_docs.groupBy("_source").agg(F.min_by("_hash", F.struct(miss, "_hash")).alias("_swap"),
                                            F.first("_lack").alias("_lack"))
    # equal rows move together: what they bring in all decides
    same = _null_safe(narrow, best, "_source").filter("_hash = _swap").groupBy("_source").agg(
        F.sum("_size").alias("_moved"), F.first("_swap").alias("_swap"), F.first("_lack").alias("_lack"))
    helps = same.filter(F.abs(F.abs("_lack") - F.col("_moved")) < F.abs("_lack")).select("_source", "_swap")
    return _null_safe(plan, helps, "_source", "left")


def _null_safe(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join in which null is a key like others."""
    other = right.withColumnRenamed(key, "_key")
    return left.join(other, left[key].eqNullSafe(other["_key"]), how).drop("_key")
