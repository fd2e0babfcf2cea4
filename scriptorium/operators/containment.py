"""Substring tests between two tables of distinct values, by keys instead of a nested loop."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import cut_lineage, small_join

CANDIDATES = 8
# (least bytes of a needle, bytes of a piece, pieces of a window); the least is piece + window - 1
CLASSES = ((1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (8, 5, 4), (16, 8, 9), (32, 12, 21), (64, 16, 49))
SLICE_BYTES = 1 << 20

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _anchors(raw: np.ndarray, bounds: np.ndarray, piece: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct anchors of each text: the least piece of every window, as bytes."""
    n = len(raw) - piece - window + 2
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    hashes = np.zeros(len(raw) - piece + 1, dtype=U64)
    for j in range(piece):
        hashes = hashes * _MULTIPLIER + raw[j:j + len(hashes)] + U64(1)
    least, width = _mixed(hashes), 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    inside = np.arange(n) + piece + window - 1 <= bounds[text + 1]
    text, least = text[inside], least[inside]
    # windows that follow each other mostly have the same anchor
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    text, least = text[new], least[new]
    order = np.lexsort((least, text))
    text, least = text[order], least[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    return text[new], least[new]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about SLICE_BYTES of text: the rows, their bytes, and the bounds of each text."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1, at + 1)
        yield batch.slice(at, end - at), raw[offsets[at]:offsets[end]].astype(U64), offsets[at:end + 1] - offsets[at]
        at = end


def _keys(classes: list[int], own: bool):
    """Rows (field_key, id, text) -> (id, anchor).

    Of needles (`own`), at most CANDIDATES anchors by the class of their length; of hays, all anchors of the given classes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, bounds in _slices(batch):
                field = rows.column(rows.schema.get_field_index("field_key")).to_numpy().view(U64)
                ids = rows.column(rows.schema.get_field_index("id"))
                of_class = np.searchsorted([c[0] for c in CLASSES], np.diff(bounds), side="right") - 1
                for c in classes:
                    text, hashes = _anchors(raw, bounds, *CLASSES[c][1:])
                    if own:
                        first = np.searchsorted(text, text)
                        mine = (of_class[text] == c) & (np.arange(len(text)) - first < CANDIDATES)
                        text, hashes = text[mine], hashes[mine]
                    anchor = _mixed(hashes ^ _mixed(field[text] + U64(c)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(anchor.view(np.int64))], names=["id", "anchor"])
    return run


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(field, needle, hay) where the needle is a substring of a hay of its field.

    needles(field, needle) and hays(field, hay) are distinct; empty needles find nothing.

    Blocking is exact.  The anchors of a text are the least pieces, by hash, of all its windows of a fixed length.
    Every window of a needle is one of a hay that holds it, so the hay has all anchors of the needle; a needle that
    has one which no hay has finds nothing, any other is looked up by the rarest of a few.  The longer a needle, the
    longer its windows and the fewer the anchors; there are eight classes of lengths.  Only hashes are shuffled:
    texts join the pairs that are left, and decide.
    """
    def keyed(df, name):
        key = F.xxhash64("field", name)
        return df.select(F.xxhash64("field").alias("field_key"), key.alias("id"), F.col(name).alias("text"))

    needles = needles.filter("needle != ''")
    size = F.octet_length("needle")
    of_class = F.lit(0)
    for i, (least, _, _) in enumerate(CLASSES):
        of_class = F.when(size >= least, F.lit(i)).otherwise(of_class)
    # eight numbers at most
    classes = sorted(r[0] for r in needles.select(of_class.alias("c")).distinct().collect())
    if not classes:
        return needles.join(hays, "field").select("field", "needle", "hay").limit(0)
    schema = "id bigint, anchor bigint"
    wanted = keyed(needles, "needle").mapInArrow(_keys(classes, True), schema).select(F.col("id").alias("needle_id"), "anchor")
    offered = [keyed(hays, "hay").mapInArrow(_keys([c], False), schema).select(F.col("id").alias("hay_id"), "anchor") for c in classes]
    offered = reduce(DataFrame.unionByName, offered)
    # counted below the shuffle; 0 for an anchor that no hay has
    frequency = offered.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        wanted.join(frequency, "anchor", "left")
        .groupBy("needle_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("r"))
        .filter("r.n > 0").select("needle_id", F.col("r.anchor").alias("anchor")))
    # two numbers a needle; read by the count and by the join
    rarest = cut_lineage(rarest)
    pairs = small_join(offered, rarest, ["anchor"], spread_by=["hay_id"]).select("needle_id", "hay_id").distinct()
    # values whose ids collide meet in the same pair, and the texts tell them apart
    asked = needles.withColumn("needle_id", F.xxhash64("field", "needle"))
    held = hays.select(F.col("field").alias("_field"), "hay", F.xxhash64("field", "hay").alias("hay_id"))
    return (pairs.join(asked, "needle_id").join(held, "hay_id")
            .filter((F.col("field") == F.col("_field")) & F.col("hay").contains(F.col("needle")))
            .select("field", "needle", "hay"))
