"""Batch text encoding with the built-in hashing encoder or one of your own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import DIMENSIONS, add_hashed_vectors

Encoder = Callable[[list[str]], Iterable]


def _unit(vector) -> list[float] | None:
    if vector is None:
        return None
    v = np.asarray(vector, dtype=np.float64)
    n = float(np.sqrt((v * v).sum()))
    return (v / n).tolist() if n > 0 else None


def _isolated(encoder: Encoder, texts: list[str]) -> tuple[list, list[str | None]]:
    """Vectors and failures of a batch: one that fails is halved until only single texts fail.

    Half of a batch is tried again, not all of its texts one by one, so one bad text
    of n costs about 2 * log2(n) more calls.  A batch without as many vectors as texts has failed.
    """
    try:
        vectors = [_unit(v) for v in encoder(texts)]
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors, [None] * len(texts)
    except Exception as e:
        if len(texts) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = len(texts) // 2
    first, second = _isolated(encoder, texts[:half]), _isolated(encoder, texts[half:])
    return first[0] + second[0], first[1] + second[1]


def embed_texts(df: DataFrame, text: str = "chunk_text", output: str = "embedding",
                encoder_factory: Callable[[], Encoder] | None = None, batch: int = 32,
                error: str | None = None) -> DataFrame:
    """Add a unit vector per row.

    Without a factory the hashing encoder runs as native columns.  A factory is
    called once per task and its encoder gets lists of at most `batch` texts of
    similar length, so that padding stays small.  A text that fails leaves a NULL
    vector, so its row stays searchable by words; the others of its batch are
    encoded.  `error` names a column for what went wrong with a text.
    """
    if encoder_factory is None:
        hashed = add_hashed_vectors(df, text, output, DIMENSIONS).withColumn(
            output, F.col(output).cast("array<float>"))
        return hashed.withColumn(error, F.lit(None).cast("string")) if error else hashed

    @F.pandas_udf("vector array<float>, failure string")
    def encode(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_factory()
        for texts in frames:
            values = texts.fillna("").tolist()
            order = sorted(range(len(values)), key=lambda i: len(values[i]))
            vectors: list = [None] * len(values)
            failures: list[str | None] = [None] * len(values)
            for start in range(0, len(order), batch):
                part = order[start:start + batch]
                for i, vector, failure in zip(part, *_isolated(encoder, [values[i] for i in part])):
                    vectors[i], failures[i] = vector, failure
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "failure": pd.Series(failures, dtype=object)})

    encoded = df.withColumn("_encoded", encode(F.col(text))).withColumn(output, F.col("_encoded.vector"))
    if error:
        encoded = encoded.withColumn(error, F.col("_encoded.failure"))
    return encoded.drop("_encoded")
