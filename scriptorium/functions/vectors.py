"""Vector column expressions and the default text encoder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, tokenize

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0 for missing, unequal or zero vectors."""
    a, b = col(a), col(b)
    scale = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))


def hash_codes(text: Column | str, dims: int = DIMENSIONS) -> Column:
    """Per token 2 * bucket, plus 1 for a negative sign, read from its md5."""
    def code(t):
        digest = F.md5(t)
        bucket = F.conv(F.substring(digest, 1, 7), 16, 10).cast("int") % dims
        return bucket * 2 + F.when(F.substring(digest, 8, 1) < "8", F.lit(0)).otherwise(F.lit(1))
    return F.transform(tokenize(text), code)


def _inner(codes: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list array and the row each belongs to."""
    lengths = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False)
    return codes.flatten(), np.repeat(np.arange(len(codes)), lengths)


def _unit_matrix(codes: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of token codes and a mask of the rows that are not zero."""
    values, rows = _inner(codes)
    values = values.to_numpy(zero_copy_only=False)
    signs = 1.0 - 2.0 * (values % 2)
    sums = np.bincount(rows * dims + values // 2, weights=signs, minlength=len(codes) * dims)
    matrix = sums.reshape(len(codes), dims)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms > 0, norms, 1.0)[:, None], norms > 0


def add_hashed_vectors(df: DataFrame, text: str, output: str, dims: int = DIMENSIONS) -> DataFrame:
    """Signed feature hashing of the tokens, scaled to unit length.

    A stand-in for a trained encoder: deterministic, no model file.  Tokens and
    hash codes are native columns; Arrow batches only sum them up.  A text
    without tokens, or whose tokens cancel out, gives NULL.
    """
    @F.arrow_udf("array<double>")
    def vectors(codes: pa.Array) -> pa.Array:
        matrix, usable = _unit_matrix(codes, dims)
        offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * dims)
        return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()), mask=pa.array(~usable))

    return _from_codes(df, hash_codes(text, dims), vectors, output)


def _from_codes(df: DataFrame, codes: Column, udf, output: str) -> DataFrame:
    # codes are used twice, so they stay a column of their own below the Arrow step
    staged = df.withColumn("_codes", codes)
    # non-deterministic keeps the optimizer from copying the call into filters it derives later
    once = udf.asNondeterministic()
    return staged.withColumn(output, F.when(F.size("_codes") > 0, once(F.col("_codes")))).drop("_codes")


def add_hashed_similarity(df: DataFrame, sentence_lists: Column, output: str, dims: int = DIMENSIONS) -> DataFrame:
    """Similarity of adjacent sentences under the hashing encoder.

    array<array<string>> (sentences per chapter) -> array<array<double>>, one
    number less than sentences per chapter; only token codes leave the JVM.
    """
    @F.arrow_udf("array<array<double>>")
    def similarities(codes: pa.Array) -> pa.Array:
        chapters, chapter_rows = _inner(codes)
        sentences, sentence_rows = _inner(chapters)
        matrix, _ = _unit_matrix(sentences, dims)
        same = sentence_rows[1:] == sentence_rows[:-1]
        sims = np.einsum("ij,ij->i", matrix[1:], matrix[:-1])[same]
        return _nested(sims, np.bincount(sentence_rows[1:][same], minlength=len(chapters)),
                       np.bincount(chapter_rows, minlength=len(codes)))

    codes = F.transform(sentence_lists, lambda c: F.transform(c, lambda s: hash_codes(s, dims)))
    return _from_codes(df, codes, similarities, output)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _nested(values: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> pa.Array:
    lists = pa.ListArray.from_arrays(_offsets(inner), pa.array(values, pa.float64()))
    return pa.ListArray.from_arrays(_offsets(outer), lists)
