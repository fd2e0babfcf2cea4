"""Texts split into words inside tasks, a batch of rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import rules

TOKEN_COLUMNS = {f: f"{f}_tokens" for f in rules.FIELDS}
TEXT_COLUMNS = {f: f"{f}_source" for f in rules.FIELDS}
# letters and digits in lower case, 0 for all that stands between words
_LOWER = np.zeros(256, dtype=np.uint8)
for _byte in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _LOWER[_byte] = _byte
_LOWER[65:91] = _LOWER[97:123]


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text and all words in a row, as `tokenize` gives them for texts without Han characters."""
    array = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    raw = _LOWER[raw[offsets[0]:offsets[-1]]]
    bounds = offsets - offsets[0]
    inside = raw != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    # a word does not go on from one text to the next
    cuts = bounds[:-1][bounds[:-1] < len(raw)]
    opens[cuts] = inside[cuts]
    start = np.flatnonzero(opens)
    # without what stands between the words, a word ends where the next one begins
    ends = np.append(np.cumsum(inside)[start] - 1, np.count_nonzero(inside))
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[inside]))
    return np.diff(np.searchsorted(start, bounds)), words


def split_tokens(batch: pa.RecordBatch, field: str) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Lengths and tokens of a field from the texts and from the token arrays; a row has one of them."""
    if TEXT_COLUMNS[field] in batch.schema.names:
        yield _words(batch.column(TEXT_COLUMNS[field]))
    lists = batch.column(TOKEN_COLUMNS[field])
    if lists.null_count < len(lists):
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield length, lists.flatten()
