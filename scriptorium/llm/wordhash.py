"""Words of whole texts as arrays: bounds and 64-bit hashes for a block of rows at once.

A word is a run of bytes other than ASCII white space (space, tab, line feed,
vertical tab, form feed, carriage return); in UTF-8 these bytes never occur
inside another character.  Hashes are fixed functions of the bytes, the same in
every task and run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

U64 = np.uint64
_RNG = np.random.default_rng(20_240_917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(base: int, inverse: bool, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or its inverses; kept and grown by doubling."""
    key = f"{base}:{inverse}"
    have = _powers.get(key)
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        steps = np.full(max(n, 1 << 16), step & _MASK, dtype=U64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps, dtype=U64)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Hash of any range [start, end) of a sequence of 64-bit values in constant time."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        self.base = base
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * _power(base, False, n)[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _power(self.base, True, len(self.sums))
        return mixed((self.sums[end] - self.sums[start]) * back[start] + (end - start).astype(U64))


class Words:
    """Words of a block of texts; `breaks` tells for each byte value whether it stands between words.

    With `whole` every text is one word, empty ones too.

    start, end: byte bounds; hash: 64-bit hashes; first: index of the first word
    of each text, with the number of all words at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACE, whole: bool = False):
        array = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
        data = array.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        raw = raw[offsets[0]:offsets[-1]] if len(raw) else raw
        bounds = offsets - offsets[0]
        if whole:
            self.start, self.end, self.first, self.raw = bounds[:-1], bounds[1:], np.arange(len(bounds)), raw
            self.hash = Prefix(_BYTE[raw]).ranges(self.start, self.end)
            return
        inside = ~breaks[raw]
        n = len(raw)
        # a word starts where the byte before is white space or belongs to another text
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = bounds[:-1][(bounds[:-1] < n)]
        opens[cuts] = inside[cuts]
        closes = np.zeros(n + 1, dtype=bool)
        closes[1:] = inside
        closes[1:n] &= ~inside[1:]
        ends = bounds[1:][bounds[1:] > 0]
        closes[ends] = inside[ends - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes)
        self.first = np.searchsorted(self.start, bounds)
        self.raw = _LOWER[raw] if lower else raw
        self.prefix = Prefix(_BYTE[self.raw])
        self.hash = self.prefix.ranges(self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(values: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive values (n - k + 1 of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    rng = np.random.default_rng(1_000_003 + salt)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out += values[j:j + n] * (U64(rng.integers(1, 2**63)) * U64(2) + U64(1))
    return mixed(out + U64(salt))


def blocks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about max_bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
        lengths = np.diff(np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset:sizes.offset + len(sizes) + 1])
        at, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > at and total + n > max_bytes:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if batch.num_rows > at:
            yield batch.slice(at)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: idle Python workers live on beside the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before it."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new
