"""Byte-level BPE: encode whole texts by a file of ranks, decode ids to bytes.

Text is cut by a pattern; every match is encoded on its own.  A match that is a
token itself is that token.  Any other starts as its bytes, and the neighbouring
pair of smallest rank (leftmost on ties) is merged until no pair has a rank.

Method.  A segment tree over the byte positions holds at its leaves the rank of
the pair that starts there, together with the position, and at inner nodes the
minimum of the two below: the root is the leftmost pair of minimum rank.  A
merge changes three leaves (the merged token, its swallowed right neighbour and
the live token to its left), each by one walk to the root, so a match of n bytes
takes O(n log n) steps, however long it is.  Short matches of a block are merged
side by side: their trees are rows of one array and every step acts on all rows
that still have a pair.  Matches and words seen before are taken from caches of bounded
size (PIECES and WORDS), which changes no result.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated
rows repeat; rows need no id; the columns that are passed through are those
asked for, so clashing names cannot arise; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import string
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .wordhash import blocks

# entries of a cache generation; two generations are kept
PIECES = 60_000
WORDS = 120_000
# size of the table of pairs; it takes three times as many as the vocabulary has
HASH_BITS = 19
_HASH_MASK = (1 << HASH_BITS) - 1
# matches up to this many bytes are merged side by side
SIDE_BY_SIDE = 64
_NONE = np.iinfo(np.int64).max
_SHIFT = 32


def default_ranks() -> tuple[str, str]:
    """File of ranks and pattern of the public multilingual vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Cache:
    """Bounded cache of two generations: what is asked for again moves on to the younger one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def lookup(self, keys: set[str], learn) -> Callable[[str], bytes | None]:
        """A getter that knows all these keys; learn(missing) -> their values."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = set()
        for key in keys - young.keys():
            if key in old:
                young[key] = old[key]
            else:
                missing.add(key)
        if missing:
            young.update(learn(missing))
        return young.__getitem__


class Vocabulary:
    """Tokens of a rank file, the ranks of their pairs, and a cache of encoded matches."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.findall = regex.compile(pattern).findall
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte < 0).any():
            raise ValueError("the rank file lacks single bytes")
        self.forget()

    @cached_property
    def pair(self) -> dict[int, int]:
        """Pairs of tokens that join to a token, (left << 32 | right) -> rank; decoding does without."""
        out: dict[int, int] = {}
        get = self.rank.get
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    out[left << _SHIFT | right] = rank
        return out

    # one match ------------------------------------------------------------------

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match by a segment tree."""
        n = len(piece)
        tokens = [int(self.byte[b]) for b in piece]
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(1, (n - 1).bit_length())
        pair = self.pair.get
        tree = [_NONE] * (2 * size)

        def leaf(i: int) -> int:
            j = following[i]
            if j >= n:
                return _NONE
            rank = pair(tokens[i] << _SHIFT | tokens[j])
            return _NONE if rank is None else rank << _SHIFT | i

        for i in range(n):
            tree[size + i] = leaf(i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != _NONE:
            i, rank = tree[1] & 0xFFFFFFFF, tree[1] >> _SHIFT
            j = following[i]
            tokens[i], following[i] = rank, following[j]
            if following[i] < n:
                before[following[i]] = i
            put(j, _NONE)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(tokens[i])
            i = following[i]
        return out

    # many short matches -----------------------------------------------------------

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """An open hash table of the pairs that arrays of pairs are looked up in: keys and ranks."""
        keys = np.fromiter(self.pair.keys(), dtype=np.int64, count=len(self.pair))
        table = [-1] * (1 << HASH_BITS)
        places = []
        for key, at in zip(keys.tolist(), self._home(keys).tolist()):
            while table[at] >= 0:
                at = (at + 1) & _HASH_MASK
            table[at] = key
            places.append(at)
        ranks = np.zeros(1 << HASH_BITS, dtype=np.int64)
        ranks[places] = np.fromiter(self.pair.values(), dtype=np.int64, count=len(self.pair))
        return np.array(table, dtype=np.int64), ranks

    @staticmethod
    def _home(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def _pair_value(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Leaf values: rank and position, or _NONE; a right token of -1 is the end."""
        slot_key, slot_rank = self.slots
        keys = np.where(right >= 0, left << _SHIFT | right, 0)
        at = self._home(keys)
        found = slot_key[at]
        going = np.flatnonzero((found != keys) & (found >= 0))
        while len(going):
            at[going] = (at[going] + 1) & _HASH_MASK
            found[going] = slot_key[at[going]]
            going = going[(found[going] != keys[going]) & (found[going] >= 0)]
        return np.where((found == keys) & (right >= 0), slot_rank[at] << _SHIFT | position, _NONE)

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of matches of similar length, one tree per row, as int32 bytes."""
        rows, longest = len(pieces), max(map(len, pieces))
        size = 1 << max(1, (longest - 1).bit_length())
        lengths = np.array([len(p) for p in pieces])
        raw = np.zeros((rows, size), dtype=np.uint8)
        inside = np.arange(size) < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        # one more column that stands for the end (token -1)
        tokens = np.full((rows, size + 1), -1, dtype=np.int64)
        tokens[:, :size] = np.where(inside, self.byte[raw], -1)
        columns = np.arange(size)
        following = np.minimum(np.tile(columns + 1, (rows, 1)), lengths[:, None])
        following = np.concatenate([following, np.full((rows, 1), size)], axis=1)
        before = np.tile(np.arange(-1, size), (rows, 1))
        tokens[np.arange(rows), lengths] = -1
        tree = np.full((rows, 2 * size), _NONE, dtype=np.int64)
        right = np.take_along_axis(tokens, following[:, :size], axis=1)
        row, column = np.nonzero(inside)
        tree[row, size + column] = self._pair_value(tokens[row, column], right[row, column], column)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        active = np.flatnonzero(tree[:, 1] != _NONE)
        while len(active):
            root = tree[active, 1]
            i, rank = root & 0xFFFFFFFF, root >> _SHIFT
            j = following[active, i]
            after = following[active, j]
            tokens[active, i] = rank
            tokens[active, j] = -1
            following[active, i] = after
            before[active, after] = i
            left = before[active, i]
            has = left >= 0
            rows3 = np.concatenate([active, active[has], active])
            leaves = np.concatenate([i, left[has], j])
            values = np.concatenate([
                self._pair_value(np.concatenate([rank, tokens[active[has], left[has]]]),
                                 np.concatenate([tokens[active, after], rank[has]]), leaves[:len(i) + has.sum()]),
                np.full(len(active), _NONE)])
            self._put(tree, size, rows3, leaves, values)
            active = active[tree[active, 1] != _NONE]
        live = tokens[:, :size] >= 0
        flat = tokens[:, :size][live].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _put(tree: np.ndarray, size: int, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + size
        tree[rows, node] = value
        while size > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            size >>= 1

    # texts ------------------------------------------------------------------------

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of matches of the pattern, as int32 bytes."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        get = self.rank.get
        raws = [p.encode() for p in pieces]
        for i, raw in enumerate(raws):
            rank = get(raw)
            if rank is not None:
                out[i] = rank.to_bytes(4, sys.byteorder)
            elif len(raw) > SIDE_BY_SIDE:
                out[i] = array("i", self.merge(raw)).tobytes()
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append(i)
        for group in groups.values():
            for at in range(0, len(group), 4096):
                part = group[at:at + 4096]
                for i, ids in zip(part, self.merge_rows([raws[i] for i in part])):
                    out[i] = ids
        return out

    def forget(self) -> None:
        """Empty the caches: workers live on after a task, what they looked up need not."""
        self.pieces, self.words = Cache(PIECES), Cache(WORDS)

    def matches(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each cut by the pattern."""
        cut = [self.findall(t) for t in texts]
        get = self.pieces.lookup(set().union(*cut), lambda new: dict(zip(new, self._learn(list(new)))))
        return [b"".join(map(get, pieces)) for pieces in cut]

    def _follow(self, words: set[str]) -> dict[str, bytes | None]:
        """Ids of a space and a word; None where white space or nothing follows the space.

        A space with letters is one match, a run of punctuation after them the
        next one; any other word is cut by the pattern.
        """
        young, old = self.words.young, self.words.old
        out: dict[str, bytes | None] = dict.fromkeys(words)
        letters, ended, odd = set(), [], []
        for w in words:
            if w.isalpha():
                letters.add(w)
            elif (core := w.rstrip(string.punctuation)).isalpha():
                ended.append((w, core, w[len(core):]))
                if core not in young and core not in out:
                    if core in old:
                        out[core] = old[core]
                    else:
                        letters.add(core)
            elif w and not w[0].isspace():
                odd.append(w)
        out.update(zip(letters, self._learn([" " + w for w in letters])))
        ends = list({end for _, _, end in ended})
        marks = dict(zip(ends, self._learn(ends)))
        for w, core, end in ended:
            out[w] = (out[core] if core in out else young[core]) + marks[end]
        for at in range(0, len(odd), 1 << 15):
            part = odd[at:at + (1 << 15)]
            out.update(zip(part, self.matches([" " + w for w in part])))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as int32 bytes.

        No match of the pattern goes on over a space that a visible character
        follows: a new match starts at that space.  So words are looked up with
        their space; a text where a space meets other white space or an end is
        cut by the pattern as a whole.
        """
        cut = [t.split(" ") if t else [] for t in texts]
        get = self.words.lookup(set().union(*(c[1:] for c in cut)), self._follow)
        tails: list[bytes | None] = []
        for c in cut:
            try:
                tails.append(b"".join(map(get, c[1:])))
            except TypeError:
                tails.append(None)
        heads = self.matches([("" if not c else t if tail is None else c[0]) for t, c, tail in zip(texts, cut, tails)])
        return [head + (tail or b"") for head, tail in zip(heads, tails)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of these ids, one after the other."""
        n = self.length[ids]
        ends = np.cumsum(n)
        where = np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[where]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read once in every Python worker."""
    return Vocabulary(path, pattern)


def _schema(df: DataFrame, keep: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in more])


def _kept(batch: pa.RecordBatch, keep: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(c)) for c in keep]


def _binary(words: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Bytes of lists of ids (their values in a row, and their lengths)."""
    sizes = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(words.length[ids], out=sizes[1:])
    ends = np.concatenate(([0], sizes[np.cumsum(counts)])) if len(counts) else np.zeros(1, dtype=np.int64)
    raw = words.decode(ids)
    texts = pa.Array.from_buffers(pa.large_binary(), len(counts), [
        None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(raw))])
    return texts.cast(pa.binary())


def encode(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids",
           path: str | None = None, pattern: str | None = None, decoded: str | None = None) -> DataFrame:
    """The `keep` columns and the ids (array<int>) of every text.

    `decoded` names a column for the bytes that these ids decode to, made in the
    same worker: a proof of the round trip without a second pass.
    """
    default = default_ranks() if path is None or pattern is None else (path, pattern)
    path, pattern, columns = path or default[0], pattern or default[1], list(keep)
    more = [(out, T.ArrayType(T.IntegerType()))] + ([(decoded, T.BinaryType())] if decoded else [])
    names = [*columns, *(n for n, _ in more)]
    if len(set(names)) < len(names):
        raise ValueError("a new column has the name of one that is kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        words.forget()
        for block in blocks(batches, text_col):
            ids = words.encode(block.column(block.schema.get_field_index(text_col)).to_pylist())
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            new = [pa.ListArray.from_arrays(pa.array(offsets), flat)]
            if decoded:
                new.append(_binary(words, flat.to_numpy(), counts))
            yield pa.RecordBatch.from_arrays([*_kept(block, columns), *new], names=names)
        words.forget()

    source = df.select(*dict.fromkeys([*columns, text_col]))
    return source.mapInArrow(run, _schema(df, columns, *more))


def decode(df: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids"), out: str = "decoded",
           path: str | None = None) -> DataFrame:
    """The `keep` columns and the bytes of every list of ids; a null list gives no bytes."""
    default = default_ranks()
    path, pattern, columns = path or default[0], default[1], list(keep)
    if out in columns:
        raise ValueError(f"{out} is a column that is kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                lists = part.column(part.schema.get_field_index(ids_col))
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                texts = _binary(words, ids, counts)
                yield pa.RecordBatch.from_arrays([*_kept(part, columns), texts], names=[*columns, out])

    source = df.select(*dict.fromkeys([*columns, ids_col]))
    return source.mapInArrow(run, _schema(df, columns, (out, T.BinaryType())))
