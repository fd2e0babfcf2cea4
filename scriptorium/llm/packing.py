"""Order-preserving packing of documents into windows of tokens by dynamic programming.

Documents of a partition are one stream of ids, in the order of their rows, each
followed by an end id.  The stream is cut into windows of at most `window` ids.
Cuts lie at document ends, which cost nothing, or at sentence ends, which cost
SENTENCE; only a stretch of more than GAP ids without a sentence end can be cut
inside, every GAP ids, for INSIDE.  A window is padded to `window` ids unless its
length is a power of two.  The cuts minimise padding plus costs:

    f[j] = cost[j] + min( min over i with p[j] - p[i] <= window of  f[i] + window - (p[j] - p[i]),
                          f[i] for p[j] - p[i] a power of two )

The first minimum is that of f[i] + p[i] over a sliding range of cuts, kept in a
monotone queue, so a cut takes constant time on average; the second looks at the
few cuts that lie at such a distance.

How it runs.  A task encodes its rows and packs runs of at least RUN ids; cuts of
a run are the best ones for it, and its last window is opened again as the start of the next run,
so a run's end costs no padding and memory is bounded by RUN and the longest document.  In the
last window of a task every id is a possible cut, which lets it end in windows of
powers of two.  Nothing is shuffled: whoever wants documents in another order
sorts them before, and tables of very many small partitions are coalesced before.

Ids are those of the `tokenizers` library for the vocabulary file.  Where its merges
are numbered in their order, as here, the same ids come faster from `tiktoken` with
the ids as ranks, which tests compare; other files are left to `tokenizers`.

A sentence ends after an id of text that ends in a mark (. ! ? or their wide
forms, also before closing quotes) if white space follows or the mark is wide,
and after a line feed.

Defined cases: null and empty texts are one end id; repeated rows are packed
each; null ids pass through; long texts are encoded in parts that the encoder
would not join, and are cut like others; strings of special tokens are ordinary
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import blocks

WINDOW = 1_024
END = 0
SENTENCE = 4
INSIDE = 64
GAP = 128
RUN = 1 << 18
PART = 1 << 20

_CLOSING = "\"'”’»)]"
_MARKS, _WIDE = ".!?…", "。！？"
# between two characters that are no white space, a single space always opens a new piece of the encoder's pattern
_SEAM = re.compile(r"(?<=\S) (?=\S)")
_SPACES = re.compile(r"\s{1000}")


def default_vocabulary() -> tuple[str, str]:
    """Path of the vocabulary file, and the pattern of the pieces it is applied to."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes of each id, if merging by smallest id is merging in the order of the file."""
    vocab = model["vocab"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if made != sorted(made) or len(made) + 256 > len(vocab):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token)}


class Encoder:
    """Ids of texts, and which ids close and open sentences."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        strings = [self.tokenizer.decode([i], skip_special_tokens=False) for i in range(self.tokenizer.get_vocab_size())]
        bare = [s.rstrip(_CLOSING) for s in strings]
        self.closes = np.array([s.endswith(tuple(_MARKS)) for s in bare])
        self.ends = np.array([b.endswith(tuple(_WIDE)) or s.endswith("\n") for b, s in zip(bare, strings)])
        self.opens = np.array([s[:1].isspace() for s in strings])
        with open(path, encoding="utf-8") as file:
            ranks = _ranks(json.load(file)["model"])
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, part: str) -> np.ndarray:
        # the regular expressions of tiktoken give up on very long runs of white space
        if self.fast is not None and _SPACES.search(part) is None:
            return np.array(self.fast.encode_ordinary(part), dtype=np.uint32)
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for text in texts:
            parts = [self._ids(p) for p in _parts(text or "")]
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        return out

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places between two ids of a text where a sentence ends."""
        before, after = ids[:-1], ids[1:]
        return np.flatnonzero(self.ends[before] | (self.closes[before] & self.opens[after])) + 1


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of about PART characters that encode as they do in the whole text."""
    at = 0
    while len(text) - at > PART:
        seam = _SEAM.search(text, at + PART)
        if seam is None:
            break
        yield text[at:seam.start()]
        at = seam.start()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def choose(places: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the best windows: `places` are rising cuts from 0 to the end, at most `window` apart."""
    p, cost = places.tolist(), costs.tolist()
    n = len(p)
    whole: list[list[int]] = [[] for _ in range(n)]
    size = 1
    while size <= window:
        at = np.searchsorted(places, places - size)
        for j in np.flatnonzero(places[np.minimum(at, n - 1)] == places - size).tolist():
            whole[j].append(int(at[j]))
        size *= 2
    f, came = [0] * n, [0] * n
    queue: deque[int] = deque()
    for j in range(1, n):
        level = f[j - 1] + p[j - 1]
        while queue and f[queue[-1]] + p[queue[-1]] > level:
            queue.pop()
        queue.append(j - 1)
        while p[queue[0]] < p[j] - window:
            queue.popleft()
        i = queue[0]
        least, from_ = f[i] + p[i] + window - p[j], i
        for i in whole[j]:
            if f[i] < least:
                least, from_ = f[i], i
        f[j], came[j] = least + cost[j], from_
    ends, j = [], n - 1
    while j > 0:
        ends.append(p[j])
        j = came[j]
    return ends[::-1]


class Packer:
    """Windows of a stream of documents that are added one after another."""

    def __init__(self, encoder_: Encoder, window: int, end: int):
        self.encoder, self.window, self.end = encoder_, window, end
        # of each open piece of a document: id, ids of the document, first id's place in it, ids, sentence ends
        self.open: list[tuple] = []
        self.held, self.sequence = 0, 0

    def add(self, doc, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(self.end))
        inner = self.encoder.sentence_ends(ids)
        self.open.append((doc, len(ids), 0, ids, inner[inner < len(ids) - 1]))
        self.held += len(ids)

    def _cuts(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x[3]) for x in self.open])
        ends = np.cumsum(sizes)
        sentences = np.concatenate([x[4] + (e - n) for x, e, n in zip(self.open, ends, sizes)])
        cost = np.full(ends[-1] + 1, -1, dtype=np.int16)
        cost[sentences], cost[ends], cost[0] = SENTENCE, 0, 0
        known = np.flatnonzero(cost >= 0)
        for a in known[np.flatnonzero(np.diff(known) > GAP)].tolist():
            b = int(known[np.searchsorted(known, a) + 1])
            cost[a + GAP:b:GAP] = INSIDE
        if last:
            tail = cost[max(ends[-1] - self.window, 0):]
            tail[tail < 0] = INSIDE
        places = np.flatnonzero(cost >= 0)
        return places, cost[places]

    def take(self, last: bool) -> list[tuple]:
        """Pieces (doc, start, ids, doc_tokens, sequence, offset) of the windows that are settled."""
        if not self.open:
            return []
        windows = np.array(choose(*self._cuts(last), self.window))
        if not last:
            windows = windows[:-1]
        settled = int(windows[-1]) if len(windows) else 0
        out, rest, at, w = [], [], 0, 0
        starts = np.concatenate(([0], windows))
        for doc, total, start, ids, inner in self.open:
            here, end = at, at + len(ids)
            while here < min(end, settled):
                while windows[w] <= here:
                    w += 1
                until = min(end, int(windows[w]))
                out.append((doc, start + here - at, ids[here - at:until - at], total, self.sequence + w, here - int(starts[w])))
                here = until
            if here < end:
                left = inner[inner > here - at] - (here - at)
                rest.append((doc, total, start + here - at, ids[here - at:], left))
            at = end
        self.open, self.held, self.sequence = rest, sum(len(x[3]) for x in rest), self.sequence + len(windows)
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END,
         path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece: id, start (ids of the document before it), length, ids (little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id and offset in the sequence.

    Sequence ids are unique and rise within a partition in the order of the stream.
    """
    default = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or default[0], pattern or default[1]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = (f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, start bigint, length bigint, ids binary, "
              "doc_tokens bigint, sequence_id bigint, offset bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(encoder(path, pattern), window, end)
        first = TaskContext.get().partitionId() << 33
        kind = None

        def pieces(last: bool) -> pa.RecordBatch:
            found = packer.take(last)
            column = lambda i, add=0: pa.array([x[i] + add for x in found], pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], kind), column(1), pa.array([len(x[2]) for x in found], pa.int64()),
                 pa.array([x[2].astype("<u4").tobytes() for x in found], pa.binary()), column(3), column(4, first), column(5)],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for block in blocks(batches, "_text"):
            kind = block.schema.field("_id").type
            for doc, ids in zip(block.column("_id").to_pylist(), packer.encoder.encode(block.column("_text").to_pylist())):
                packer.add(doc, ids)
            if packer.held >= RUN:
                yield pieces(False)
        if kind is not None:
            yield pieces(True)

    return rows.mapInArrow(run, schema)
