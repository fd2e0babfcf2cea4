"""Token counts of the sections of a text, from one encoding of the whole text.

A document is encoded once; its sections are not encoded on their own, since
tokens at their borders would then come out differently.  Every token has a byte
span in the text; spans are joined to the sections' spans by interval (both are
sorted, so a search in the section starts finds the sections of a token), and a
token that crosses a border is given out by an explicit rule:

  start    to the section of its first byte (the default),
  largest  to the section that holds most of its bytes, the earlier one on ties,
  split    to every section it touches, by its share of the token's bytes.

The counts of a document's sections add up to its tokens under every rule, as
bytes outside all sections are a section of their own (section -1).

Defined cases: a null or empty text has no tokens, and its sections none; a null
or empty list of sections leaves all tokens to section -1; repeated rows repeat;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import default_ranks, vocabulary
from .wordhash import blocks

RULES = ("start", "largest", "split")
_OUT = ("{id}, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint, share double")


def _byte_bounds(raw: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Byte offset of each character offset; offsets beyond the text are its end."""
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    leads = np.append(leads, len(raw))
    return leads[np.clip(chars, 0, len(leads) - 1)]


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str):
    """Sections (sorted, not overlapping, in bytes) and tokens (by their ends) of one text.

    Returns per section, with one more at the end for bytes outside: tokens
    given, border-crossing tokens touching it, and fractional tokens.
    """
    n = len(starts)
    token_starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    # the sections and the gaps between them as one row of segments
    edges = np.empty(2 * n + 1, dtype=np.int64)
    edges[0], edges[1::2], edges[2::2] = 0, starts, ends
    owner = np.full(2 * n + 1, n, dtype=np.int64)
    owner[1::2] = np.arange(n)
    filled = np.append(edges[1:], np.iinfo(np.int64).max) > edges
    edges, owner = edges[filled], owner[filled]
    first = np.searchsorted(edges, token_starts, side="right") - 1
    last = np.searchsorted(edges, token_ends - 1, side="right") - 1
    counts = np.bincount(owner[first[first == last]], minlength=n + 1).astype(np.int64)
    share = counts.astype(np.float64)
    crossing = np.zeros(n + 1, dtype=np.int64)
    for t in np.flatnonzero(first != last):
        segments = np.arange(first[t], last[t] + 1)
        cuts = np.concatenate(([token_starts[t]], edges[segments[1:]], [token_ends[t]]))
        held = np.bincount(owner[segments], weights=np.diff(cuts), minlength=n + 1)
        touched = np.flatnonzero(held)
        crossing[touched] += len(touched) > 1
        share[touched] += held[touched] / (token_ends[t] - token_starts[t])
        if rule == "largest":
            inside = touched[np.argsort(np.where(touched == n, -1, touched), kind="stable")]
            counts[inside[np.argmax(held[inside])]] += 1
        else:
            counts[owner[first[t]]] += 1
    return counts, crossing, share


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Column | None = None,
                   rule: str = "start", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per section: id, section (from 0; -1 outside), start, end, n_tokens, n_crossing, share.

    `sections` is an array of (start, end) in characters, sorted and without
    overlaps; by default the lines of the text.  n_tokens follows `rule` (under
    "split" it counts tokens by their start), share is always fractional.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    default = default_ranks() if path is None or pattern is None else (path, pattern)
    path, pattern = path or default[0], pattern or default[1]
    own = sections is not None
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       *([sections.alias("_sections")] if own else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for block in blocks(batches, "_text"):
            texts = block.column("_text").to_pylist()
            encoded = words.encode(texts)
            given = block.column("_sections").to_pylist() if own else None
            out: list[list] = [[] for _ in range(6)]
            row = []
            for i, (text, ids) in enumerate(zip(texts, encoded)):
                raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
                ends = np.cumsum(words.length[np.frombuffer(ids, dtype=np.int32)])
                if own:
                    spans = np.array([(s["start"], s["end"]) for s in given[i] or []], dtype=np.int64).reshape(-1, 2)
                    a, b = _byte_bounds(raw, spans[:, 0]), _byte_bounds(raw, spans[:, 1])
                else:
                    feeds = np.flatnonzero(raw == 10) + 1
                    a, b = np.concatenate(([0], feeds)), np.append(feeds, len(raw))
                    is_lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    spans = np.stack([is_lead[a], is_lead[b]], axis=1)
                counts, crossing, share = attribute(ends, a, b, rule)
                n = len(a) + bool(counts[-1] or crossing[-1] or share[-1])
                row.append(np.full(n, i))
                number = np.arange(n)
                number[len(a):] = -1
                pad = np.full((n - len(a), 2), -1)
                for part, values in zip(out, (number, *np.concatenate([spans, pad]).T, counts[:n], crossing[:n], share[:n])):
                    part.append(values)
            if row:
                columns = [np.concatenate(p) for p in out]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [block.column("_id").take(pa.array(np.concatenate(row))),
                     *[pa.array(c).cast(k) for c, k in zip(columns, kinds)]],
                    names=[id_col, "section", "start", "end", "n_tokens", "n_crossing", "share"])
        words.forget()

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, _OUT.format(id=f"`{id_col}` {kind}"))
