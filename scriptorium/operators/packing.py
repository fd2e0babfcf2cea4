"""Chapters -> chunks: greedy packing, semantic segments, sliding windows.

The rules are sequential, so they are folds over the units of one chapter,
written with higher-order functions: parallel by document, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import let, strip
from ..functions.vectors import add_hashed_similarity, dot
from .segmentation import join_fragments, split_chapters, split_sentences

_STRINGS = "array<string>"
# similarities are compared after rounding, so equal ones stay equal
SIM_DIGITS = 12


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _fold(units: Column, base: int, hard_max: int, tail: int) -> Column:
    """Pack units struct<text, pieces>; `pieces` is set for an oversize unit."""
    start = F.struct(_none().alias("done"), F.lit("").alias("buf"))

    def state(done, buf):
        return F.struct(done.alias("done"), buf.alias("buf"))

    def flushed(s):
        return F.when(s.buf == "", s.done).otherwise(F.array_append(s.done, s.buf))

    def step(s, u):
        held = F.length(s.buf)
        merged = held + F.length(u.text)
        fits = (merged <= base) | ((merged <= hard_max) & (F.abs(merged - base) <= F.abs(held - base)))
        return (
            F.when(u.pieces.isNotNull(), state(F.concat(flushed(s), u.pieces), F.lit("")))
            .when((s.buf == "") | fits, state(s.done, F.concat(s.buf, u.text)))
            .otherwise(state(F.array_append(s.done, s.buf), u.text)))

    def finish(s):
        n = F.size(s.done)
        last = F.get(s.done, n - 1)
        joins = (n > 0) & (F.length(s.buf) < tail) & (F.length(last) + F.length(s.buf) <= hard_max)
        return (
            F.when(s.buf == "", s.done)
            .when(joins, F.array_append(F.slice(s.done, 1, n - 1), F.concat(last, s.buf)))
            .otherwise(F.array_append(s.done, s.buf)))

    return F.aggregate(units, start, step, finish)


def _as_units(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(None).cast(_STRINGS).alias("pieces")))


def _oversize_pieces(text: Column, base: int, hard_max: int, tail: int) -> Column:
    """Sentences of a long unit, the longest cut hard, packed one level down."""
    def cut(s):
        n = F.length(s)
        parts = F.transform(F.sequence(F.lit(1), n, F.lit(base)), lambda i: s.substr(i, F.lit(base)))
        return F.when(n > hard_max, parts).otherwise(F.array(s))

    sentences = F.flatten(F.transform(split_sentences(text), cut))
    return let(sentences, lambda x: F.when(F.size(x) <= 1, x).otherwise(_fold(_as_units(x), base, hard_max, tail)))


def pack_greedy(units: Column, base: int = rules.CHUNK_BASE, hard_max: int = rules.CHUNK_MAX,
                tail: int = rules.CHUNK_MIN_TAIL) -> Column:
    """Array of non-blank units -> array of chunks of about `base` characters."""
    prepared = F.transform(units, lambda u: F.struct(
        u.alias("text"),
        F.when(F.length(u) > hard_max, _oversize_pieces(u, base, hard_max, tail)).alias("pieces")))
    return _fold(prepared, base, hard_max, tail)


def paragraph_units(paras: Column) -> Column:
    return F.filter(F.transform(paras, strip), lambda p: p != "")


# --- semantic segments ------------------------------------------------------

def adjacent_similarity(vectors: Column) -> Column:
    """Dot product of each unit vector with the next; a missing vector gives 0."""
    def compare(vs):
        heads = F.slice(vs, 1, F.greatest(F.size(vs) - 1, F.lit(0)))
        return F.zip_with(heads, F.slice(vs, 2, F.size(vs)), lambda v, w: F.round(
            F.coalesce(dot(v, w), F.lit(0.0)), SIM_DIGITS))
    return let(vectors, compare)


def _threshold(sims: Column) -> Column:
    """Mean minus population deviation, rounded like the similarities."""
    def spread(m, values):
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(values))
    return let(F.aggregate(sims, F.lit(0.0), lambda a, x: a + x) / F.size(sims),
               lambda m: F.round(m - spread(m, sims), SIM_DIGITS))


def segment_bounds(similarities: Column, least: int = rules.SEGMENT_MIN, most: int = rules.SEGMENT_MAX) -> Column:
    """Ends of the semantic segments over size(similarities) + 1 sentences."""
    ints = F.array().cast("array<int>")

    def bounds(sims, threshold):
        def valley(s, x):
            here = x.i + 1
            cut = (x.sim < threshold) & (here - s.last >= least)
            return F.when(cut, F.struct(here.alias("last"), F.array_append(s.ends, here).alias("ends"))).otherwise(s)

        indexed = F.transform(sims, lambda v, i: F.struct(v.alias("sim"), i.alias("i")))
        valleys = F.aggregate(indexed, F.struct(F.lit(0).alias("last"), ints.alias("ends")), valley, lambda s: s.ends)

        def run(s, b):
            # a run of b - last sentences needs fewer cuts than this
            tries = F.sequence(F.lit(1), F.floor((b - s.last) / least).cast("int") + 1)

            def force(t, _):
                window = F.slice(sims, t.last + least, most - least + 1)
                at = let(window, lambda w: F.array_position(w, F.array_min(w)).cast("int"))
                # NULL when the window is empty: nothing is left to cut
                cut = F.when(b - t.last > most, t.last + least - 1 + F.nullif(at, F.lit(0)))
                return let(cut, lambda c: F.when(c.isNotNull(), F.struct(
                    c.alias("last"), F.array_append(t.ends, c).alias("ends"))).otherwise(t))

            forced = F.aggregate(tries, s, force)
            return F.struct(b.alias("last"), F.array_append(forced.ends, b).alias("ends"))

        every = F.array_append(valleys, F.size(sims) + 1)
        return F.aggregate(every, F.struct(F.lit(0).alias("last"), ints.alias("ends")), run, lambda s: s.ends)

    return let(similarities, lambda sims: let(_threshold(sims), lambda limit: bounds(sims, limit)))


def segments(sentences: Column, bounds: Column) -> Column:
    """Sentences joined between consecutive bounds."""
    def joined(texts, ends):
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        pieces = F.zip_with(starts, ends, lambda a, b: F.array_join(
            F.slice(texts, a + 1, F.greatest(b - a, F.lit(0))), ""))
        return F.filter(pieces, lambda t: t != "")
    return let(sentences, lambda texts: let(bounds, lambda ends: joined(texts, ends)))


def semantic_units(sentences: Column, similarities: Column) -> Column:
    """Segments of a chapter; its sentences themselves when there are fewer than six."""
    return F.when(F.size(sentences) < rules.SEGMENT_MIN * 2, sentences).otherwise(
        segments(sentences, segment_bounds(F.transform(similarities, lambda v: F.round(v, SIM_DIGITS)))))


def segment_semantic(chapters: DataFrame, sentences: str = "sentences", vectors: str | None = None,
                     base: int = rules.CHUNK_BASE) -> DataFrame:
    """Add chunks for chapter rows that carry a sentence array.

    `vectors` names a column of unit vectors, one per sentence; without it the
    hashing encoder is used.  Fewer than six sentences are packed directly.
    """
    if vectors is None:
        staged = add_hashed_similarity(chapters, F.array(F.col(sentences)), "_sims")
        sims = F.get("_sims", F.lit(0))
    else:
        staged, sims = chapters, adjacent_similarity(F.col(vectors))
    units = semantic_units(F.col(sentences), sims)
    return staged.withColumn("chunks", pack_greedy(units, base)).select(*chapters.columns, "chunks")


# --- windows and whole papers -----------------------------------------------

def sliding_chunks(text: Column, size: int = rules.WINDOW_SIZE, overlap: int = rules.WINDOW_OVERLAP) -> Column:
    """array<struct<chunk_index, offset_start, chunk_text>> of fixed windows."""
    if size <= 0:
        raise ValueError("size must be positive")
    if overlap < 0 or overlap >= size:
        overlap = max(0, min(overlap, size - 1))

    def windows(t):
        n = F.length(t)
        starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(n > 0, F.transform(starts, lambda p, i: F.struct(
            i.alias("chunk_index"), p.alias("offset_start"), t.substr(p + 1, F.lit(size)).alias("chunk_text"))))

    return let(text, windows)


CHUNK_COLUMNS = ("chunk_id", "paper_id", "chunk_index", "paragraph_index", "offset_start", "chunk_text",
                 "chapter_title", "chapter_index", "section_role", "tag_confidence", "split_method")


def chunk_papers(docs: DataFrame, method: str = "semantic", vectors: str | None = None,
                 base: int = rules.CHUNK_BASE) -> DataFrame:
    """docs(paper_id, paras) -> chunks with running index and offset per paper.

    method: semantic, greedy or legacy (fixed windows over the paragraphs
    joined by blank lines).  `vectors` may name array<array<array<..>>>: one
    list of sentence vectors per chapter, as written by embed_sentences.
    """
    if method == "legacy":
        full = docs.select("paper_id", F.array_join("paras", "\n\n").alias("_full"))
        rows = full.select("paper_id", F.explode(sliding_chunks(F.col("_full"))).alias("c"))
        return rows.select(
            F.concat_ws("::", "paper_id", F.col("c.chunk_index").cast("string")).alias("chunk_id"), "paper_id",
            "c.chunk_index", F.lit(-1).alias("paragraph_index"), "c.offset_start", "c.chunk_text",
            F.lit("").alias("chapter_title"), F.lit(-1).alias("chapter_index"), F.lit("").alias("section_role"),
            F.lit("").alias("tag_confidence"), F.lit("legacy_window").alias("split_method"))
    chaptered = split_chapters(docs)
    if method == "greedy":
        packed = chaptered.withColumn("_texts", F.transform(
            "chapters", lambda c: pack_greedy(paragraph_units(c.paras), base)))
        label = "length_greedy"
    elif method == "semantic":
        packed = _semantic_texts(chaptered, vectors, base)
        label = "semantic_boundary"
    else:
        raise ValueError(f"unknown method {method}")
    pieces = packed.withColumn("_pieces", F.flatten(F.zip_with("chapters", "_texts", lambda c, texts: F.transform(
        texts, lambda t: F.struct(
            strip(t).alias("text"), c.title.alias("title"), c.chapter_index.alias("chapter_index"),
            c.section_role.alias("role"), c.tag_confidence.alias("confidence"))))))
    pieces = pieces.withColumn("_pieces", F.filter("_pieces", lambda p: p.text != ""))
    # running length of the chunks before each one
    offsets = F.aggregate(
        F.transform("_pieces", lambda p: F.length(p.text)),
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("at")),
        lambda s, n: F.struct((s.sum + n).alias("sum"), F.array_append(s.at, s.sum).alias("at")),
        lambda s: s.at)
    rows = pieces.withColumn("_offsets", offsets).select(
        "paper_id", F.posexplode(F.arrays_zip(F.col("_pieces").alias("p"), F.col("_offsets").alias("o"))))
    piece = F.col("col.p")
    return rows.select(
        F.concat_ws("::", "paper_id", F.col("pos").cast("string")).alias("chunk_id"), "paper_id",
        F.col("pos").alias("chunk_index"), F.lit(-1).alias("paragraph_index"), F.col("col.o").alias("offset_start"),
        piece["text"].alias("chunk_text"), piece["title"].alias("chapter_title"),
        piece["chapter_index"].alias("chapter_index"), piece["role"].alias("section_role"),
        piece["confidence"].alias("tag_confidence"), F.lit(label).alias("split_method"))


def chapter_sentences(chapters: Column) -> Column:
    """One sentence array per chapter."""
    return F.transform(chapters, lambda c: split_sentences(join_fragments(c.paras)))


def _semantic_texts(chaptered: DataFrame, vectors: str | None, base: int) -> DataFrame:
    """Semantic chunks of every chapter, as nested arrays in the document row."""
    staged = chaptered.withColumn("_sents", chapter_sentences(F.col("chapters")))
    if vectors is None:
        staged = add_hashed_similarity(staged, F.col("_sents"), "_sims")
    else:
        staged = staged.withColumn("_sims", F.transform(F.col(vectors), lambda v: adjacent_similarity(v)))
    return staged.withColumn("_texts", F.zip_with(
        "_sents", "_sims", lambda s, v: pack_greedy(semantic_units(s, v), base)))
