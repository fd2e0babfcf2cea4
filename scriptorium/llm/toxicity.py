"""Toxicity of texts from their nearest labelled examples, by exact TF-IDF cosine.

Terms are runs of letters in lower case and their beginnings of BEGINNING bytes, known by
their 64-bit hashes; the space has all terms of the examples.  A text's vector has a term's
(1 + ln tf) * ln((1 + N) / (1 + df)) * tie, with df and N counted over all documents.
A term's tie is `floor`, plus how far its count in examples of label 1 lies more than
SIGMAS standard deviations above chance, over the largest such distance.  Where no
term lies that far all ties are `floor`, which is the plain cosine: the same rule at
every size, and `floor=1` makes it the plain one throughout.

Examples are found by a block-max inverted index.  Most postings belong to the FREQUENT
most common terms; these lie in blocks of BLOCK examples with the largest weight of each
term in each block.  The other terms' postings are short and are summed; what they give in a
block at most, with the maxima of the common terms, bounds a text's cosine with all examples of the block.  The FIRST blocks of largest bound give a
K-th best cosine; of the other blocks only those whose bound reaches it are opened.  What is skipped
can't be among the K nearest, so the search is exact (over weights of examples in single precision).  Ties go to the smaller id.
Examples with the very same text are no neighbours: a text never votes with its own
label, whether it is labelled or not.

The nearest examples vote by similarity, for and against; an isotonic fit on
labelled rows that are not in the index turns votes into probabilities, the
texts without a term of the space being one step of their own.  Without such rows
the vote itself is the score, 0 if negative.  The nearest examples are returned as
evidence.

Bounds.  The model is fitted on a sample of at most `sample` labelled rows with at most
`postings` distinct terms in sum (in order of a hash of their id): two thirds are examples, one
third calibrates.  So vocabulary, index and steps have at most `postings` entries of some ten
bytes, whatever the length of the texts; this is what reaches the driver and what is broadcast.
Everything else covers all rows and whole texts: df, N, and the scores.  With V distinct
terms in all documents, an accidental match of hashes has a chance of V * postings / 2**64.

Defined cases: null and empty texts have no terms and get the score of such
texts; repeated rows repeat; labels that repeat count once (1 wins); without
labelled rows the score is 0 and without rows the result is empty; other columns
of the documents and labels are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import saved
from .wordhash import U64, Words, blocks, give_back, mixed

SAMPLE = 15_000
POSTINGS = 6_000_000
SIGMAS = 2.5
BEGINNING = 5
FLOOR = 0.02
K = 15
BLOCK = 64
FREQUENT = 1_024
FIRST = 4
SLICE = 256
# postings of examples that are handled at once while the index is built
STEP = 500_000
# texts of a block, in bytes: some hundred of usual ones fill a slice; hashing takes some 30 bytes of memory a byte
BYTES = 1 << 19


class Counts:
    """Distinct terms of a block of texts with their counts: sorted hashes, one text after another."""

    def __init__(self, texts: pa.Array):
        letters = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\p{L}\p{M}]+", " ")
        words = Words(letters)
        long = np.flatnonzero(words.end - words.start >= BEGINNING)
        # beginnings, marked as such
        begin = mixed(words.prefix.ranges(words.start[long], words.start[long] + BEGINNING) + U64(BEGINNING))
        ends, more = words.first.tolist(), np.searchsorted(long, words.first).tolist()
        terms, counts, sizes = [], [], np.zeros(len(texts), dtype=np.int64)
        for i in range(len(texts)):
            found = np.concatenate((words.hash[ends[i]:ends[i + 1]], begin[more[i]:more[i + 1]]))
            found.sort()
            new = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            starts = np.flatnonzero(new)
            terms.append(found[starts])
            counts.append(np.diff(starts, append=len(found)))
            sizes[i] = len(starts)
        self.terms = np.concatenate(terms) if terms else np.zeros(0, dtype=U64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        self.sizes = sizes

    def known(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of text, number of term and count of all terms of a vocabulary (sorted hashes)."""
        at = np.minimum(np.searchsorted(vocabulary, self.terms), max(len(vocabulary) - 1, 0))
        hit = np.flatnonzero(vocabulary[at] == self.terms) if len(vocabulary) else np.zeros(0, dtype=np.int64)
        return np.repeat(np.arange(len(self.sizes)), self.sizes)[hit], at[hit], self.counts[hit]


def unit(text: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Weights of (text, term, count) rows in vectors of length 1."""
    w = (1 + np.log(tf.astype(np.float64))) * idf[term]
    norm = np.sqrt(np.bincount(text, w * w, n))[text]
    return np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)


def alike(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, dims: int = 128) -> np.ndarray:
    """An order of examples in which like ones are neighbours: halved again and again along their widest direction.

    Examples are known by sums of their weights, with signs by term, in `dims` places.
    """
    rng = np.random.default_rng(20)
    known = int(term.max(initial=0)) + 1
    slot, sign = rng.integers(0, dims, known), rng.choice([-1.0, 1.0], known)
    short = np.zeros(n * dims)
    for at in range(0, len(row), STEP):
        a, b = slice(at, at + STEP), term[at:at + STEP]
        short += np.bincount(row[a].astype(np.int64) * dims + slot[b], weight[a] * sign[b], n * dims)
    short = short.reshape(n, dims)
    out, parts = [], [np.arange(n)]
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            out.append(part)
            continue
        spread = short[part] - short[part].mean(axis=0)
        square, along = spread.T @ spread, rng.standard_normal(dims)
        for _ in range(20):
            along = square @ along
            along /= np.linalg.norm(along) + 1e-30
        part = part[np.argsort(spread @ along, kind="stable")]
        half = max(BLOCK, len(part) // 2 // BLOCK * BLOCK)
        parts += [part[half:], part[:half]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class BlockMaxIndex:
    """Labelled examples in blocks, with the largest weight of every term in each block."""

    def __init__(self, row, term, weight, labels: np.ndarray, ids: np.ndarray, copies: np.ndarray, terms: int):
        # examples of like content near one another make tight bounds
        n = len(labels)
        order = np.argsort(ids, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        order = order[alike(place[row], term, weight, n)]
        self.labels, self.ids, self.copies = labels[order], ids[order], copies[order]
        self.n_blocks = -(-n // BLOCK)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        row, weight = place.astype(np.int32)[row], weight.astype(np.float32, copy=False)
        common = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:FREQUENT]
        self.slot = np.full(terms, -1, dtype=np.int32)
        self.slot[common] = np.arange(len(common))
        slots = self.slot[term]
        mine = slots >= 0
        self.common = np.zeros((self.n_blocks, len(common), BLOCK), dtype=np.float32)
        self.common[row[mine] // BLOCK, slots[mine], row[mine] % BLOCK] = weight[mine]
        self.largest = self.common.max(axis=2).T.copy()
        # postings of the other terms
        term, row, weight = term[~mine], row[~mine], weight[~mine]
        by_term = np.lexsort((row, term))
        self.rows, self.weights = row[by_term], weight[by_term]
        self.bounds = np.searchsorted(term[by_term], np.arange(terms + 1))

    def nearest_of(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, copies: np.ndarray, k: int):
        """For each text the k examples of largest positive cosine: numbers and cosines.

        Rows (text, term, weight) are sorted by text; `copies` has a hash of each text.
        """
        out = []
        for at in range(0, len(copies), SLICE):
            a, b = np.searchsorted(text, (at, at + SLICE))
            out += self._slice(text[a:b] - at, term[a:b], weight[a:b], copies[at:at + SLICE], k)
        return out

    def _slice(self, text, term, weight, copies, k: int):
        n = len(copies)
        if not self.n_blocks:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0))] * n
        asked = np.zeros((n, self.common.shape[1]))
        slot = self.slot[term]
        dense = slot >= 0
        asked[text[dense], slot[dense]] = weight[dense]
        single = asked.astype(np.float32)
        text, term, weight = text[~dense], term[~dense], weight[~dense]
        rare = np.zeros((n, self.n_blocks * BLOCK))
        begin, stop = self.bounds[term], self.bounds[term + 1]
        ends = np.searchsorted(text, np.arange(n + 1)).tolist()
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            lists = list(zip(begin[a:b].tolist(), stop[a:b].tolist()))
            if lists:
                times = np.repeat(weight[a:b], stop[a:b] - begin[a:b])
                times *= np.concatenate([self.weights[x:y] for x, y in lists])
                rare[i] = np.bincount(np.concatenate([self.rows[x:y] for x, y in lists]), times, rare.shape[1])
        bound = single @ self.largest + rare.reshape(n, self.n_blocks, BLOCK).max(axis=2)
        sums = np.zeros((n, self.n_blocks, BLOCK))
        copy = np.zeros((n, self.n_blocks * BLOCK), dtype=bool)
        copy[:, :len(self.copies)] = self.copies == copies[:, None]

        def open_(visit: np.ndarray) -> None:
            for b in np.flatnonzero(visit.any(axis=0)):
                i = np.flatnonzero(visit[:, b])
                sums[i, b] = single[i] @ self.common[b] + rare[i, b * BLOCK:(b + 1) * BLOCK]

        def least(found: np.ndarray, hidden: np.ndarray) -> np.ndarray:
            return np.partition(np.where(hidden, 0, found), -k, axis=1)[:, -k] if found.shape[1] >= k else np.zeros(n)

        top = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        visit = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(visit, top, True, axis=1)
        open_(visit)
        some = (top[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(n, -1)
        first = least(np.take_along_axis(sums.reshape(n, -1), some, 1), np.take_along_axis(copy, some, 1))
        # 1e-4: sums in single precision differ in the last digits; what is close is summed again below
        open_((bound > 0) & (bound >= first[:, None] - 1e-4) & ~visit)
        sums = sums.reshape(n, -1)
        reached = np.maximum(first - 1e-4, 1e-12)
        near = (sums >= reached[:, None]) & ~copy
        out = []
        for i in range(n):
            found = np.flatnonzero(near[i])
            if len(found) > 4 * k:
                some = sums[i, found]
                found = found[some >= np.partition(some, -k)[-k] - 1e-4]
            used = np.flatnonzero(asked[i])
            weights = self.common[(found // BLOCK)[:, None], used, (found % BLOCK)[:, None]]
            cosines = rare[i, found] + weights.astype(np.float64) @ asked[i, used]
            order = np.lexsort((self.ids[found], -np.round(cosines, 9)))[:k]
            out.append((found[order], cosines[order]))
        return out


def vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    """From -1 to 1: similarities for label 1 less those against it, over all."""
    return float((cosines * (2 * labels - 1)).sum() / cosines.sum())


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (lower ends, probabilities) of the best rising fit, by pooling neighbours; a step ends halfway to the next vote."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y in zip(votes[order].tolist(), labels[order].tolist()):
        if pools and pools[-1][3] == v:
            pools[-1][1] += y
            pools[-1][2] += 1
        else:
            pools.append([v, y, 1, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, y1, n1, v1 = pools.pop()
            pools[-1][1] += y1
            pools[-1][2] += n1
            pools[-1][3] = v1
    ends = np.array([(p[0] + q[3]) / 2 for p, q in zip(pools, [pools[0], *pools[:-1]])]) if pools else np.zeros(0)
    if pools:
        ends[0] = pools[0][0]
    return ends, np.array([(p[1] + 0.1) / (p[2] + 1.0) for p in pools])


class Model:
    """Term weights, examples and steps: all bounded by the sample.

    counts: df and tie of each term of the vocabulary, and the number of documents.
    examples: labels, ids and text hashes, and the sizes, terms (rising) and counts of all of them, one after another.
    """

    def __init__(self, vocabulary, counts, examples, k):
        self.vocabulary, self.counts, self.examples, self.k = vocabulary, counts, examples, k
        self.ends, self.steps, self.empty = np.zeros(0), np.zeros(0), 0.1

    def __getstate__(self):
        (df, tie, n), (labels, ids, copies, sizes, term, tf) = self.counts, self.examples
        packed = [zlib.compress(x.tobytes(), 1) for x in (df, tie, np.diff(term, prepend=np.int32(0)), tf)]
        return packed, n, labels, ids, copies, sizes, tf.dtype, self.k

    def __setstate__(self, state):
        (df, tie, steps, tf), n, labels, ids, copies, sizes, kind, self.k = state
        read = lambda x, t: np.frombuffer(zlib.decompress(x), dtype=t)
        self.counts = read(df, np.int64), read(tie, np.float64), n
        self.examples = labels, ids, copies, sizes, np.cumsum(read(steps, np.int32), dtype=np.int32), read(tf, kind)

    @cached_property
    def idf(self) -> np.ndarray:
        df, tie, n = self.counts
        return (np.log((1 + n) / (1 + df)) + 1e-3) * tie

    @cached_property
    def index(self) -> BlockMaxIndex:
        labels, ids, copies, sizes, term, tf = self.examples
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        weight, ends = np.empty(len(term), dtype=np.float32), np.append(0, np.cumsum(sizes))
        step = max(1, STEP * len(sizes) // max(len(term), 1))
        for at in range(0, len(sizes), step):
            a, b = ends[at], ends[min(at + step, len(sizes))]
            weight[a:b] = unit(row[a:b] - at, term[a:b], tf[a:b], self.idf, min(step, len(sizes) - at))
        return BlockMaxIndex(row, term, weight, labels, ids, copies, len(self.idf))

    def nearest(self, counts: Counts, copies: np.ndarray):
        text, term, tf = counts.known(self.vocabulary)
        return self.index.nearest_of(text, term, unit(text, term, tf, self.idf, len(copies)), copies, self.k)

    def votes(self, texts: pa.Array):
        """Vote, nearest examples and cosines of each text; None for a text without terms."""
        return [(vote(self.index.labels[found], cosines), found, cosines) if len(found) else None
                for found, cosines in self.nearest(Counts(texts), text_hashes(texts))]

    def probability(self, value: float | None) -> float:
        if value is None:
            return self.empty
        if not len(self.ends):
            return max(value, 0.0)
        return float(self.steps[max(np.searchsorted(self.ends, value, side="right") - 1, 0)])


class Shared:
    """A model as tasks read it: vocabulary and examples are broadcast, which sends them to an executor once; steps are few."""

    def __init__(self, words=None, model=None, steps=None):
        self.words, self.model, self.steps = words, model, steps
        self.found = model is not None

    def __call__(self) -> Model | None:
        if not self.found:
            return None
        model = self.model.value
        model.vocabulary = self.words.value
        if self.steps is not None:
            model.ends, model.steps, model.empty = self.steps
        return model


def text_hashes(texts: pa.Array) -> np.ndarray:
    """A hash of each whole text as it is: of its bytes, taken as one word."""
    return Words(texts, whole=True).hash


def held_out(id_col: Column, part: int = 2, of: int = 4) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(of)) == part


def _document_frequencies(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        total = np.zeros(len(words), dtype=np.int64)
        for block in blocks(batches, "text"):
            total += np.bincount(Counts(block.column("text")).known(words)[1], minlength=len(words))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])
        give_back()
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and counts of sampled rows."""
    for block in blocks(batches, "text"):
        counts = Counts(block.column("text"))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts.sizes))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [block.column("id").cast(pa.int64()), block.column("toxic").cast(pa.int32()), block.column("h"),
             pa.array(text_hashes(block.column("text")).view(np.int64)), pa.array(counts.sizes),
             pa.ListArray.from_arrays(offsets, pa.array(counts.terms.view(np.int64))),
             pa.ListArray.from_arrays(offsets, pa.array(counts.counts.astype(np.int32)))],
            names=["id", "toxic", "h", "copy", "size", "terms", "tf"])


def ties(n: np.ndarray, positive: np.ndarray, share: float, floor: float = FLOOR) -> np.ndarray:
    """Weight of each term from its counts in all examples and in those of label 1."""
    above = np.maximum((positive - share * n) / np.sqrt(share * (1 - share) * n + 1) - SIGMAS, 0)
    return floor + above / max(above.max(initial=0), 1e-300)


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE, postings: int = POSTINGS, k: int = K, floor: float = FLOOR) -> Shared:
    """A model from labelled rows that are not held out; its value is None without any."""
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    drawn = known.filter(~held_out(F.col("id"))).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample)
    drawn = saved(drawn, "drawn")
    # the sample is bounded, so it goes to the texts and no text is shuffled
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    rows = saved(rows.select("id", "toxic", "h", "text").mapInArrow(
        _counted, "id bigint, toxic int, h bigint, copy bigint, size bigint, terms array<bigint>, tf array<int>"), "sample")
    # as many rows of the sample, in order, as hold `postings` terms; one task numbers them, narrow and bounded
    before = Window.orderBy("h", "id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    taken = rows.select("h", "id", "copy", "size").withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    taken = saved(taken.filter(F.col("before") < postings).select("h", "id", "copy").distinct(), "taken")
    rows = rows.join(F.broadcast(taken), ["h", "id", "copy"])
    example = F.pmod("h", F.lit(3)) > 0
    found = rows.filter(example).select("id", "toxic", "copy", "size", "terms", "tf").toArrow().sort_by([("id", "ascending"), ("copy", "ascending")])
    if not found.num_rows:
        return Shared()
    labels_, ids, copies, sizes = (found.column(c).to_numpy() for c in ("toxic", "id", "copy", "size"))
    terms, tf = _flat(found, "terms").view(U64), _flat(found, "tf")
    tf = tf.astype(np.min_scalar_type(int(tf.max(initial=0))))
    del found
    vocabulary, term = np.unique(terms, return_inverse=True)
    term = term.astype(np.int32)
    del terms
    n = np.bincount(term, minlength=len(vocabulary))
    positive = np.bincount(term, np.repeat(labels_, sizes), len(vocabulary))
    tie = ties(n, positive, labels_.mean(), floor)
    words = spark.sparkContext.broadcast(vocabulary)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_document_frequencies(words), "term bigint, df bigint").groupBy(
        "term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    model = Model(vocabulary, (df, tie, docs.count()), (labels_, ids, copies.view(U64), sizes, term, tf), k)
    model = spark.sparkContext.broadcast(model)
    judged = rows.filter(~example).select("toxic", "copy", "size", "terms", "tf").mapInArrow(
        _judged(Shared(words, model)), "toxic int, vote double").toArrow()
    truth, votes = judged.column("toxic").to_numpy(), judged.column("vote").to_numpy()
    none = np.isnan(votes)
    ends, steps = isotonic(votes[~none], truth[~none])
    return Shared(words, model, (ends, steps, (float(truth[none].sum()) + 0.1) / (int(none.sum()) + 1.0)))


def _judged(shared: Shared):
    """Label and vote (nan for texts without terms) of counted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            counts = Counts.__new__(Counts)
            counts.sizes = batch.column("size").to_numpy()
            counts.terms = batch.column("terms").flatten().to_numpy(zero_copy_only=False).view(U64)
            counts.counts = batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            found = model.nearest(counts, batch.column("copy").to_numpy().view(U64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"),
                 pa.array([vote(model.index.labels[f], c) if len(f) else np.nan for f, c in found], pa.float64())],
                names=["toxic", "vote"])
    return run


def clean(docs: DataFrame, shared: Shared, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    if not shared.found:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for block in blocks(batches, text_col, BYTES):
            found = model.votes(block.column(block.schema.get_field_index(text_col)))
            yield block.filter(pa.array([model.probability(f[0] if f else None) < threshold for f in found], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, shared: Shared, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, score, and evidence: the nearest examples with similarity and label."""
    kept = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + ["score double", "evidence array<struct<id:bigint,similarity:double,label:int>>"])
    columns = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for block in blocks(batches, text_col, BYTES):
            texts = block.column(block.schema.get_field_index(text_col))
            found = model.votes(texts) if model else [None] * len(texts)
            scores = [model.probability(f[0] if f else None) if model else 0.0 for f in found]
            near = np.concatenate([np.zeros(0, dtype=np.int64), *[f[1] for f in found if f]])
            cosines = np.concatenate([np.zeros(0), *[f[2] for f in found if f]])
            ids, labels = (model.index.ids[near], model.index.labels[near]) if model else (near, near)
            each = pa.StructArray.from_arrays([pa.array(ids.astype(np.int64)), pa.array(cosines), pa.array(labels.astype(np.int32))],
                                              names=["id", "similarity", "label"])
            ends = np.cumsum([0, *[len(f[1]) if f else 0 for f in found]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[block.column(block.schema.get_field_index(c)) for c in columns], pa.array(scores, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(ends), each)], names=[*columns, "score", "evidence"])
        give_back()

    return docs.select(*dict.fromkeys([*columns, text_col])).mapInArrow(run, schema)
