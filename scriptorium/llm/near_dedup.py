"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A document's set are its distinct SHINGLE-word shingles (A-Z lower-cased; a
shorter text is one shingle; a text without words has an empty set and no
links).  Documents of Jaccard similarity >= threshold are linked; a document's
component is the smallest id reachable over links.

Method.  A signature holds CHUNKS x CHUNK codes of b = 16 bits, each the low
bits of one minimum of the set under one hash function; the distance of two
signatures is the number of codes that differ.  By the pigeonhole principle two
signatures with at most CHUNKS * (ERRORS + 1) - 1 = 23 differing codes have a
chunk with at most ERRORS = 1 of them, so all ways to erase one code of a chunk
are enumerated, and such pairs share a chunk and what is left of it: no pair
within that distance is lost.  A pair of similarity s shares a key with
probability 1 - (1 - s**5 - 5 * s**4 * (1 - s))**12; at s = 0.8 it misses one
pair in ten million, above it fewer.  Every link is confirmed on the full sets.

Copies and hot keys.  Documents of equal sets are one class with one
representative.  Representatives of one key are not paired with each other:
each is compared with the key's smallest member, the pivot.  Components are
found over these links; only keys whose members still are in several components
go on.  Of these, members that share too few of their shingles with other
components to have a link there drop out (most near copies with edits of their
own do, however many there are).  What is left is cut into groups that hang
together by keys, groups into blocks, and pairs of blocks are compared on full
sets by an inverted index inside a task of bounded size, which returns no more
links than connect what it holds.  So links are never expanded into pairs, and
none between components is missed.

Defined cases: rows without an id come after all others and are told apart by
their text, and form components of their own id class; repeated rows repeat in
the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected
from .store import SURROGATE, saved, surrogate_id
from .wordhash import Words, runs_of, blocks, give_back, grams, mixed

SHINGLE = 5
# members of a block that is compared with another one in a task
BLOCK_ROWS = 2_000
# ids of texts that are sent to every task at most, at some 64 bytes each; for more of them the texts are shuffled
SENT_IDS = 4_000_000
CHUNKS = 12
CHUNK = 5
ERRORS = 1
CODES = CHUNKS * CHUNK
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
_SETS = ("doc_id bigint, id bigint, d1 bigint, d2 bigint, n_shingles bigint, keys array<bigint>")
U64 = np.uint64

_rng = np.random.default_rng(77_003)
_XOR = _rng.integers(1, 2**63, CODES, dtype=np.int64).astype(U64)
_MUL = _rng.integers(1, 2**63, CODES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_MIX = _rng.integers(1, 2**63, (CHUNKS, CHUNK, CHUNK), dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_sets(words: Words, size: int):
    """Distinct shingle hashes of each text, in order: values, and the first index per text (with the end)."""
    n = len(words.counts)
    counts = words.counts
    h = grams(words.hash, size)
    text = np.repeat(np.arange(n), counts)
    start = np.flatnonzero(np.arange(len(words.hash)) + size <= words.first[text + 1]) if len(text) else text
    values, owner = h[start], text[start]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = [mixed(np.array([_fold(words.hash[words.first[i]:words.first[i + 1]])], dtype=U64))[0] for i in short]
        values, owner = np.concatenate([values, np.array(whole, dtype=U64)]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = runs_of(values, owner)
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n + 1))


def _fold(hashes: np.ndarray) -> int:
    out = len(hashes)
    for x in hashes.tolist():
        out = (out * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
    return out


def _sets(size: int):
    """Per text: digest and size of its set, and its keys (one per chunk and erased code)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, first = shingle_sets(Words(block.column("text"), lower=True), size)
            n = np.diff(first)
            d1 = _summed(mixed(values ^ U64(0x5851F42D4C957F2D)), first)
            d2 = _summed(mixed(values * U64(3)), first)
            has = np.flatnonzero(n)
            keys = [None] * len(n)
            if len(has):
                found = signatures(values, np.append(first[has], len(values)))
                for i, k in zip(has.tolist(), _keys(found).view(np.int64)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("id"), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                 pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "id", "d1", "d2", "n_shingles", "keys"])
        give_back()
    return run


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Codes of every non-empty set: one row of CODES 16-bit codes each."""
    codes = np.empty((len(first) - 1, CODES), dtype=np.uint16)
    for j in range(CODES):
        least = np.minimum.reduceat((values ^ _XOR[j]) * _MUL[j], first[:-1])
        codes[:, j] = (mixed(least) & U64(0xFFFF)).astype(np.uint16)
    return codes


def _keys(codes: np.ndarray) -> np.ndarray:
    """What is left of every chunk after erasing one code, as a 64-bit key per chunk and erased code."""
    chunks = codes.astype(U64).reshape(-1, CHUNKS, CHUNK) + U64(1)
    keys = np.empty(chunks.shape, dtype=U64)
    for erased in range(CHUNK):
        kept = [i for i in range(CHUNK) if i != erased]
        keys[:, :, erased] = mixed((chunks[:, :, kept] * _MIX[:, erased][:, kept]).sum(axis=2, dtype=U64))
    return keys.reshape(len(codes), -1)


def _linked(size: int, percent: int):
    """Rows (a, b, text_a, text_b) -> confirmed pairs: the full sets are compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text_a"):
            sets = []
            for name in ("text_a", "text_b"):
                values, first = shingle_sets(Words(block.column(name), lower=True), size)
                sets.append([values[i:j] for i, j in zip(first[:-1], first[1:])])
            keep = []
            for x, y in zip(*sets):
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([block.column("a").filter(mask), block.column("b").filter(mask)],
                                             names=["a", "b"])
    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return saved(rows.mapInArrow(_linked(size, percent), "a bigint, b bigint"), "links")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own, text = F.col(id_col).cast("bigint"), F.col(text_col)
    return docs.select(own.alias("doc_id"), F.coalesce(own, surrogate_id(text)).alias("id"), text.alias("text"))


def _assigned(plain: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, id, n_shingles, component of every row."""
    sets = saved(plain.mapInArrow(_sets(size), _SETS), "sets")
    # one representative per distinct set
    classes = sets.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    reps = classes.select(F.col("rep").alias("id"))
    labels = _components(plain.select("id", "text"), sets.select("id", "keys"), reps, size, percent)
    by_class = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component"))
    # copies of one set can be a third of all rows: adaptive execution splits such a class, its other side is one row
    return sets.select("doc_id", "id", "d1", "d2", "n_shingles").join(by_class, ["d1", "d2"], "left").select(
        "doc_id", "id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; `percent` is 100 x the Jaccard threshold."""
    out = _assigned(_plain(docs, id_col, text_col), size, percent)
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("component") < SURROGATE, F.col("component")).alias("component_id"),
        (F.col("component") == F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                percent: int = 80) -> DataFrame:
    """One row of every component, with all its columns: that of the smallest id; repeated rows of an id count once."""
    kept = _assigned(_plain(docs, id_col, text_col), size, percent).filter(F.col("component") == F.col("id"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), surrogate_id(F.col(text_col))).alias("id"),
                       F.struct("*").alias("row"))
    return rows.join(kept.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).select("row.*")


def _components(texts: DataFrame, sets: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """id, component of the representatives that have a link."""
    mine = sets.join(reps, "id", "left_semi").dropDuplicates(["id"])
    keyed = mine.select("id", F.explode("keys").alias("key"))
    # keys are shuffled once: members of a key and its smallest member meet in the same sort
    own = Window.partitionBy("key")
    company = keyed.withColumns({"pivot": F.min("id").over(own), "other": F.max("id").over(own)}).filter("pivot <> other")
    buckets = saved(company.select("key", "id", "pivot"), "buckets")
    stars = saved(buckets.filter("id <> pivot").groupBy(F.col("id").alias("a"), F.col("pivot").alias("b"))
                  .agg(F.count("*").alias("shared")), "stars")
    # every member of a key with company is an end of a star: only these texts are read again
    ends = saved(stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct(), "ends")
    # these are few of all texts, so the ids go to the texts and only what is found is shuffled
    wanted = F.broadcast(ends) if ends.count() <= SENT_IDS else ends
    texts = saved(texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "texts")
    # first the pivot with which a member shares most keys, then other pivots that are still in another component
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    edges = _confirmed(best, texts, size, percent)
    labels = connected(edges)
    rest = _across(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    edges = edges.unionByName(_confirmed(rest, texts, size, percent))
    labels = connected(edges)
    # keys whose members are in several components still
    members = _labelled(buckets.select("key", "id"), labels)
    open_keys = members.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    members = saved(members.join(open_keys.filter("least <> most").select("key"), "key"), "open")
    if members.isEmpty():
        return labels
    members = saved(_hopeful(members, texts, size, percent), "hopeful")
    more = _compared(members, texts, size, percent)
    return labels if more.isEmpty() else connected(edges.unionByName(more))


def _compared(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components among members whose keys hang together, compared block by block."""
    pivots = members.groupBy("key").agg(F.min("id").alias("pivot"))
    chains = members.join(pivots, "key").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    groups = connected(chains).withColumnRenamed("component", "group")
    rows = members.select("id", "component").distinct().join(groups, "id")
    # a group of m members has m / BLOCK_ROWS blocks; each pair of blocks is one task of bounded size
    blocks_of = rows.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = rows.join(blocks_of, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "component", "group", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.join(texts, "id").select("group", "i", "j", "block", "id", "component", "text")
    return saved(dealt.groupBy("group", "i", "j").applyInArrow(_block_links(size, percent), "a bigint, b bigint"), "links")


def _block_links(size: int, percent: int):
    """Members of two blocks of a group (or of one) -> links that connect the components they connect."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, parts = table.column("id").to_numpy(), table.column("component").to_numpy()
        block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
        values, first = shingle_sets(Words(table.column("text").combine_chunks(), lower=True), size)
        n = np.diff(first)
        owner = np.repeat(np.arange(len(ids)), n)
        right = np.flatnonzero(block == j[0])
        is_right = np.zeros(len(ids), dtype=bool)
        is_right[right] = True
        # postings of the right block
        held = is_right[owner]
        order = np.argsort(values[held], kind="stable")
        keys, rows = values[held][order], owner[held][order]
        root = {p: p for p in np.unique(parts).tolist()}

        def find(p):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        links = []
        for x in np.flatnonzero(block == i[0]).tolist():
            mine = values[first[x]:first[x + 1]]
            begin = np.searchsorted(keys, mine)
            count = np.searchsorted(keys, mine, side="right") - begin
            stop = np.cumsum(count)
            where = np.repeat(begin - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)
            both = np.bincount(rows[where], minlength=len(ids))
            near = np.flatnonzero((both > 0) & (100 * both >= percent * (n[x] + n - both)) & (parts != parts[x]))
            for y in near.tolist():
                p, q = find(int(parts[x])), find(int(parts[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})
    return run


def _shingles_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, first = shingle_sets(Words(block.column("text"), lower=True), size)
            owner = pa.array(np.repeat(np.arange(len(first) - 1), np.diff(first)))
            yield pa.RecordBatch.from_arrays(
                [block.column("id").take(owner), block.column("component").take(owner), pa.array(values.view(np.int64))],
                names=["id", "component", "shingle"])
    return run


def _hopeful(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Members that can have a link to another component, with n (set size) and shared.

    `shared` counts a member's shingles that occur in other components' members
    as well.  A link needs percent of n in common, so a member with fewer shared
    shingles has none: near copies with many edits of their own drop out here,
    before any pair of them is looked at.
    """
    ids = members.select("id", "component").distinct()
    rows = texts.join(ids, "id").select("id", "component", "text").mapInArrow(
        _shingles_of(size), "id bigint, component bigint, shingle bigint")
    common = rows.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    common = common.filter("least <> most").select("shingle", F.lit(1).alias("met"))
    counts = rows.join(common, "shingle", "left").groupBy("id").agg(
        F.count("*").alias("n"), F.count("met").alias("shared")).filter(F.col("shared") * 100 >= percent * F.col("n"))
    kept = members.join(counts, "id")
    several = kept.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return kept.join(several.filter("least <> most").select("key"), "key")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").select(*rows.columns, F.coalesce("component", "id").alias("component"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    known = pairs.join(a, "a", "left").join(b, "b", "left")
    return known.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
