"""Spelling variants: words that differ by one character, grouped under their most common form.

Two words are near if one inserted, deleted or replaced character turns one into
the other.  Then they share the first half of either, or the second: cut word P
behind its first len // 2 characters; the error lies in one half, so the other one
stands unchanged at the same end of its partner.  Near words are found by an
FM-index and search schemes:

  forwards   the opening delimiter and the first half are matched exactly, then
             the rest is extended to the right, allowing one error;
  backwards  the closing delimiter and the second half are matched exactly, then
             the rest is extended to the left, allowing one error, and partners
             that also share the first half are left out, since the other scheme
             has them.

The index holds the words with delimiters as symbols sorted by what stands before
them (for the scheme backwards: behind them).  A string is an interval of these
ranks; an extension by a symbol is two counts of the symbol.  A scheme needs one
direction only, because it starts at an end of a word, so each direction has an
index of its own.  At the place of the error all symbols that follow in the
interval are tried.  A deleted or inserted character within a run of equal ones
counts at the run's end only, so a partner is met once.

How it is spread.  The halves are shuffle keys: a word is asked for under its own
halves and indexed under the halves that partners one shorter, of equal length or one
longer would ask for.  Keys are bundled by hash into groups of about GROUP rows,
each with its own index.  A key of more than GROUP words is dealt into pieces of
words and of questions, one group for each pair of them.  Counts of words are
pre-aggregated in the scan.  No pair of words leaves a task, only each word's number of
near words and its best one.

A word's form is the near word of largest count (ties: the smaller one in order of
code points) if that is at least `ratio` times its own; its root is where
following forms ends.  Counts rise by `ratio` with each step, so chains are short;
they are followed by doubling.

Defined cases: null and empty texts have no words; repeated rows count each; with
a null id nothing is deleted by `with_typos`; words of any length work, a long one makes its
group's arrays as long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.scale import small_join

from .store import saved

GROUP = 16_000
CHUNK = 4_096
RATIO = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PACKED = 9
_SYMBOL_BITS = 7


class Ranks:
    """Symbols of delimited words, sorted by the characters before them; symbol 0 is the delimiter.

    `symbols` holds the words one after another (values from 1), `sizes` their lengths.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        self.words = len(sizes)
        n = len(symbols) + self.words
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        place = np.arange(n) - np.repeat(starts, sizes + 1)
        opening = place == 0
        # what stands before row r is before[r], before[r - 1], ... back to the opening delimiter of its word
        before = np.zeros(n, dtype=np.int64)
        before[~opening] = symbols
        following = np.zeros(n, dtype=np.int64)
        following[:-1] = np.where(opening[1:], 0, before[1:])
        self.sigma = int(symbols.max(initial=0)) + 1
        order = self._sorted(before, place, int(sizes.max(initial=0)))
        self.symbols = following[order]
        self.ends = np.searchsorted(starts, order[self.symbols == 0], side="right") - 1
        first = np.bincount(self.symbols, minlength=self.sigma)
        # a symbol's ranks start behind all rows that smaller symbols lead to
        self.base = np.concatenate(([0], np.cumsum(first)[:-1]))
        rows = n // 64 + 1
        at = np.arange(n)
        self.bits = np.zeros((rows, self.sigma), dtype=np.uint64)
        np.bitwise_or.at(self.bits, (at >> 6, self.symbols), np.uint64(1) << (at & 63).astype(np.uint64))
        held = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(held, axis=0) - held

    @staticmethod
    def _sorted(before: np.ndarray, place: np.ndarray, longest: int) -> np.ndarray:
        """Rows by the string before them, read from right to left; equal strings by word."""
        shift = _SYMBOL_BITS if before.max(initial=0) < 1 << _SYMBOL_BITS else 63 // _PACKED * 3
        packed = 63 // shift
        key = np.zeros(len(before), dtype=np.int64)
        for t in range(packed):
            part = np.zeros(len(before), dtype=np.int64)
            part[t:] = before[:len(before) - t]
            key |= np.where(place >= t, part, 0) << (shift * (packed - 1 - t))
        rank = np.unique(key, return_inverse=True)[1]
        span = packed
        while span <= longest:
            back = np.full(len(rank), -1, dtype=np.int64)
            back[span:] = rank[:len(rank) - span]
            rank = np.unique(rank * (len(rank) + 1) + np.where(place >= span, back, -1) + 1, return_inverse=True)[1]
            span *= 2
        return np.argsort(rank, kind="stable")

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where an interval bound moves when the string grows by a symbol."""
        block, mask = row >> 6, (np.uint64(1) << (row & 63).astype(np.uint64)) - np.uint64(1)
        return (self.base[symbol] + self.before[block, symbol]
                + np.bitwise_count(self.bits[block, symbol] & mask))

    def _all(self, row: np.ndarray) -> np.ndarray:
        block, mask = row >> 6, (np.uint64(1) << (row & 63).astype(np.uint64)) - np.uint64(1)
        return self.base + self.before[block] + np.bitwise_count(self.bits[block] & mask[:, None])

    def children(self, low: np.ndarray, high: np.ndarray):
        """All extensions by a symbol other than the delimiter: interval number, symbol, and new bounds."""
        single = np.flatnonzero(high - low == 1)
        symbol = self.symbols[low[single]]
        single, symbol = single[symbol > 0], symbol[symbol > 0]
        moved = self.step(symbol, low[single])
        wide = np.flatnonzero(high - low > 1)
        a, b = self._all(low[wide]), self._all(high[wide])
        which, found = np.nonzero(b[:, 1:] > a[:, 1:])
        found += 1
        return (np.concatenate((single, wide[which])), np.concatenate((symbol, found)),
                np.concatenate((moved, a[which, found])), np.concatenate((moved + 1, b[which, found])))

    def near(self, symbols: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (question, word) one error apart, the error behind the first `exact` characters.

        A symbol that no word has must be 0 or at least `sigma`.
        """
        found = [self._near(symbols, sizes, exact, at, min(at + CHUNK, len(sizes))) for at in range(0, len(sizes), CHUNK)]
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)

    def _near(self, symbols, sizes, exact, begin, stop):
        starts = np.cumsum(sizes) - sizes
        text = np.append(symbols, 0)
        # a character of a question that follows; 0 where the question has ended
        at = lambda q, i: np.where(i < sizes[q], text[np.minimum(starts[q] + i, len(text) - 1)], 0)
        q = np.arange(begin, stop)
        low, high = np.zeros(len(q), dtype=np.int64), np.full(len(q), self.words, dtype=np.int64)
        erred = []
        for i in range(int(sizes[begin:stop].max(initial=0)) + 1):
            keep = (high > low) & (sizes[q] >= i)
            q, low, high = q[keep], low[keep], high[keep]
            asked = at(q, np.full(len(q), i))
            some = np.flatnonzero(i >= exact[q])
            if len(some):
                p, a, b, c = q[some], low[some], high[some], asked[some]
                which, symbol, new_low, new_high = self.children(a, b)
                other = symbol != c[which]
                which, new_low, new_high = which[other], new_low[other], new_high[other]
                replaced = sizes[p[which]] > i
                last_of_run = (sizes[p] > i) & (at(p, np.full(len(p), i + 1)) != c)
                for owner, place, x, y in ((p[which[replaced]], i + 1, new_low[replaced], new_high[replaced]),
                                           (p[which], i, new_low, new_high),
                                           (p[last_of_run], i + 1, a[last_of_run], b[last_of_run])):
                    erred.append((owner, np.full(len(owner), place), x, y))
            grows = np.flatnonzero((sizes[q] > i) & (asked > 0) & (asked < self.sigma))
            q, asked = q[grows], asked[grows]
            low, high = self.step(asked, low[grows]), self.step(asked, high[grows])
        return self._finished(erred, sizes, at)

    def _finished(self, erred, sizes, at):
        """States (question, characters read, bounds) with their error behind them, read to the end exactly."""
        none = np.zeros(0, dtype=np.int64)
        q, i, low, high = (np.concatenate(x) for x in zip(*erred)) if erred else (none,) * 4
        pairs = []
        while len(q):
            ended = i >= sizes[q]
            a, b = self.step(np.zeros(ended.sum(), dtype=np.int64), low[ended]), self.step(np.zeros(ended.sum(), dtype=np.int64), high[ended])
            whole = b > a
            pairs.append((q[ended][whole], self.ends[a[whole]]))
            symbol = at(q, i)
            grows = np.flatnonzero(~ended & (symbol > 0) & (symbol < self.sigma))
            q, i, symbol = q[grows], i[grows] + 1, symbol[grows]
            low, high = self.step(symbol, low[grows]), self.step(symbol, high[grows])
            kept = high > low
            q, i, low, high = q[kept], i[kept], low[kept], high[kept]
        return tuple(np.concatenate(x) for x in zip(*pairs)) if pairs else (none, none)


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and lengths."""
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.uint32), sizes


def _reversed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return points[np.repeat(2 * ends - sizes, sizes) - 1 - np.arange(len(points))] if len(points) else points


def _same_end(pairs, asked, asked_sizes, words, word_sizes) -> np.ndarray:
    """Pairs (question, word) whose last asked_sizes // 2 characters are equal."""
    q, w = pairs
    q_end, w_end = np.cumsum(asked_sizes)[q] - 1, np.cumsum(word_sizes)[w] - 1
    same = np.ones(len(q), dtype=bool)
    half = asked_sizes[q] // 2
    for t in range(int(half.max(initial=0))):
        inside = np.flatnonzero(same & (t < half))
        same[inside] = (w_end[inside] >= t) & (asked[q_end[inside] - t] == words[np.maximum(w_end[inside] - t, 0)])
    return same & (word_sizes[w] >= half)


def near_words(asked: pa.Array, words: pa.Array, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (question, word) that one of the two schemes finds; together the schemes find each pair once."""
    points, sizes = _points(words)
    asked_points, asked_sizes = _points(asked)
    exact = asked_sizes // 2
    if backwards:
        points, asked_points, exact = _reversed(points, sizes), _reversed(asked_points, asked_sizes), asked_sizes - exact
    alphabet = np.unique(points)
    symbols = np.searchsorted(alphabet, points) + 1
    at = np.minimum(np.searchsorted(alphabet, asked_points), max(len(alphabet) - 1, 0))
    known = alphabet[at] == asked_points if len(alphabet) else np.zeros(len(asked_points), dtype=bool)
    pairs = Ranks(symbols, sizes).near(np.where(known, at + 1, 0), asked_sizes, exact)
    if backwards:
        new = ~_same_end(pairs, asked_points, asked_sizes, points, sizes)
        pairs = pairs[0][new], pairs[1][new]
    return pairs


_FOUND = "word string, n bigint, n_near bigint, form string, form_n bigint"


def _searched(key: tuple, rows: pa.Table) -> pa.Table:
    held = rows.filter(rows.column("indexed")).group_by("word").aggregate([("n", "max")])
    asked = rows.filter(rows.column("asks"))
    words, counts = held.column("word").combine_chunks(), held.column("n_max").to_numpy()
    questions = asked.column("word").combine_chunks()
    q, w = near_words(questions, words, bool(key[0].as_py()))
    # the best of each question: the largest count, then the first word
    by_word = np.empty(len(words), dtype=np.int64)
    by_word[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((by_word[w], -counts[w], q))
    q, w = q[order], w[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=np.int64)
    best = np.full(len(questions), -1)
    best[q[first]] = w[first]
    index = pa.array(best, mask=best < 0)
    return pa.table({"word": questions, "n": asked.column("n"),
                     "n_near": pa.array(np.bincount(q, minlength=len(questions)).astype(np.int64)),
                     "form": words.take(index), "form_n": pa.array(counts).take(index)})


def with_typos(word: Column, id_col: Column, every: int = 31) -> Column:
    """The word, without one of its characters where `every` divides the crc32 of id:word."""
    h = F.crc32(F.concat(id_col.cast("string"), F.lit(":"), word))
    at = F.pmod(h, F.length(word).cast("bigint")).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % every == 0, shorter).otherwise(word)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2,
                typos_every: int | None = None) -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, of `shortest` characters or more, that occur `least` times or more."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    words = docs.select(F.col(id_col).alias("_id"), F.explode(runs).alias("word"))
    words = words.withColumn("word", F.when(F.col("word").rlike("[A-Z]"), F.translate("word", _UPPER, _LOWER)).otherwise(F.col("word")))
    if typos_every:
        words = words.withColumn("word", with_typos(F.col("word"), F.col("_id"), typos_every)).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _keyed(words: DataFrame) -> DataFrame:
    """word, n, side, key, indexed, asks: a word under its halves and under those that near words ask for."""
    size = F.length("word")
    rows = []
    for side in (0, 1):
        for longer in (-1, 0, 1):
            other = size + longer
            half = F.floor(other / 2) if side == 0 else other - F.floor(other / 2)
            half = half.cast("int")
            text = F.substring("word", F.lit(1), half) if side == 0 else F.right(F.col("word"), half)
            rows.append(F.struct(F.lit(side).alias("side"), text.alias("key"), F.lit(longer).alias("longer")))
    spread = words.select("word", "n", F.explode(F.array(*rows)).alias("k")).select("word", "n", "k.side", "k.key", "k.longer")
    # equal halves of two lengths are one row
    return spread.filter("longer <> 1 or char_length(key) > (case side when 0 then floor(char_length(word) / 2) "
                         "else char_length(word) - floor(char_length(word) / 2) end)").filter(
        "longer <> -1 or char_length(key) < (case side when 0 then floor(char_length(word) / 2) "
        "else char_length(word) - floor(char_length(word) / 2) end)").select(
        "word", "n", "side", "key", (F.col("longer") == 0).alias("asks"))


def group_variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of words (word, n); words are distinct."""
    keyed = _keyed(words)
    total = words.count()
    buckets = max(1, -(-4 * total // group))
    hot = saved(keyed.groupBy("side", "key").count().filter(F.col("count") > group).select(
        "side", "key", F.ceil(F.col("count") / group).cast("int").alias("pieces")), "hot")
    rows = small_join(keyed, hot, ["side", "key"], "left")
    bundle = F.pmod(F.xxhash64("side", "key"), F.lit(buckets)).cast("string")
    even = rows.filter("pieces is null").select("side", bundle.alias("part"), "word", "n", F.lit(True).alias("indexed"), "asks")
    piece = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    many = rows.filter("pieces is not null").withColumn("piece", piece).withColumn("other", each)
    indexed = many.select("side", F.concat_ws("/", "key", "piece", "other").alias("part"), "word", "n",
                          F.lit(True).alias("indexed"), F.lit(False).alias("asks"))
    asking = many.filter("asks").select("side", F.concat_ws("/", "key", "other", "piece").alias("part"), "word", "n",
                                        F.lit(False).alias("indexed"), "asks")
    cells = even.unionByName(indexed).unionByName(asking)
    found = cells.groupBy("side", "part").applyInArrow(_searched, _FOUND)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    forms = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    takes = -F.col("best.less") >= ratio * F.col("n")
    forms = saved(forms.select("word", "n", "n_near", F.when(takes, F.col("best.form")).alias("form"),
                               F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(forms.filter("form is not null").select("word", "form"))
    return forms.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select(
        "word", "n", "n_near", "form", "form_n", "root")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms ends, by doubling the distance that is known."""
    known = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = saved(known.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if known.filter("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")
