"""Secrets in texts: fixed patterns, and character Markov models for what no pattern names.

Base spans are the leftmost non-overlapping matches of each pattern that are
long enough (`assign`, `access`, `hex`).  The method adds `random` spans: runs
of CANDIDATE characters that overlap no base span and that a Markov model of
random strings explains better than one of ordinary identifiers, by a
log-likelihood ratio of at least MARGIN.

Both models are first-order chains over the characters of ALPHABET with a start
state.  They are trained from labelled samples: values that base spans hold, in all
documents, are random strings; ordinary identifiers are the runs of candidate
characters, of 4 or more and however long but made of short parts or words, of texts without base spans, and
the forms listed in ORDINARY (rules, dates, paths, names in several words), of which a
corpus may hold none.  These texts are those whose hash falls below a bound chosen for about
SAMPLE_DOCS documents; without samples of both kinds nothing is added.  Both classes are
smoothed by the same shares: SHARED of a chance after a character is how often the next one
occurs at all, and EVEN of that is spread evenly, so what neither sample knows speaks for
neither class.  What is kept of a model is a table of one ratio per pair of characters, which the alphabet bounds.

Only DataFrame functions are used.  Positions come from the pieces between the
matches: a pattern's matches and the pieces around them, put together, are the
text.  They are summed in pieces of about the square root of their number, so a text with n matches takes
n * sqrt(n) steps at most.  A scan is a projection; nothing is shuffled but the model's counts.

Defined cases: null and empty texts have no spans; repeated rows repeat; an
empty table gives an empty result; other columns pass through where asked for,
and `_`-prefixed names are the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: kind, pattern, group whose length counts, least length
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
RUN = "[A-Za-z0-9+/_=-]{4,}"
# runs that may serve as ordinary ones: parts between marks are words, or of 15 characters at most, so that no unknown
# secret, which is one long part, is learnt as ordinary
WORDLIKE = "^[+/_=-]*(?:(?:(?:[A-Z]?[a-z]++)++|[A-Za-z0-9]{1,15})(?:[+/_=-]+|$))*$"
# fixed values: ordinary forms that a corpus may lack, each weighing as one string of it
ORDINARY = (
    "====================", "--------------------", "____________________", "++++++++++++++++++++", "////////////////////",
    "=-=-=-=-=-=-=-=-=-=-", "+----+----+----+----+", "2024-01-31/2024-12-31", "1999-12-31-23-59-58", "0123456789", "9876543210",
    "1000000000000000000", "555-0123-4567-8899", "2021-06-15T08-30-00Z", "192-168-10-254", "10/11/2012/13/14/15", "16/17/18/19/20",
    "/usr/local/share/doc", "/home/user/projects/archive/2023", "src/main/python/library", "a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p",
    "max_retry_count_value", "first_name_last_name", "read-only-file-system", "well-known-and-long-established", "__init_subclass__",
    "getElementsByTagName", "NullPointerException", "HTTPServerConnectionPool", "MAX_BUFFER_SIZE_BYTES", "README_FIRST_PLEASE",
    "and/or", "key=value", "name=first_last", "x=1", "a+b=c", "version_1_2_3", "chapter-01-section-02-page-003", "v2-final-final-2",
)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
SAMPLE_DOCS = 20_000
SHARED = 0.1
EVEN = 0.05
MARGIN = 15.0
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, not for every element that refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, found: Column, held: Column | None = None,
           least: int = 0) -> Column:
    """Spans of the matches `found` of a pattern, in characters; those count whose part `held` has `least` characters."""
    between = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(
        F.length(g).alias("gap"), F.length(m).alias("run")))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def cut(steps: Column) -> Column:
        piece = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(steps)))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / piece).cast("int")),
                           lambda i: F.slice(steps, i * piece + 1, piece))

    def place(pieces: Column) -> Column:
        first = F.aggregate(
            pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, p: F.struct(F.aggregate(p, acc["at"], lambda n, s: n + s["gap"] + s["run"]).alias("at"),
                                    F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])
        return F.flatten(F.zip_with(pieces, first, lambda p, at: F.aggregate(
            p, start(at),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["run"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"),
                                                      (acc["at"] + s["gap"] + s["run"]).alias("end")))).alias("out")),
            lambda acc: acc["out"])))

    placed = _bound(_bound(steps, cut), place)
    if held is not None:
        placed = F.filter(F.zip_with(placed, held, lambda x, h: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.length(h).alias("held"))), lambda x: x["held"] >= least)
    spans = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column, kind: int) -> Column:
    """Spans of one kind of PATTERNS."""
    name, pattern, group, least = PATTERNS[kind]
    if name == "hex":
        # runs are maximal, so a run is long enough or has no match at all
        pattern = f"{pattern[:-1]}{{{least},}}"
        return _spans(text, pattern, kind, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return _spans(text, pattern, kind, found, held, least)


def with_base(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """`keep`, _text and _base: array of (start, kind, end), by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    return rows.select(*keep, "_text", F.array_sort(F.concat(*[base_spans(F.col("_text"), k) for k in range(3)])).alias("_base"))


def _counts(strings: DataFrame) -> dict[tuple[int, int], int]:
    """Strings of ALPHABET in which a pair of states occurs: one row per pair reaches the driver.

    A pair counts once a string, so that no very long string outweighs the others.
    """
    chained = strings.select(F.concat(F.array(F.lit(0)), F.transform(
        F.split("s", ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))).alias("c"))
    pairs = chained.select(F.explode(F.array_distinct(F.zip_with(
        F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b"))))).alias("p"))
    return {(r["a"], r["b"]): r["n"] for r in pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).collect()}


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of every pair of states, row by row."""
    total = docs.count()
    part = min(1.0, sample_docs / max(total, 1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the random part of an assignment is its value; its keyword and marks are cut off
    value = F.regexp_replace(F.col("s"), r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "")
    inside = with_base(docs, text_col, ()).filter(F.size("_base") > 0).select("_text", F.explode("_base").alias("x")).select(
        F.expr("substring(_text, x.start + 1, x.end - x.start)").alias("s")).select(
        F.regexp_replace(value, f"[^{ALPHABET[:-1]}-]", "").alias("s")).filter("s <> ''").distinct()
    drawn = docs.filter(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(part * (1 << 30)))
    outside = with_base(drawn, text_col, ()).filter(F.size("_base") == 0).select(
        F.explode(F.regexp_extract_all("_text", F.lit(RUN), F.lit(0))).alias("s")).filter(F.col("s").rlike(WORDLIKE))
    random, ordinary = _counts(inside), _counts(outside)
    if not random or not ordinary:
        return [0.0] * (STATES * STATES)
    return ratios(random, with_forms(ordinary))


def with_forms(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Counts of pairs, with those of the forms in ORDINARY."""
    out = dict(counts)
    for form in ORDINARY:
        states = [0, *(ALPHABET.index(c) + 1 for c in form)]
        for pair in set(zip(states, states[1:])):
            out[pair] = out.get(pair, 0) + 1
    return out


def _chances(counts: dict[tuple[int, int], int]) -> list[list[float]]:
    """Chance of every state after every state; SHARED of it is how often a state occurs at all, EVEN of that is even."""
    often = [0] * STATES
    for (_, b), n in counts.items():
        often[b] += n
    total = sum(often)
    often = [(1 - EVEN) * n / total + EVEN / (STATES - 1) for n in often]
    out = []
    for a in range(STATES):
        row = [counts.get((a, b), 0) for b in range(STATES)]
        seen = sum(row)
        out.append([(1 - SHARED) * n / seen + SHARED * p if seen else p for n, p in zip(row, often)])
    return out


def ratios(random: dict[tuple[int, int], int], ordinary: dict[tuple[int, int], int]) -> list[float]:
    """Log-likelihood ratios by pair of states."""
    pairs = zip(_chances(random), _chances(ordinary))
    return [math.log(p / q) for left, right in pairs for p, q in zip(left, right)]


def score(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of ALPHABET."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    chained = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        chained, start,
        lambda acc, c: F.struct(c.alias("at"), (acc["sum"] + F.get(table, acc["at"] * STATES + c)).alias("sum")),
        lambda acc: acc["sum"])


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: list[float] | None = None,
         margin: float = MARGIN) -> DataFrame:
    """`keep`, and spans: array of (start, kind, end) with kind an index into KINDS, by start and kind."""
    model = train(docs, text_col) if model is None else model
    rows = with_base(docs, text_col, keep)
    tokens = F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))
    runs = _spans(F.col("_text"), CANDIDATE, 3, tokens)
    # every run with its string, so that none is cut out of the text again
    runs = F.zip_with(runs, tokens, lambda r, t: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"),
                                                          (score(t, model) >= margin).alias("likely")))
    rows = rows.select(*keep, "_base", runs.alias("_runs"))
    likely = F.filter(F.filter("_runs", lambda r: r["likely"]), lambda r: ~F.exists(
        "_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    likely = F.transform(likely, lambda r: F.struct(r["start"], r["kind"], r["end"])).cast(_SPAN)
    spans = F.when(F.size("_runs") > 0, F.array_sort(F.concat("_base", likely))).otherwise(F.col("_base"))
    return rows.select(*keep, spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    """Number of spans of one kind."""
    # one parameter: a second one, even with a default, is the position in the array
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span (overlapping ones together) replaced by the mask; texts without spans as they are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        spans, start,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
