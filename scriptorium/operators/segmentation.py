"""Documents -> paragraphs -> chapters, all inside the document row.

Every rule works on the ordered paragraph array of one document, so a corpus
is segmented without any shuffle and in parallel by document.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import SPACE, contains_any, let, strip

_CN = rules.CN_NUMERALS


def is_noise(text: Column) -> Column:
    """Watermark, bare page number or footnote line."""
    footnote = reduce(or_, [text.startswith(m) for m in rules.FOOTNOTE_MARKERS])
    return text.isin(*rules.NOISE_EXACT) | text.rlike(rules.PAGE_NUMBER_PATTERN) | footnote


def clean_paragraphs(text: Column, keep_noise: bool = False) -> Column:
    """Ordered, trimmed, non-blank paragraphs of a text."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.filter(lines, lambda p: (p != "") if keep_noise else ((p != "") & ~is_noise(p)))


def _first_with(paras: Column, words) -> Column:
    """Position of the first paragraph holding one of the words."""
    return F.aggregate(
        F.transform(paras, lambda p, i: F.when(contains_any(p, words), i)),
        F.lit(None).cast("int"), lambda a, x: F.coalesce(a, x))


def design_section(paras: Column) -> Column:
    """From the first start line up to the next line with an end marker."""
    def from_start(ps):
        return let(_first_with(ps, rules.DESIGN_START), lambda start: F.when(start.isNotNull(), let(
            F.slice(ps, start + 1, F.size(ps)), up_to_end)).otherwise(F.lit("")))

    def up_to_end(section):
        after = F.slice(section, 2, F.size(section))
        length = F.coalesce(_first_with(after, rules.DESIGN_END), F.size(after)) + 1
        return strip(F.array_join(F.slice(section, 1, length), "\n"))

    return let(paras, from_start)


# --- headings ---------------------------------------------------------------

_DI = rf"^第([{_CN}0-9]{{1,4}})(?:[章节篇]|部分)"
_CN_HEAD = rf"^[{_CN}]{{1,3}}[、.．][{SPACE}]*[^{SPACE}]"
_CN_ORDINAL = rf"^([{_CN}]{{1,3}})[、.．]"
_AR_REST = rf"^[0-9]{{1,2}}(?:[{SPACE}]+|[、.．])[{SPACE}]*([^{SPACE}0-9].*)$"
_AR_ORDINAL = rf"^([0-9]{{1,2}})(?:[{SPACE}]+|、|[.．](?![0-9]))"
_SUB_AR = r"^[0-9]{1,2}([.．][0-9]{1,2}){1,3}"
_SUB_CN = rf"^[（(][{_CN}]{{1,3}}[)）]"


def is_heading(t: Column) -> Column:
    """Whether a trimmed paragraph looks like a first-level heading."""
    n = F.length(t)
    han_in_rest = F.length(F.regexp_replace(F.regexp_extract(t, _AR_REST, 1), "[^一-鿿]", ""))
    keyword = reduce(or_, [
        t.startswith(k) & (n <= len(k) + rules.HEADING_KEYWORD_SLACK) for k in rules.HEADING_KEYWORDS])
    shape = t.rlike(_DI) | t.rlike(_CN_HEAD) | (han_in_rest >= 2) | keyword
    ends_badly = F.instr(F.lit(rules.HEADING_BAD_END), F.right(t, F.lit(1))) > 0
    # cheap tests first: almost all paragraphs are longer than a heading
    return (n > 0) & (n <= rules.HEADING_MAX_CHARS) & ~ends_badly & ~t.rlike(_SUB_AR) & ~t.rlike(_SUB_CN) & shape


def chinese_number(s: Column) -> Column:
    """Numerals 0-99 in Chinese digits, or plain digits; NULL otherwise."""
    digits = F.create_map(*[F.lit(x) for pair in rules.CN_DIGITS.items() for x in pair])
    first, second, third = (digits[F.substring(s, i, 1)] for i in (1, 2, 3))
    n = F.length(s)
    return (
        F.when(s.rlike("^[0-9]+$"), s.try_cast("int"))
        .when(n == 1, first)
        .when(s.startswith("十"), F.when(n == 2, second + 10))
        .when(s.endswith("十") & (n == 2), F.when(first > 0, first * 10))
        .when((n == 3) & (F.substring(s, 2, 1) == "十"), F.when(first > 0, first * 10 + third))
    )


def heading_ordinal(t: Column) -> Column:
    """struct(style, number); NULL when the heading carries no usable number."""
    di = F.nullif(F.regexp_extract(t, _DI, 1), F.lit(""))
    cn = F.nullif(F.regexp_extract(t, _CN_ORDINAL, 1), F.lit(""))
    ar = F.nullif(F.regexp_extract(t, _AR_ORDINAL, 1), F.lit(""))
    number = (
        F.when(di.isNotNull(), chinese_number(di)).when(cn.isNotNull(), chinese_number(cn))
        .otherwise(ar.try_cast("int")))
    style = F.when(di.isNotNull(), F.lit("di")).when(cn.isNotNull(), F.lit("cn")).otherwise(F.lit("ar"))
    return F.when(number.isNotNull(), F.struct(style.alias("style"), number.alias("number")))


def toc_mask(flags: Column) -> Column:
    """True inside runs of three or more heading-like paragraphs."""
    def mask(fs):
        n = F.size(fs)

        def at(i):
            return F.when((i >= 0) & (i < n), F.get(fs, i)).otherwise(F.lit(False))

        # a position is in a run of three when one of the three windows over it is full
        return F.transform(fs, lambda f, i: f & (
            (at(i - 2) & at(i - 1)) | (at(i - 1) & at(i + 1)) | (at(i + 1) & at(i + 2))))

    return let(flags, mask)


def _accepted(candidates: Column) -> Column:
    """Positions of the candidates that keep their numbering style in sequence."""
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("di"), none.alias("cn"), none.alias("ar"),
                     F.array().cast("array<int>").alias("kept"))

    def step(state, c):
        style, number = c.ordinal.style, c.ordinal.number
        previous = F.when(style == "di", state.di).when(style == "cn", state.cn).otherwise(state.ar)
        fits = F.when(previous.isNull(), number.isin(0, 1)).otherwise(number == previous + 1)
        moved = F.struct(
            F.when(style == "di", number).otherwise(state.di).alias("di"),
            F.when(style == "cn", number).otherwise(state.cn).alias("cn"),
            F.when(style == "ar", number).otherwise(state.ar).alias("ar"),
            F.array_append(state.kept, c.pos).alias("kept"))
        plain = F.struct(state.di.alias("di"), state.cn.alias("cn"), state.ar.alias("ar"),
                         F.array_append(state.kept, c.pos).alias("kept"))
        return F.when(c.ordinal.isNull(), plain).when(fits, moved).otherwise(state)

    return F.aggregate(candidates, start, step, lambda s: s.kept)


def detect_headings(docs: DataFrame, paras: str = "paras") -> DataFrame:
    """Add is_heading: one flag per paragraph."""
    return docs.withColumn("is_heading", F.transform(paras, lambda p: is_heading(strip(p))))


def chapter_role(title: Column, position: Column, total: Column) -> tuple[Column, Column]:
    """Role and confidence of a chapter by its title, else by its position."""
    placed = (total > 0) & (position >= 0)
    fallback = (
        F.when(placed & (position <= 1), F.lit(rules.ROLE_BACKGROUND))
        .when(placed & (position >= total - 1), F.lit(rules.ROLE_GAP))
        .otherwise(F.lit(rules.ROLE_CONCEPT)))
    middle = placed & ((position <= 1) | (position >= total - 1))

    def both(role):
        front = role == rules.FRONT_MATTER
        return F.struct(
            F.when(front, F.lit(rules.ROLE_BACKGROUND)).otherwise(F.coalesce(role, fallback)).alias("role"),
            F.when(front, F.lit("medium")).when(role.isNotNull(), F.lit("high")).when(middle, F.lit("medium"))
            .otherwise(F.lit("low")).alias("confidence"))

    # the title is computed once, however many words it is searched for
    found = let(let(title, _role_of_title), both)
    return found.role, found.confidence


def _role_of_title(title: Column) -> Column:
    """The first role that has a word in the title; NULL without one; FRONT_MATTER for that title."""
    role = F.lit(None).cast("string")
    for name, words in reversed(rules.ROLE_RULES):
        role = F.when(contains_any(title, words), F.lit(name)).otherwise(role)
    # one pass tells most lines apart: a text without a character in the range of the words' first ones holds no word
    firsts = {w[0] for _, words in rules.ROLE_RULES for w in words}
    return F.when(title == rules.FRONT_MATTER, F.lit(rules.FRONT_MATTER)).when(title.rlike(f"[{min(firsts)}-{max(firsts)}]"), role)


def split_chapters(docs: DataFrame, paras: str = "paras") -> DataFrame:
    """Add chapters: array<struct<chapter_index, title, paras, section_role, tag_confidence>>.

    `docs` has one row per document with its ordered paragraphs.  Contents runs
    and headings out of sequence are body text.  A group is dropped while the
    document has no body text yet, unless it is the last one.
    """
    return docs.withColumn("chapters", let(F.col(paras), _chapters))


def _chapters(paras: Column) -> Column:
    flags = F.transform(paras, lambda p: is_heading(strip(p)))
    return let(flags, lambda heads: let(_candidates(paras, heads, toc_mask(heads)), lambda found: let(
        _accepted(found), lambda at: let(_groups(paras, at), _labelled))))


def _candidates(paras: Column, heads: Column, in_toc: Column) -> Column:
    """Heading positions outside contents runs, with their numbering."""
    usable = F.zip_with(heads, in_toc, lambda h, t: h & ~t)
    marked = F.zip_with(usable, F.transform(paras, lambda p, i: F.struct(i.alias("pos"), p.alias("para"))),
                        lambda ok, x: F.when(ok, x))
    return F.transform(F.array_compact(marked), lambda x: F.struct(
        x.pos.alias("pos"), heading_ordinal(strip(x.para)).alias("ordinal")))


def _groups(paras: Column, at: Column) -> Column:
    """Title and body of each group that counts as a chapter."""
    n, m = F.size(paras), F.size(at)

    def group(g):
        start = F.when(g == 0, F.lit(0)).otherwise(F.get(at, g - 1) + 1)
        end = F.when(g < m, F.get(at, g)).otherwise(n)
        title = F.when(g == 0, F.lit(rules.FRONT_MATTER)).otherwise(strip(F.get(paras, F.get(at, g - 1))))
        # paragraphs so far = positions before the end, less the headings among them
        keep = F.when(g == m, (g > 0) | (n > 0)).otherwise(end - g > 0)
        return F.when(keep, F.struct(title.alias("title"), F.slice(paras, start + 1, end - start).alias("paras")))

    return F.array_compact(F.transform(F.sequence(F.lit(0), m), group))


def _labelled(groups: Column) -> Column:
    total = F.size(groups)

    def label(c, i):
        role, confidence = chapter_role(c.title, i, total)
        return F.struct(i.alias("chapter_index"), c.title.alias("title"), c.paras.alias("paras"),
                        role.alias("section_role"), confidence.alias("tag_confidence"))

    return F.transform(groups, label)


def chapter_rows(chaptered: DataFrame, key: str) -> DataFrame:
    """Long form: one row per chapter."""
    return chaptered.select(key, F.explode("chapters").alias("c")).select(
        key, "c.chapter_index", "c.title", "c.paras", "c.section_role", "c.tag_confidence")


def collect_paragraphs(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """paragraphs(key, pos, para) -> (key, paras) in order; a group is one document."""
    gathered = paragraphs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "para"))).alias("p"))
    return gathered.select(key, F.col("p.para").alias("paras"))


# --- sentences --------------------------------------------------------------

def join_fragments(paras: Column) -> Column:
    """Continuous text: a line break only after a paragraph that ends a sentence."""
    lines = F.filter(F.transform(paras, strip), lambda p: p != "")
    ended = F.transform(lines, lambda p: F.when(
        p.rlike("[。！？!?；;…]$"), F.concat(p, F.lit("\n"))).otherwise(p))
    return strip(F.array_join(ended, ""))


def split_sentences(text: Column) -> Column:
    """Cut after sentence marks; a full stop only before white space."""
    flat = F.regexp_replace(text, rf"[{SPACE}]*\n[{SPACE}]*", "")
    pieces = F.split(flat, rf"(?<=[。！？!?；;])|(?<=\.)[{SPACE}]+")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")
