"""Checks of text segmentation: headings, chapters, sentences, chunks, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium import rules
from scriptorium.functions.text import strip
from scriptorium.operators import packing as pk
from scriptorium.operators import segmentation as sg
from scriptorium.operators.embedding import embed_texts

from .ingest import DESIGN_DUCK, DESIGN_TEXT
from .registry import check, d_strip, d_tok, r6

# runs of three, two and single headings in mixed numbering styles between the paragraphs
_DENSE = """case {i} % 11
  when 0 then concat('第', list_el({numerals}, {i} // 11 % 10), '章 研究背景') when 3 then concat(({i} // 11 + 1)::{S}, ' 相关研究综述')
  when 4 then concat(list_el({numerals}, {i} // 11 % 10), '、数据与变量') when 6 then '结论与展望'
  when 7 then case when {i} // 11 % 2 = 0 then '1.1 小节标题' else '研究方法' end
  when 8 then concat('（', list_el({numerals}, 2), '）说明') when 9 then case when {i} // 11 % 3 = 1 then '引言' end
  end"""
NUMERALS = ("一", "二", "三", "四", "五", "七", "六", "十一", "二十", "百")


# headings put before line i: one, a run of two, a run of three or four
_RUNS = ((0, (0, 3, 6)), (1, (3, 6)), (2, (6,)), (3, (6,)))


def _inserted(heading: str) -> str:
    """Headings before a line, from the text of a heading with {i} for its number."""
    return ", ".join(
        f"case when i % 11 in ({', '.join(map(str, at))}) then {heading.replace('{i}', f'(i + {step})')} end"
        for step, at in _RUNS)


def dense(d):
    """Whole documents with many headings between their lines, some out of sequence, some in runs."""
    words = "array(" + ", ".join(f"'{n}'" for n in NUMERALS) + ")"
    text = (_DENSE.replace("{i} // 11", "cast(floor({i} / 11) as int)")
            .replace("list_el({numerals}, ", f"get({words}, ").replace("(cast(floor({i} / 11) as int) + 1)::{S}",
                                                                      "cast(cast(floor({i} / 11) as int) + 1 as string)"))
    return d.documents.select("doc_id", F.expr(
        f"flatten(transform(split(text, '\\\\n'), (p, i) -> array_compact(array({_inserted(text)}, trim(p)))))").alias("paras"))


def _dense_duck():
    words = "[" + ", ".join(f"'{n}'" for n in NUMERALS) + "]"
    text = _DENSE.replace("list_el({numerals}, ", f"list_extract({words}, 1 + ").replace("{S}", "varchar")
    return ("dense as materialized (select doc_id, flatten(list_transform(range(len(l)), lambda i: "
            f"list_filter([{_inserted(text)}, trim(l[i + 1])], lambda x: x is not null))) paras "
            "from (select doc_id, string_split(text, chr(10)) l from documents))")


DENSE = _dense_duck()
_CN = "零一二三四五六七八九十百两"
_KEYWORDS = " or ".join(
    f"(starts_with(t, '{k}') and length(t) <= {len(k) + 8})" for k in rules.HEADING_KEYWORDS)
_REST = r"regexp_extract(t, '^[0-9]{1,2}(?:[\s\p{Z}]+|[、.．])[\s\p{Z}]*([^\s\p{Z}0-9].*)$', 1)"
HEADING = (
    "(t <> '' and length(t) <= 40 and not contains('。！？!?；;：:，,、', right(t, 1)) and not regexp_matches(t, "
    "'^[0-9]{1,2}([.．][0-9]{1,2}){1,3}') and not regexp_matches(t, '^[（(][" + _CN + "]{1,3}[)）]') and ("
    "regexp_matches(t, '^第[" + _CN + "0-9]{1,4}([章节篇]|部分)') or regexp_matches(t, '^[" + _CN +
    r"]{1,3}[、.．][\s\p{Z}]*[^\s\p{Z}]') or length(regexp_replace(" + _REST + ", '[^一-鿿]', '', 'g')) >= 2 or "
    + _KEYWORDS + "))")


def paragraph_ctes(source):
    return (
        f"paras as materialized (select doc_id, unnest(range(len(paras)))::int pos, unnest(paras) para from {source})",
        f"flagged as materialized (select doc_id, pos, para, t, {HEADING} is_heading from (select *, "
        f"{d_strip('para')} t from paras))",
        "runs as (select *, pos - row_number() over (partition by doc_id, is_heading order by pos) run from flagged)",
        "toc as materialized (select doc_id, pos, para, t, is_heading, is_heading and count(*) over (partition by "
        "doc_id, is_heading, run) >= 3 in_toc from runs)",
    )


def _flag_rows(docs, column):
    return docs.select("doc_id", F.posexplode(column).alias("pos", "flag"))


@check("detect_headings", "select doc_id, pos, is_heading flag from flagged", (), (DENSE, *paragraph_ctes("dense")))
def _(d):
    return _flag_rows(sg.detect_headings(dense(d)), "is_heading")


@check("toc_mask", "select doc_id, pos, in_toc flag from toc", (), (DENSE, *paragraph_ctes("dense")))
def _(d):
    return _flag_rows(sg.detect_headings(dense(d)).withColumn("toc", sg.toc_mask(F.col("is_heading"))), "toc")


@check("research_design_section", f"select doc_id, {DESIGN_TEXT} section from design", ("para_docs",), (DESIGN_DUCK,))
def _(d):
    return d.para_docs.select("doc_id", sg.design_section(F.col("paras")).alias("section"))


# --- chapters ---------------------------------------------------------------

def _digit(e):
    pairs = " ".join(f"when '{k}' then {v}" for k, v in rules.CN_DIGITS.items())
    return f"case {e} {pairs} end"


_NUMBER = (
    f"case when regexp_matches(s, '^[0-9]+$') then s::int when length(s) = 1 then {_digit('s')} "
    f"when s[1:1] = '十' then case when length(s) = 2 then 10 + {_digit('s[2:2]')} end "
    f"when length(s) = 2 and s[2:2] = '十' then case when {_digit('s[1:1]')} > 0 then {_digit('s[1:1]')} * 10 end "
    f"when length(s) = 3 and s[2:2] = '十' then case when {_digit('s[1:1]')} > 0 then {_digit('s[1:1]')} * 10 + "
    f"{_digit('s[3:3]')} end end")
_ROLE = "case " + " ".join(
    f"when regexp_matches(title, '{'|'.join(words)}') then '{role}'" for role, words in rules.ROLE_RULES) + " end"


def role_sql(position, total):
    return (
        f"case when title = '前置内容' then '背景说明' else coalesce({_ROLE}, case when {position} <= 1 then '背景说明' "
        f"when {position} >= {total} - 1 then '研究空白' else '概念解释' end) end section_role, "
        f"case when title = '前置内容' then 'medium' when {_ROLE} is not null then 'high' when {position} <= 1 or "
        f"{position} >= {total} - 1 then 'medium' else 'low' end tag_confidence")


def chapter_ctes(source):
    """chapters(doc_id, chapter_index, title, paras, section_role, tag_confidence)."""
    di = f"regexp_extract(t, '^第([{_CN}0-9]{{1,4}})(?:[章节篇]|部分)', 1)"
    cn = f"regexp_extract(t, '^([{_CN}]{{1,3}})[、.．]', 1)"
    ar = r"regexp_extract(t, '^([0-9]{1,2})(?:[\s\p{Z}]+|[、.．])', 1)"
    return (
        *paragraph_ctes(source),
        f"numbered as (select doc_id, pos, case when {di} <> '' then 'di' when {cn} <> '' then 'cn' else 'ar' end "
        f"style, case when {di} <> '' then {di} when {cn} <> '' then {cn} else {ar} end s from toc "
        "where is_heading and not in_toc)",
        f"ordinals as (select doc_id, pos, style, {_NUMBER} num from numbered)",
        "folded as (select doc_id, style, list_reduce(list({'last': num, 'kept': [pos]} order by pos), lambda a, x: "
        "case when (a.last is null and x.last in (0, 1)) or x.last = a.last + 1 then "
        "{'last': x.last, 'kept': list_concat(a.kept, x.kept)} else a end, "
        "{'last': null::int, 'kept': []::int[]}) r from ordinals where num is not null group by all)",
        "accepted as (select doc_id, pos from ordinals where num is null union all "
        "select doc_id, unnest(r.kept) from folded)",
        "grouped as (select p.doc_id, p.pos, p.para, t, a.pos is not null is_start, count(a.pos) over (partition by "
        "p.doc_id order by p.pos) g from toc p left join accepted a on a.doc_id = p.doc_id and a.pos = p.pos)",
        "bodies as (select doc_id, g, coalesce(max(case when is_start then t end), '前置内容') title, "
        "coalesce(list(para order by pos) filter (where not is_start), []) paras, max(g = total) is_last from (select "
        "*, max(g) over (partition by doc_id) total from grouped) group by doc_id, g)",
        "kept as (select *, sum(len(paras)) over (partition by doc_id order by g) so_far from bodies)",
        "placed as (select doc_id, title, paras, (row_number() over (partition by doc_id order by g) - 1)::int "
        "chapter_index, count(*) over (partition by doc_id) total from kept where is_last or so_far > 0)",
        f"chapters as materialized (select doc_id, chapter_index, title, paras, {role_sql('chapter_index', 'total')} "
        "from placed)",
    )


CHAPTER_SQL = ("select doc_id, chapter_index, title, section_role, tag_confidence, len(paras)::int paras, "
               "length(array_to_string(paras, '')) chars from chapters")


def _chapter_rows(docs):
    return sg.chapter_rows(sg.split_chapters(docs), "doc_id").withColumns({
        "chars": F.length(F.array_join("paras", "")), "paras": F.size("paras")})


@check("split_chapters", CHAPTER_SQL, (), (DENSE, *chapter_ctes("dense")))
def _(d):
    return _chapter_rows(dense(d))


@check("split_chapters_regular", CHAPTER_SQL, ("para_docs",), chapter_ctes("para_docs"))
def _(d):
    return _chapter_rows(d.para_docs)


@check("classify_chapter_role", f"select doc_id, pos, {role_sql('pos', 'total')} from (select doc_id, pos, "
                                f"{d_strip('para')} title, count(*) over (partition by doc_id) total from paras)",
       (), (DENSE, *paragraph_ctes("dense")))
def _(d):
    # counted below the lines, which would each carry the whole list otherwise
    sized = dense(d).withColumn("total", F.size("paras"))
    rows = sized.select("doc_id", "total", F.posexplode("paras").alias("pos", "title"))
    role, confidence = sg.chapter_role(strip("title"), F.col("pos"), F.col("total"))
    return rows.select("doc_id", "pos", role.alias("section_role"), confidence.alias("tag_confidence"))


# --- sentences and chunks ---------------------------------------------------

def d_sentences(e):
    flat = rf"regexp_replace({e}, '[\s\p{{Z}}]*\n[\s\p{{Z}}]*', '', 'g')"
    marked = rf"regexp_replace(regexp_replace({flat}, '([。！？!?；;])', '\1' || chr(1), 'g'), '\.[\s\p{{Z}}]+', " \
             "'.' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {d_strip('x')}), lambda x: x <> '')"


def d_join(e):
    lines = f"list_filter(list_transform({e}, lambda x: {d_strip('x')}), lambda x: x <> '')"
    ended = f"list_transform({lines}, lambda x: case when regexp_matches(x, '[。！？!?；;…]$') then x || chr(10) else x end)"
    return d_strip(f"array_to_string({ended}, '')")


@check("split_sentences", "select doc_id, unnest(range(len(s)))::int pos, unnest(s) sentence from (select doc_id, "
                          f"{d_sentences('text')} s from documents)")
def _(d):
    return d.documents.select("doc_id", F.posexplode(sg.split_sentences(F.col("text"))).alias("pos", "sentence"))


@check("join_fragments", f"select doc_id, {d_join('paras')} joined from para_docs", ("para_docs",))
def _(d):
    return d.para_docs.select("doc_id", sg.join_fragments(F.col("paras")).alias("joined"))


def _state(done, buf):
    return f"{{'done': {done}, 'buf': {buf}, 'over': false}}"


def d_fold(units):
    """Packing fold over a list of {done, buf, over} structs, with the tail rule."""
    merged = "length(st.buf) + length(un.buf)"
    flushed = "case when st.buf = '' then st.done else list_append(st.done, st.buf) end"
    fold = (
        f"list_reduce({units}, lambda st, un: case when un.over then {_state(f'list_concat({flushed}, un.done)', chr(39) * 2)} "
        f"when st.buf = '' or {merged} <= 500 or ({merged} <= 620 and abs({merged} - 500) <= abs(length(st.buf) - 500)) "
        f"then {_state('st.done', 'st.buf || un.buf')} else {_state('list_append(st.done, st.buf)', 'un.buf')} end, "
        f"{_state('[]::varchar[]', chr(39) * 2)})")
    finish = (
        "lambda r: case when r.buf = '' then r.done when len(r.done) > 0 and length(r.buf) < 120 and "
        "length(r.done[-1]) + length(r.buf) <= 620 then list_append(r.done[1:len(r.done) - 1], r.done[-1] || r.buf) "
        "else list_append(r.done, r.buf) end")
    return f"list_transform([{fold}], {finish})[1]"


def d_pack(units):
    cut = ("lambda x: case when length(x) > 620 then list_transform(range(0, length(x), 500), lambda i: "
           "substr(x, i + 1, 500)) else [x] end")
    parts = f"flatten(list_transform({d_sentences('t')}, {cut}))"
    simple = "list_transform(q, lambda x: {'done': []::varchar[], 'buf': x, 'over': false})"
    pieces = f"list_transform([{parts}], lambda q: case when len(q) <= 1 then q else {d_fold(simple)} end)[1]"
    prepared = (f"list_transform({units}, lambda t: case when length(t) > 620 then {{'done': {pieces}, 'buf': '', "
                "'over': true} else {'done': []::varchar[], 'buf': t, 'over': false} end)")
    return d_fold(prepared)


_UNITS = f"list_filter(list_transform(paras, lambda x: {d_strip('x')}), lambda x: x <> '')"


@check("pack_greedy", "select doc_id, unnest(range(len(c)))::int pos, unnest(c) chunk from (select doc_id, "
                      f"{d_pack(_UNITS)} c from (select doc_id, string_split(text, chr(10)) paras from documents))")
def _(d):
    docs = d.documents.select("doc_id", pk.paragraph_units(F.split("text", "\n")).alias("units"))
    return docs.select("doc_id", F.posexplode(pk.pack_greedy(F.col("units"))).alias("pos", "chunk"))


@check("sliding_chunks",
       "select doc_id, (i // 400)::int chunk_index, i::int offset_start, substr(text, i + 1, 500) chunk_text from (select "
       "doc_id, text, unnest(range(0, greatest(length(text) - 100, 1), 400)) i from documents where length(text) > 0)")
def _(d):
    rows = d.documents.select("doc_id", F.explode(pk.sliding_chunks(F.col("text"))).alias("c"))
    return rows.select("doc_id", "c.chunk_index", "c.offset_start", "c.chunk_text")


def chunk_sql(texts, method):
    return (
        "select concat(doc_id::varchar, '::', n::varchar) chunk_id, doc_id::varchar paper_id, n::int chunk_index, "
        "(coalesce(sum(length(text)) over (partition by doc_id order by n rows between unbounded preceding and 1 "
        f"preceding), 0))::int offset_start, text chunk_text, title chapter_title, chapter_index, section_role, "
        f"tag_confidence, '{method}' split_method from (select *, row_number() over (partition by doc_id order by "
        f"chapter_index, k) - 1 n from (select doc_id, chapter_index, title, section_role, tag_confidence, k, "
        f"{d_strip('c[k]')} text from (select *, unnest(range(1, len(c) + 1)) k from (select *, {texts} c "
        "from chapters))) where text <> '')")


def _chunks(d, method):
    docs = d.para_docs.select(F.col("doc_id").cast("string").alias("paper_id"), "paras")
    return pk.chunk_papers(docs, method).drop("paragraph_index")


@check("chunk_papers", chunk_sql(d_pack(_UNITS), "length_greedy"), ("para_docs",), chapter_ctes("para_docs"))
def _(d):
    return _chunks(d, "greedy")


@check("chunk_papers_legacy",
       "select concat(doc_id::varchar, '::', (i // 400)::varchar) chunk_id, doc_id::varchar paper_id, (i // 400)::int "
       "chunk_index, i::int offset_start, substr(t, i + 1, 500) chunk_text, '' chapter_title, -1 chapter_index, '' "
       "section_role, '' tag_confidence, 'legacy_window' split_method from (select doc_id, t, unnest(range(0, "
       "greatest(length(t) - 100, 1), 400)) i from (select doc_id, array_to_string(paras, chr(10) || chr(10)) t "
       "from para_docs) where length(t) > 0)", ("para_docs",))
def _(d):
    return _chunks(d, "legacy")


# --- vectors and semantic segments ------------------------------------------

_HEX = "('0x' || substr(md5(w), 1, 7))::int"


def hashed_ctes(name, source, keys, text):
    """{name}(keys, dim, value): unit vectors of texts, long form, zero dims left out."""
    return (
        f"{name}_codes as (select {keys}, {_HEX} % 64 dim, case when substr(md5(w), 8, 1) < '8' then 1 else -1 end s "
        f"from (select {keys}, unnest({d_tok(text)}) w from {source}))",
        f"{name}_sums as (select {keys}, dim, sum(s)::double v from {name}_codes group by all)",
        f"{name} as materialized (select {keys}, dim, v / nullif(sqrt(sum(v * v) over (partition by {keys})), 0) val "
        f"from {name}_sums)",
    )


@check("embed_texts", "select doc_id, dim, round(val::float::double, 6) val from vec where abs(val) > 0", (),
       hashed_ctes("vec", "documents", "doc_id", "text"))
def _(d):
    vectors = embed_texts(d.documents, "text", "vector").select("doc_id", F.posexplode("vector").alias("dim", "val"))
    return vectors.filter(F.col("val") != 0).select(
        "doc_id", F.col("dim").alias("dim"), r6(F.col("val").cast("double"), "val"))


SEMANTIC = (
    *chapter_ctes("para_docs"),
    f"sents as materialized (select doc_id, chapter_index, title, section_role, tag_confidence, {d_sentences(d_join('paras'))} "
    "s from chapters)",
    "sent_rows as (select doc_id, chapter_index, unnest(range(len(s))) n, unnest(s) sentence from sents "
    "where len(s) >= 6)",
    *hashed_ctes("vec", "sent_rows", "doc_id, chapter_index, n", "sentence"),
    "near as (select a.doc_id, a.chapter_index, a.n, sum(a.val * b.val) d from vec a join vec b on b.doc_id = a.doc_id "
    "and b.chapter_index = a.chapter_index and b.n = a.n + 1 and b.dim = a.dim group by all)",
    "sims as materialized (select r.doc_id, r.chapter_index, list(round(coalesce(d, 0), 12) order by r.n) sims from "
    "sent_rows r join sents s on s.doc_id = r.doc_id and s.chapter_index = r.chapter_index left join near e on "
    "e.doc_id = r.doc_id and e.chapter_index = r.chapter_index and e.n = r.n where r.n < len(s.s) - 1 group by all)",
    "limits as (select *, round(list_avg(sims) - list_stddev_pop(sims), 12) lim, len(sims) + 1 total from sims)",
    """valleys as (select *, list_reduce(list_transform(range(len(sims)), lambda i: {'last': i + 1, 'ends': case when
      sims[i + 1] < lim then [i + 1] else []::bigint[] end}), lambda a, x: case when len(x.ends) > 0 and
      x.last - a.last >= 3 then {'last': x.last, 'ends': list_concat(a.ends, x.ends)} else a end,
      {'last': 0::bigint, 'ends': []::bigint[]}).ends ends from limits)""",
    """bounds as (select doc_id, chapter_index, list_reduce(list_transform(list_append(ends, total), lambda e:
      {'last': e, 'ends': []::bigint[]}), lambda a, b: list_transform([list_reduce(list_transform(
        range((b.last - a.last) // 3 + 1), lambda i: {'last': 0::bigint, 'ends': []::bigint[]}),
        lambda t, z: case when b.last - t.last > 15 and len(sims[t.last + 3:t.last + 15]) > 0 then
          list_transform([t.last + 2 + list_position(sims[t.last + 3:t.last + 15],
            list_min(sims[t.last + 3:t.last + 15]))], lambda c: {'last': c, 'ends': list_append(t.ends, c)})[1] else t end, a)],
        lambda f: {'last': b.last, 'ends': list_append(f.ends, b.last)})[1],
      {'last': 0::bigint, 'ends': []::bigint[]}).ends ends from valleys)""",
    """pieces as materialized (select s.*, case when len(s.s) < 6 then s.s else list_filter(list_transform(
      range(1, len(b.ends) + 1), lambda i: array_to_string(s.s[(case when i = 1 then 0 else b.ends[i - 1] end) + 1:b.ends[i]], '')),
      lambda x: x <> '') end units from sents s left join bounds b on b.doc_id = s.doc_id and b.chapter_index = s.chapter_index)""",
)


@check("segment_semantic",
       "select doc_id, chapter_index, unnest(range(len(c)))::int pos, unnest(c) chunk from (select doc_id, "
       f"chapter_index, {d_pack('units')} c from pieces)", ("para_docs",), SEMANTIC)
def _(d):
    rows = sg.chapter_rows(sg.split_chapters(d.para_docs), "doc_id")
    rows = rows.withColumn("sentences", sg.split_sentences(sg.join_fragments(F.col("paras"))))
    out = pk.segment_semantic(rows.select("doc_id", "chapter_index", "sentences"))
    return out.select("doc_id", "chapter_index", F.posexplode("chunks").alias("pos", "chunk"))


@check("chunk_papers_semantic", chunk_sql(d_pack("units"), "semantic_boundary").replace("from chapters", "from pieces"),
       ("para_docs",), SEMANTIC)
def _(d):
    return _chunks(d, "semantic")
