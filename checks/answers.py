"""Checks of evidence tables, prompt contexts and generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import contexts as cx
from scriptorium.operators import evidence as ev
from scriptorium.operators import generations as gn
from scriptorium.operators.fusion import rrf_fuse
from scriptorium.operators.ranking import precision_filter

from .corpus import WORDS, arms
from .registry import check, d_strip, precision_ctes, r6, ranked_cte, rrf_cte, vector_ctes

GOLDEN = (
    *WORDS, ranked_cte("w_hits", "w_scores", 200), *vector_ctes("v", "queries", 0.2),
    rrf_cte("fused", "w_hits", "v_hits", 400), *precision_ctes("golden", "fused"))
SELECTED = (
    *GOLDEN,
    "facts as (select query_id, count(*) n, max(case when rank = 2 then score end) s2, max(case when rank = 3 then "
    "score end) s3 from golden where rank <= 5 group by 1)",
    "selected as materialized (select g.query_id, g.paper_id, g.score, g.rank, n >= 5 and not (s3 < 0.5 * s2) "
    "sufficient from golden g join facts using (query_id) where rank <= case when n >= 5 and not (s3 < 0.5 * s2) "
    "then 5 else 3 end)")
EVIDENCE = (
    *SELECTED,
    "scored as (select s.query_id, s.paper_id, s.rank, c.chunk_id, c.chunk_index, c.chunk_text, c.section_role, "
    "c.chapter_title, list_cosine_similarity(c.embedding::double[], q.q_vec::double[]) score, row_number() over "
    "(partition by s.query_id, s.paper_id order by round(list_cosine_similarity(c.embedding::double[], "
    "q.q_vec::double[]), 6) desc, c.chunk_index, c.chunk_id) m from selected s join queries q using (query_id) join "
    "chunks c using (paper_id) where c.section_role <> '其他')",
    "taken as materialized (select *, row_number() over (partition by query_id order by rank, paper_id, m) ref_id "
    "from scored where m <= 3)",
    "evidence as materialized (select s.query_id, s.paper_id, s.rank, s.score, p.title, p.doi, p.author, p.keywords, "
    "p.abstract, p.research_design_text, p.source_journal journal, coalesce(p.publish_year, 0) publish_year, "
    "coalesce(t.chunk_text, '') top_chunk_text, coalesce(t.score, 0.0) relevance from selected s join papers p "
    "using (paper_id) left join taken t on t.query_id = s.query_id and t.paper_id = s.paper_id and t.m = 1)")
VIEWS = ("papers", "chunks", "queries")


def golden(d):
    return precision_filter(rrf_fuse(*arms(d)))


def evidence(d, per_paper=3):
    return ev.pack_evidence(ev.select_evidence(golden(d)), d.papers, d.chunks, d.queries, per_paper)


@check("select_evidence", "select query_id, paper_id, round(score, 6) score, rank::int rank, sufficient "
                          "evidence_sufficient from selected", VIEWS, SELECTED)
def _(d):
    return ev.select_evidence(golden(d)).select(
        "query_id", "paper_id", r6("score", "score"), "rank", "evidence_sufficient")


@check("pack_evidence",
       "select e.query_id, e.paper_id, e.rank::int rank, title, top_chunk_text, round(relevance, 6) relevance_score, "
       "refs from evidence e left join (select query_id, paper_id, string_agg(concat(ref_id, '=', chunk_id, '=', "
       "section_role), '|' order by ref_id) refs from taken group by all) r on r.query_id = e.query_id and "
       "r.paper_id = e.paper_id", VIEWS, EVIDENCE)
def _(d):
    refs = F.array_join(F.transform("chunks", lambda c: F.concat(
        c.ref_id.cast("string"), F.lit("="), c.chunk_id, F.lit("="), c.section_role)), "|")
    return evidence(d).select("query_id", "paper_id", "rank", "title", "top_chunk_text",
                              r6("relevance_score", "relevance_score"), F.nullif(refs, F.lit("")).alias("refs"))


@check("pack_evidence_by_length",
       "select query_id, paper_id, chunk_text top_chunk_text, 0.0::double relevance_score from (select s.query_id, "
       "s.paper_id, c.chunk_text, row_number() over (partition by s.query_id, s.paper_id order by strlen(c.chunk_text) "
       "desc, chunk_index, chunk_id) m from selected s join chunks c using (paper_id) where section_role <> '其他') "
       "where m = 1 union all select query_id, paper_id, '', 0.0 from selected where paper_id not in (select paper_id "
       "from chunks where section_role <> '其他')", VIEWS, SELECTED)
def _(d):
    none = d.queries.select("query_id", F.lit(None).cast("array<float>").alias("q_vec"))
    out = ev.pack_evidence(ev.select_evidence(golden(d)), d.papers, d.chunks, none, 1)
    return out.select("query_id", "paper_id", "top_chunk_text", r6("relevance_score", "relevance_score"))


@check("citations",
       "select t.query_id, ref_id::int ref_id, chunk_id, chunk_index, t.paper_id, title, author, publish_year \"year\", "
       "journal, doi, chapter_title, section_role, chunk_text \"text\" from taken t join evidence e on "
       "e.query_id = t.query_id and e.paper_id = t.paper_id", VIEWS, EVIDENCE)
def _(d):
    return ev.chunk_citations(evidence(d))


@check("paper_citations",
       "select query_id, paper_id, title, author, keywords, abstract, doi, publish_year, round(relevance, 6) "
       "relevance_score, top_chunk_text from evidence", VIEWS, EVIDENCE)
def _(d):
    out = ev.paper_citations(evidence(d, 1))
    return out.withColumn("relevance_score", F.round("relevance_score", 6))


@check("qa_references",
       "select e.query_id, e.paper_id, title, author, publish_year \"year\", doi, journal, top_chunk_text snippet, "
       "row_number() over (partition by e.query_id order by e.rank)::int rank, round(e.score, 6) score, case when "
       "w.paper_id is not null and v.paper_id is not null then '关键词+语义' when v.paper_id is not null then '语义' else "
       "'关键词' end matched_by from evidence e left join w_hits w on w.query_id = e.query_id and w.paper_id = e.paper_id "
       "left join v_hits v on v.query_id = e.query_id and v.paper_id = e.paper_id", VIEWS, EVIDENCE)
def _(d):
    words, vectors = arms(d)
    selected = ev.select_evidence(precision_filter(rrf_fuse(words, vectors)))
    packed = ev.pack_evidence(selected, d.papers, d.chunks, d.queries, 3)
    return ev.qa_references(packed, selected, words, vectors).withColumn("score", F.round("score", 6))


@check("pasted_evidence",
       f"select doc_id query_id, '' paper_id, 1 rank, coalesce(nullif({d_strip('t')}, ''), '用户提供文本') title, "
       f"{d_strip('text')} top_chunk_text, length({d_strip('text')}) chars from (select doc_id, text, case when "
       "doc_id % 3 = 0 then '  ' else lang end t from documents)")
def _(d):
    requests = d.documents.select(
        F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(
            F.col("lang")).alias("title"), F.lit("").alias("author"), F.lit("").alias("doi"),
        F.lit(2020).alias("publish_year"), "text")
    out = ev.pasted_evidence(requests)
    return out.select("query_id", "paper_id", "rank", "title", "top_chunk_text",
                      F.length("abstract").alias("chars"))


# every paper is asked with words taken from its second line
QUESTION = "concat(split_part(research_design_text, ' ', 2), '，', split_part(keywords, ';', 3), ' an; of、zzz')"


@check("pick_snippets",
       "select paper_id query_id, paper_id, n::int snippet_no, case when length(p) > 300 then concat(substr(p, 1, 300), "
       f"'…') else p end snippet from (select paper_id, p, row_number() over (partition by paper_id order by i) n from "
       f"(select paper_id, words, i, {d_strip('lines[i]')} p from (select paper_id, words, lines, unnest(range(1, "
       "len(lines) + 1)) i from asked)) where p <> '' and len(list_filter(words, lambda w: contains(p, w))) > 0) "
       "where n <= 3", ("papers",), (
           f"asked as materialized (select paper_id, string_split({d_strip('raw_body')}, chr(10)) lines, list_filter("
           f"regexp_split_to_array({QUESTION}, '[,，;；、\\s\\p{{Z}}]+'), lambda w: length(w) >= 2) words from papers)",))
def _(d):
    requests = d.papers.select(F.col("paper_id").alias("query_id"), "paper_id", F.expr(QUESTION).alias("question"))
    return ev.pick_snippets(requests, d.papers)


# --- contexts ---------------------------------------------------------------

def _or(c, other):
    return f"coalesce(nullif({d_strip(c)}, ''), {other})"


_NP = "'（未提供）'"
_TITLE, _DOI = _or("title", "paper_id"), _or("doi", "concat('PaperID:', paper_id)")


@check("build_contexts_review",
       "select query_id, string_agg(concat('【核心文献 ', rank, '】', chr(10), '标题: ', " + _TITLE + ", ' | DOI: ', " + _DOI
       + ", ' | 发表年份: ', publish_year, chr(10), '作者: ', " + _or("author", _NP) + ", chr(10), '关键词: ', "
       + _or("keywords", _NP) + ", chr(10), '摘要: ', " + _or("abstract", _NP) + ", chr(10), '相关语义片段: ', "
       + _or("top_chunk_text", _NP) + ", chr(10), '独立研究设计原文: ', " + _or("research_design_text", _NP)
       + ", chr(10)), chr(10) || chr(10) order by rank) context from evidence group by 1", VIEWS, EVIDENCE)
def _(d):
    return cx.review_contexts(evidence(d, 1))


@check("build_contexts_qa",
       "select query_id, string_agg(block, chr(10) || chr(10) order by n) context from (select t.query_id, ref_id n, "
       "concat('【证据', ref_id, '】（段落作用: ', section_role, ' | 章节: ', chapter_title, '）', " + _TITLE
       + ", '|', " + _DOI + ", '|', publish_year, chr(10), " + d_strip("chunk_text") + ") block from taken t join "
       "(select query_id, paper_id, title, doi, publish_year from evidence) e using (query_id, paper_id) union all "
       "select query_id, rank, concat('【证据', rank, '】', " + _TITLE + ", '|', " + _DOI + ", '|', publish_year, chr(10), "
       "'摘要片段: ', " + _or("top_chunk_text", _NP) + ", chr(10), '研究设计: ', coalesce(nullif(case when length("
       + d_strip("research_design_text") + ") > 800 then concat(substr(" + d_strip("research_design_text")
       + ", 1, 800), '…') else " + d_strip("research_design_text") + " end, ''), " + _NP + ")) from evidence where "
       "query_id not in (select query_id from taken)) group by 1", VIEWS, EVIDENCE)
def _(d):
    return cx.qa_contexts(evidence(d))


_HEADER = ("concat('标题: ', " + _TITLE + ", chr(10), '作者: ', " + _or("author", _NP) + ", chr(10), 'DOI: ', "
           + _or("doi", _NP) + ", ' | 期刊: ', " + _or("source_journal", _NP) + ", ' | 年份: ', coalesce("
           "publish_year::varchar, '未知'), chr(10), '关键词: ', " + _or("keywords", _NP) + ", chr(10), '摘要: ', "
           + _or("abstract", _NP) + ")")


def _body(limit):
    full = d_strip("raw_body")
    return f"nullif(case when length({full}) > {limit} then concat(substr({full}, 1, {limit}), '…') else {full} end, '')"


def _paper_sql(summary, chat):
    return (
        "select paper_id, 'summary' task, concat(" + _HEADER + ", chr(10), chr(10), '论文全文：', chr(10), coalesce("
        + summary + ", nullif(" + d_strip("abstract") + ", ''), '（未提供全文）')) context from papers union all "
        "select paper_id, 'chat', concat(" + _HEADER + ", chr(10), chr(10), '研究设计原文: ', "
        + _or("research_design_text", _NP) + ", chr(10), chr(10), '论文全文：', chr(10), coalesce(" + chat
        + ", '（未提供全文）'), chr(10), chr(10), '用户问题：', 'What is new?') from papers")


def _paper_contexts(d, **limits):
    summary = cx.paper_contexts(d.papers, "summary", **limits)
    chat = cx.paper_contexts(d.papers, "chat", F.lit("What is new?"), **limits)
    return summary.withColumn("task", F.lit("summary")).unionByName(chat.withColumn("task", F.lit("chat")))


@check("build_contexts_paper", _paper_sql(_body(6000), _body(8000)), ("papers",))
def _(d):
    return _paper_contexts(d)


_WHOLE = f"nullif({d_strip('raw_body')}, '')"


@check("build_contexts_paper_whole", _paper_sql(_WHOLE, _WHOLE), ("papers",))
def _(d):
    """Contexts with whole bodies, however long."""
    return _paper_contexts(d, body_limit=0)


# --- generated text ---------------------------------------------------------

# model outputs made from whole documents: plain, fenced, small talk, JSON, JSON in text, broken JSON, JSON list, small talk
# and text in one line; inside JSON the text is without the characters that would end a string
_FLAT = "raw_body"
for _c in ("chr(92)", "chr(34)", "chr(9)", "chr(10)", "chr(13)"):
    _FLAT = f"replace({_FLAT}, {_c}, ' ')"
_RAW = f"""case cast(paper_id as bigint) % 8
  when 0 then raw_body
  when 1 then concat('```markdown', chr(10), raw_body, chr(10), '```')
  when 2 then concat(' 好的，以下是回答：', chr(10), chr(10), raw_body)
  when 3 then concat('```json', chr(10), '{{"summary": "', {_FLAT}, '", "method": " m ", "keywords": "a，b a;c"}}', chr(10), '```')
  when 4 then concat('Answer: {{"summary": "", "result": "', {_FLAT}, '", "keywords": ["x", " ", "y"]}} end')
  when 5 then concat('{{"summary": "broken ', {_FLAT})
  when 6 then concat('["summary", "', {_FLAT}, '"]')
  else concat('收到', raw_body) end"""
_TASK = "case when cast(paper_id as bigint) % 8 in (3, 4, 5, 6) then 'summary' else 'qa' end"

GENERATED = (
    f"outputs as materialized (select paper_id, {_TASK} task, {_RAW} raw, abstract, keywords from papers)",
    rf"""bare as materialized (select *, {d_strip('raw')} s0 from outputs)""",
    rf"""fenced as materialized (select *, {d_strip(r"case when starts_with(s0, '```') then regexp_replace(regexp_replace(s0, '^```[a-zA-Z]*[\s\p{Z}]*', ''), '[\s\p{Z}]*```[\s\p{Z}]*$', '') else s0 end")} s from bare)""",
    r"""parsed as materialized (select *, case when task = 'summary' then case when json_valid(s) then case when
      json_type(s::json) = 'OBJECT' then s::json end when json_valid(regexp_extract(s, '(?s)\{.*\}')) then
      regexp_extract(s, '(?s)\{.*\}')::json end end doc, regexp_replace(s, '^[\s\p{Z}]+', '') t from fenced)""",
    r"""split as materialized (select *, split_part(t, chr(10), 1) line1, case when contains(t, chr(10)) then
      regexp_replace(substr(t, instr(t, chr(10)) + 1), '^[\s\p{Z}]+', '') else '' end rest from parsed)""",
)


def _words(e):
    parts = f"list_filter(regexp_split_to_array({e}, '[,，;；、\\s\\p{{Z}}]+'), lambda w: w <> '')"
    return f"list_filter({parts}, lambda w, i: list_position({parts}, w) = i)"


@check("load_generations",
       "select paper_id gen_id, paper_id, task, case when task <> 'summary' then case when length(line1) <= 50 and "
       "regexp_matches(line1, '^(好的|作为|以下是|以下，|我将|我会|根据您|根据你|首先，我|明白|收到)') and rest <> '' then rest "
       "else t end end \"text\", "
       f"case when task = 'summary' then {d_strip('''coalesce(nullif(doc->>'$.summary', ''), ''' + d_strip('abstract') + ')')} end summary, "
       "case when task = 'summary' then trim(coalesce(doc->>'$.method', '')) end \"method\", "
       "case when task = 'summary' then trim(coalesce(doc->>'$.result', '')) end result, "
       "case when task = 'summary' then array_to_string(case when len(kw) > 0 then kw else "
       + _words("keywords") + " end, '|') end keywords from (select *, case json_type(doc, '$.keywords') when 'VARCHAR' "
       "then " + _words("(doc->>'$.keywords')") + " when 'ARRAY' then list_filter(list_transform(from_json("
       "doc->'$.keywords', '[\"varchar\"]'), lambda x: trim(x)), lambda x: x <> '') else []::varchar[] end kw from split)",
       ("papers",), GENERATED)
def _(d):
    outputs = d.papers.select(F.col("paper_id").alias("gen_id"), "paper_id", F.expr(_TASK).alias("task"),
                              F.expr(_RAW).alias("raw"))
    out = gn.load_generations(outputs, d.papers)
    return out.withColumn("keywords", F.when(F.col("task") == "summary", F.array_join("keywords", "|")))


# answers: whole documents, a section heading before every third line, reference marks on all
_ANSWER_SPARK = """select doc_id query_id, array_join(transform(split(text, '\\\\n'), (l, i) -> case
  when i % 3 = 1 then concat('## ', get(array('概念解释', '背景说明', '方法依据', '经验证据', '研究空白', '其他'), cast(floor(i / 3) as int) % 6), '：', '\\n') else '' end
  || concat(l, ' [', cast(i + 1 as string), '][', cast(doc_id % 17 as string), '] [1234]')), '\\n') text
  from {documents}"""
ANSWERS = (
    """answers as materialized (select doc_id query_id, array_to_string(list_transform(range(len(l)), lambda i: case
      when i % 3 = 1 then concat('## ', list_extract(['概念解释', '背景说明', '方法依据', '经验证据', '研究空白', '其他'], (i // 3) % 6 + 1), '：', chr(10)) else '' end
      || concat(l[i + 1], ' [', i + 1, '][', doc_id % 17, '] [1234]')), chr(10)) text
      from (select doc_id, string_split(text, chr(10)) l from documents))""",
    "cites as (select doc_id query_id, k ref_id, concat('c', k) chunk_id, concat('p', k % 3) paper_id from documents, "
    "range(1, 8) r(k))",
    r"""cut as materialized (select query_id, string_split(regexp_replace(text, '(?m)^##[\s\p{Z}]*(概念解释|背景说明|方法依据|经验证据|研究空白)[：:\s\p{Z}]*$', chr(2) || '\1' || chr(2), 'g'), chr(2)) parts from answers)""",
    f"""sections as materialized (select query_id, i section_no, case when i = 0 then 'preamble' else parts[2 * i] end
      "role", case when len(parts) = 1 then parts[1] else {d_strip('parts[2 * i + 1]')} end body from (select *,
      unnest(range((len(parts) + 1) // 2)) i from cut))""",
    r"""marks as materialized (select query_id, section_no, unnest(regexp_extract_all(body, '\[([0-9]{1,3})\]', 1))::int
      ref_id from sections)""",
)


def answers(d):
    return d.spark.sql(_ANSWER_SPARK, documents=d.documents)


@check("answer_sections", "select query_id, section_no::int section_no, \"role\", body from sections", (), ANSWERS)
def _(d):
    return gn.answer_sections(answers(d))


@check("citation_audit",
       "select s.query_id, sections, coalesce(marks, 0) marks, coalesce(unknown, 0) unknown, coalesce(papers, 0) papers "
       "from (select query_id, count(distinct case when section_no > 0 then \"role\" end) sections from sections group "
       "by 1) s left join (select m.query_id, count(*) marks, count(*) filter (where c.ref_id is null) unknown, "
       "count(distinct c.paper_id) papers from marks m left join cites c on c.query_id = m.query_id and "
       "c.ref_id = m.ref_id group by 1) x on x.query_id = s.query_id", (), ANSWERS)
def _(d):
    k = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("ref_id")
    cites = d.documents.select(F.col("doc_id").alias("query_id"), k)
    cites = cites.withColumns({
        "chunk_id": F.concat(F.lit("c"), F.col("ref_id").cast("string")),
        "paper_id": F.concat(F.lit("p"), (F.col("ref_id") % 3).cast("string"))})
    return gn.citation_audit(answers(d), cites)
