"""Checks of search operators and whole searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators.bm25 import bm25_search
from scriptorium.operators.boolean import And, Not, Or, Term, boolean_search
from scriptorium.operators.filters import SearchFilters
from scriptorium.operators.rewrites import apply_rewrites, expand_query
from scriptorium.operators.vector import rank_chunks, vector_search
from scriptorium.plans import search
from scriptorium.scale import scratch_path
from scriptorium.sources.index import build_index, read_index, write_index

from .corpus import ALLOWED, FACET_ROWS, FILTER_QUERIES, WORDS, facet_sql, filter_queries
from .registry import (
    HITS_SQL, bm25_ctes, check, d_tok, hits_out, index_ctes, precision_ctes, r6, ranked_cte, rrf_cte,
    vector_ctes,
)


@check("bm25_search", HITS_SQL.format("w_hits"), ("papers", "queries"),
       (*WORDS, ranked_cte("w_hits", "w_scores", 50)))
def _(d):
    return hits_out(bm25_search(build_index(d.papers), d.queries.select("query_id", "q"), k=50))


def stored_index(d):
    """The index as written to shared storage and opened again."""
    path = scratch_path(d.spark, "index")
    write_index(d.papers, path, term_buckets=8)
    return read_index(d.spark, path)


@check("bm25_search_stored", HITS_SQL.format("w_hits"), ("papers", "queries"),
       (*WORDS, ranked_cte("w_hits", "w_scores", 50)))
def _(d):
    return hits_out(bm25_search(stored_index(d), d.queries.select("query_id", "q"), k=50))


@check("bm25_search_theme", HITS_SQL.format("w_hits"), ("papers", "queries"),
       (*index_ctes(), *bm25_ctes("w", "queries", mask="field in ('title', 'keywords', 'abstract')"),
        ranked_cte("w_hits", "w_scores", 500)))
def _(d):
    return hits_out(bm25_search(build_index(d.papers), d.queries.select("query_id", "q"), fields="theme"))


@check("bm25_search_filtered", HITS_SQL.format("w_hits"), ("papers", "queries"),
       (*WORDS, *FILTER_QUERIES,
        "w_allowed as (select w.* from w_scores w join fq using (query_id) join papers p using (paper_id) "
        f"where {ALLOWED})", ranked_cte("w_hits", "w_allowed", 200)))
def _(d):
    from scriptorium.operators.filters import allowed_merge

    scopes = allowed_merge(d.papers, filter_queries(d))
    return hits_out(bm25_search(build_index(d.papers), d.queries.select("query_id", "q"), scopes=scopes, k=200))


# --- boolean ----------------------------------------------------------------

EXPRESSIONS = {
    "and": And(Term("the"), Term("on")),
    "or_not": And(Or(Term("the"), Term("les")), Not(Term("der"))),
    "phrase": Term("of the"),
    "author": And(Term("Author3", "author"), Term("and", "abstract")),
    "year": Or(Term("2004", "year"), Term("2013", "year")),
    "not_journal": And(Not(Term("e", "journal")), Not(Term("zzz"))),
    "title_keywords": Or(Term("an", "title"), Term("brand#1", "keywords")),
    "nothing": Term("  "),
}


def _leaf(no, text, columns, fields):
    """CTEs of one text leaf: members with their scores."""
    names = ", ".join(f"'{f}'" for f in fields)
    contains = " or ".join(f"contains(lower(coalesce({c}, '')), '{text}')" for c in columns)
    return (
        f"q{no} as (select 'x' query_id, '{text}' q)",
        *bm25_ctes(f"b{no}", f"q{no}", mask=f"field in ({names})"),
        f"l{no} as materialized (select p.paper_id, coalesce(s.score, 0.1) score from papers p left join "
        f"b{no}_scores s on s.paper_id = p.paper_id where {contains})",
    )


ALL_COLUMNS = ("title", "keywords", "abstract", "research_design_text", "raw_body")
ALL_FIELDS = ("title", "keywords", "abstract", "research_design", "body")
LEAVES = (
    *_leaf(1, "the", ALL_COLUMNS, ALL_FIELDS), *_leaf(2, "on", ALL_COLUMNS, ALL_FIELDS),
    *_leaf(3, "les", ALL_COLUMNS, ALL_FIELDS), *_leaf(4, "der", ALL_COLUMNS, ALL_FIELDS),
    *_leaf(5, "of the", ALL_COLUMNS, ALL_FIELDS), *_leaf(6, "and", ("abstract",), ("abstract",)),
    *_leaf(7, "zzz", ALL_COLUMNS, ALL_FIELDS), *_leaf(8, "an", ("title",), ("title",)),
    *_leaf(9, "brand#1", ("keywords",), ("keywords",)),
    """b_scores as materialized (
      select 'and' query_id, l1.paper_id, l1.score + l2.score score from l1 join l2 using (paper_id)
      union all select 'or_not', paper_id, sum(score) from (select * from l1 union all select * from l3)
        where paper_id not in (select paper_id from l4) group by paper_id
      union all select 'phrase', paper_id, score from l5
      union all select 'author', l6.paper_id, l6.score from l6 join papers p using (paper_id)
        where contains(lower(author), 'author3')
      union all select 'year', paper_id, 0.0 from papers where contains(coalesce(publish_year, 0)::varchar, '2004')
        or contains(coalesce(publish_year, 0)::varchar, '2013')
      union all select 'not_journal', paper_id, 0.0 from papers where not contains(lower(source_journal), 'e')
        and paper_id not in (select paper_id from l7)
      union all select 'title_keywords', paper_id, sum(score) from (select * from l8 union all select * from l9)
        group by paper_id)""",
)


@check("boolean_search", "select query_id, paper_id, round(score, 6) score, rank::int rank from hits", ("papers",),
       (*index_ctes(), *LEAVES, ranked_cte("hits", "b_scores", 500)))
def _(d):
    hits = boolean_search(build_index(d.papers), d.papers, EXPRESSIONS)
    return hits.select("query_id", "paper_id", r6("score", "score"), F.col("rank").cast("int").alias("rank"))


# --- vectors ----------------------------------------------------------------

CHUNK_HITS = "select query_id, chunk_id, paper_id, chunk_index, round(score, 6) score, rank::int rank from v_chunks"


def _chunk_hits(hits):
    return hits.select("query_id", "chunk_id", "paper_id", "chunk_index", r6("score", "score"), F.col("rank").cast("int").alias("rank"))


@check("vector_search", CHUNK_HITS, ("chunks", "queries"), vector_ctes("v", "queries", 0.0))
def _(d):
    return _chunk_hits(vector_search(d.chunks, d.queries, None, 0.0, 200))


@check("vector_search_floor", CHUNK_HITS, ("chunks", "queries"), vector_ctes("v", "queries", 0.6))
def _(d):
    return _chunk_hits(vector_search(d.chunks, d.queries, None, 0.60, 200))


@check("rank_chunks",
       "select query_id, paper_id, chunk_id, round(score, 6) score, (row_number() over (partition by query_id, "
       "paper_id order by round(score, 6) desc, chunk_index, chunk_id))::int rank from (select q.query_id, c.paper_id, "
       "c.chunk_id, c.chunk_index, case when q.query_id % 4 = 0 then 0.0 else list_cosine_similarity("
       "c.embedding::double[], q.q_vec::double[]) end score from chunks c join queries q on c.paper_id = "
       "(q.query_id % 97)::varchar)", ("chunks", "queries"))
def _(d):
    vector = F.when(F.col("query_id") % 4 != 0, F.col("q_vec"))
    requests = d.queries.select(
        "query_id", (F.col("query_id") % 97).cast("string").alias("paper_id"), vector.alias("q_vec"))
    return rank_chunks(d.chunks, requests).select("query_id", "paper_id", "chunk_id", r6("score", "score"), F.col("rank").cast("int").alias("rank"))


# --- query analysis ---------------------------------------------------------

_LONG = f"list_filter({d_tok('q')}, lambda t: length(t) >= 2)"
ASKED = (
    "asked as materialized (select query_id, concat('published ', (1990 + query_id)::varchar, ' 深度学习 ', q) q, "
    "q_vec from queries)",
    f"long as materialized (select query_id, q, q_vec, {_LONG} w from asked)",
    "analysed as materialized (select query_id, q, q_vec, list_filter(w, lambda t, i: list_position(w, t) = i)[1:12] "
    "words, nullif(regexp_extract(q, '(?:19|20)[0-9]{2}'), '')::int y from long)",
)


def asked(d):
    text = F.concat(F.lit("published "), (1990 + F.col("query_id")).cast("string"), F.lit(" 深度学习 "), F.col("q"))
    return d.queries.withColumn("q", text)


@check("expand_query", "select query_id, q core, array_to_string(words, ' ') keywords, y \"year\" from analysed",
       ("queries",), ASKED)
def _(d):
    out = expand_query(asked(d))
    return out.select("query_id", "core", F.array_join("keywords", " ").alias("keywords"),
                      F.get("analysis_filter.years", F.lit(0)).alias("year"))


# payload kinds by query number: valid, scalars for lists, broken, unrelated, fenced, missing
_PAYLOAD = """case query_id % 6
  when 0 then concat('{"filter_conditions": {"publish_year": ', (2000 + query_id % 30)::{S},
    ', "authors": ["author1", " "], "is_core": true}, "boolean_query": " a AND b ", "search_payload": {"core_semantic_sentence": "',
    word, ' core", "academic_keywords": ["', word, '", "zeta"], "synonyms_and_extensions": ["syn ', word, '"]}}')
  when 1 then concat('{"filter_conditions": {"publish_year": "year 2011", "author": "Author7", "year_from": 1999}, "search_payload": {"academic_keywords": "',
    word, '", "synonyms_and_extensions": 7}}')
  when 2 then '{"broken": '
  when 3 then '{"search_payload": {"core_semantic_sentence": "qqqq", "academic_keywords": ["wwww"]}, "filter_conditions": {"publish_year": 2005}}'
  when 4 then concat('```json', chr(10), 'Result: {"search_payload": {"academic_keywords": ["', word, '"]}}', chr(10), '```')
  else null end"""

REWRITTEN = (
    *ASKED,
    "payloads as materialized (select query_id, q, q_vec, words, y, " + _PAYLOAD.replace("{S}", "varchar")
    .replace("word,", "words[4],") + " payload from analysed)",
    r"""bare as (select *, case when payload is null then null when starts_with(payload, '```') then
      trim(regexp_replace(regexp_replace(payload, '^```[a-zA-Z]*\s*', ''), '\s*```\s*$', ''))
      else payload end t from payloads)""",
    """docs as materialized (select *, case when json_valid(t) then (case when json_type(t::json) = 'OBJECT' then t::json end)
      when json_valid(regexp_extract(t, '(?s)\\{.*\\}')) then regexp_extract(t, '(?s)\\{.*\\}')::json end doc from bare)""".replace("\\\\", "\\"),
    """parts as materialized (select query_id, q, q_vec, words, doc is not null given, y,
      coalesce(nullif(doc->>'$.search_payload.core_semantic_sentence', ''), q) core,
      case json_type(doc, '$.search_payload.academic_keywords') when 'ARRAY' then
        from_json(doc->'$.search_payload.academic_keywords', '["varchar"]')
        when 'VARCHAR' then [doc->>'$.search_payload.academic_keywords'] else []::varchar[] end academic,
      case json_type(doc, '$.search_payload.synonyms_and_extensions') when 'ARRAY' then
        from_json(doc->'$.search_payload.synonyms_and_extensions', '["varchar"]') else []::varchar[] end syn,
      case json_type(doc, '$.filter_conditions.publish_year') when 'VARCHAR' then
        nullif(regexp_extract(doc->>'$.filter_conditions.publish_year', '(?:19|20)[0-9]{2}'), '')::int
        else (doc->>'$.filter_conditions.publish_year')::int end doc_year,
      coalesce((doc->>'$.filter_conditions.year_from')::int, 0) doc_from,
      case when json_type(doc, '$.filter_conditions.authors') = 'ARRAY' then 'author1'
        when json_type(doc, '$.filter_conditions.author') = 'VARCHAR' then doc->>'$.filter_conditions.author'
        else '' end authors,
      coalesce((doc->>'$.filter_conditions.is_core')::boolean, false) core_only,
      trim(coalesce(doc->>'$.boolean_query', '')) bool_text from docs)""",
    """merged as (select *, case when given and len(academic) > 0 then academic else words end kw,
      case when given then core else q end core2 from parts)""",
    f"""judged as materialized (select *, len(list_intersect(list_filter({d_tok('q')}, lambda t: length(t) >= 2),
      list_filter({d_tok("concat(core2, ' ', array_to_string(kw, ' '))")}, lambda t: length(t) >= 2))) > 0 ok
      from merged)""",
    """rewritten as materialized (select query_id, q, q_vec, ok accepted,
      case when ok then concat(array_to_string(kw, ' '), ' ', array_to_string(case when given then syn else [] end, ' '), ' ', q)
        else q end bm25_text,
      case when ok then core2 else q end vector_text, case when ok and given then bool_text else '' end boolean_query,
      case when not ok then null when given then case when doc_year > 0 then doc_year end else y end "year",
      case when ok and given then doc_from else 0 end year_from,
      case when ok and given then authors else '' end authors,
      ok and given and core_only is_core from judged)""",
)


def rewrites(d):
    base = expand_query(asked(d)).select("query_id", F.get("keywords", F.lit(3)).alias("word"))
    return base.select("query_id", F.expr(_PAYLOAD.replace("{S}", "string")).alias("payload"))


@check("apply_rewrites", "select query_id, accepted, bm25_text, vector_text, boolean_query, \"year\", year_from, "
                         "authors, is_core from rewritten", ("queries",), REWRITTEN)
def _(d):
    out = apply_rewrites(asked(d), rewrites(d))
    f = F.col("analysis_filter")
    return out.select(
        "query_id", "accepted", "bm25_text", "vector_text", "boolean_query",
        F.get(f["years"], F.lit(0)).alias("year"), f["year_from"].alias("year_from"),
        F.array_join(f["authors"], "|").alias("authors"), F.coalesce(f["is_core"], F.lit(False)).alias("is_core"))


# --- whole searches ---------------------------------------------------------

PAGE_FILTER = SearchFilters(year_from=2004, affiliations=["univ1"])
PAGED = (
    *index_ctes(), *bm25_ctes("w", "queries", mask="field in ('title', 'keywords')"),
    "w_allowed as (select w.* from w_scores w join papers p using (paper_id) where publish_year >= 2004 and "
    "contains(lower(affiliation), 'univ1'))", ranked_cte("found", "w_allowed", 500),
    "w_hits as materialized (select query_id, paper_id, score, matched, row_number() over (partition by query_id "
    "order by coalesce(publish_year, 0) desc, rank) rank from found join papers using (paper_id))",
)


def _page_search(d):
    return search.traditional_search(
        build_index(d.papers), d.papers, d.queries.select("query_id", "q"), field="title_or_keywords",
        filters=PAGE_FILTER, sort="year", page=2, page_size=10)


@check("traditional_search",
       "select query_id, paper_id, round(score, 6) score, rank::int rank, total, title, \"year\" from (select *, "
       "coalesce(publish_year, 0) \"year\", count(*) over (partition by query_id) total from w_hits join papers "
       "using (paper_id)) where rank > 10 and rank <= 20", ("papers", "queries"), PAGED)
def _(d):
    return _page_search(d).page.select("query_id", "paper_id", r6("score", "score"), F.col("rank").cast("int").alias("rank"), "total", "title", "year")


@check("traditional_search_facets", facet_sql("w_hits"), ("papers", "queries"), (*PAGED, FACET_ROWS))
def _(d):
    return _page_search(d).facets


@check("traditional_search_author",
       "select query_id, paper_id, rank::int rank, total from (select q.query_id, p.paper_id, row_number() over "
       "(partition by q.query_id order by p.paper_id) rank, count(*) over (partition by q.query_id) total from (select "
       "query_id, concat('author', (query_id % 40)::varchar, ';') a from queries) q join papers p on "
       "contains(lower(author), a)) where rank <= 20", ("papers", "queries"))
def _(d):
    names = d.queries.select("query_id", F.concat(
        F.lit(" Author"), (F.col("query_id") % 40).cast("string"), F.lit(";")).alias("q"))
    result = search.traditional_search(build_index(d.papers), d.papers, names, field="author")
    return result.page.select("query_id", "paper_id", F.col("rank").cast("int").alias("rank"), "total")


def _smart_ctes(floor):
    year = ("(r.\"year\" is null or r.\"year\" not in (select publish_year from papers where publish_year is not null) "
            "or p.publish_year = r.\"year\")")
    return (
        *ASKED,
        "rewritten as materialized (select query_id, q_vec, case when len(words) > 0 then concat(array_to_string("
        "words, ' '), ' ', q) else q end bm25_text, y \"year\" from analysed)",
        *index_ctes(), *bm25_ctes("w", "rewritten", "bm25_text"),
        f"allowed as materialized (select r.query_id, p.paper_id from rewritten r join papers p on {year})",
        "w_allowed as (select w.* from w_scores w semi join allowed a on a.query_id = w.query_id and "
        "a.paper_id = w.paper_id)",
        ranked_cte("w_hits", "w_allowed", 200),
        *vector_ctes("v", "rewritten", floor, where="exists (select 1 from allowed a where a.query_id = s.query_id "
                                                    "and a.paper_id = c.paper_id)"),
        rrf_cte("fused", "w_hits", "v_hits", 400), *precision_ctes("golden", "fused"),
    )


def smart(d, floor):
    return search.smart_search(build_index(d.papers), d.papers, d.chunks, asked(d), floor=floor)


@check("smart_search", HITS_SQL.format("golden"), ("papers", "chunks", "queries"), _smart_ctes(0.6))
def _(d):
    return hits_out(smart(d, 0.60).golden)


@check("smart_search_low_floor", HITS_SQL.format("golden"), ("papers", "chunks", "queries"), _smart_ctes(0.2))
def _(d):
    return hits_out(smart(d, 0.20).golden)


@check("smart_search_stored", HITS_SQL.format("golden"), ("papers", "chunks", "queries"), _smart_ctes(0.2))
def _(d):
    return hits_out(search.smart_search(stored_index(d), d.papers, d.chunks, asked(d), floor=0.20).golden)


@check("smart_search_facets", facet_sql("golden"), ("papers", "chunks", "queries"), (*_smart_ctes(0.2), FACET_ROWS))
def _(d):
    return smart(d, 0.20).facets


@check("smart_search_rewritten", HITS_SQL.format("golden"), ("papers", "chunks", "queries"), (
    *REWRITTEN, *index_ctes(), *bm25_ctes("w", "rewritten", "bm25_text"),
    "tested as materialized (select query_id, \"year\", year_from, lower(authors) a, is_core, exists (select 1 from "
    "papers p where (r.\"year\" is null or p.publish_year = r.\"year\") and (year_from = 0 or p.publish_year >= "
    "year_from) and contains(lower(p.author), lower(authors)) and (not r.is_core or p.is_core = 1)) alive "
    "from rewritten r)",
    "allowed as materialized (select t.query_id, p.paper_id from tested t join papers p on not alive or "
    "((t.\"year\" is null or p.publish_year = t.\"year\") and (year_from = 0 or p.publish_year >= year_from) and "
    "contains(lower(p.author), a) and (not t.is_core or p.is_core = 1)))",
    "w_allowed as (select w.* from w_scores w semi join allowed a on a.query_id = w.query_id and "
    "a.paper_id = w.paper_id)",
    ranked_cte("w_hits", "w_allowed", 200),
    *vector_ctes("v", "rewritten", 0.2, where="exists (select 1 from allowed a where a.query_id = s.query_id "
                                              "and a.paper_id = c.paper_id)"),
    rrf_cte("fused", "w_hits", "v_hits", 400), *precision_ctes("golden", "fused")))
def _(d):
    result = search.smart_search(build_index(d.papers), d.papers, d.chunks, asked(d), rewrites(d), floor=0.20)
    return hits_out(result.golden)


@check("related_papers",
       "select seed_id, paper_id, round(score, 6) score, rank::int rank, matched_by from (select f.query_id seed_id, "
       "f.paper_id, f.score, row_number() over (partition by f.query_id order by f.rank) rank, case when w.paper_id is "
       "not null and v.paper_id is not null then '关键词+语义' when v.paper_id is not null then '语义' else '关键词' end "
       "matched_by from fused f left join w_hits w on w.query_id = f.query_id and w.paper_id = f.paper_id left join "
       "v_hits v on v.query_id = f.query_id and v.paper_id = f.paper_id where f.paper_id <> f.query_id) "
       "where rank <= 20", ("papers", "chunks"), (
           *index_ctes(),
           "seeds as (select paper_id query_id, keywords q from papers)", *bm25_ctes("w", "seeds"),
           ranked_cte("w_hits", "w_scores", 50),
           "longest as materialized (select paper_id query_id, embedding q_vec from (select *, row_number() over "
           "(partition by paper_id order by strlen(coalesce(chunk_text, '')) desc, chunk_index) n from chunks) "
           "where n = 1)",
           *vector_ctes("v", "longest", 0.0, 200, 50), rrf_cte("fused", "w_hits", "v_hits", 100)))
def _(d):
    related = search.related_papers(build_index(d.papers), d.papers, d.chunks, d.papers.select("paper_id"))
    return related.select("seed_id", "paper_id", r6("score", "score"), "rank", "matched_by")


__all__ = ["asked", "smart"]
