"""Checks of filters, statistics, facets and ranking helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.text import tokenize
from scriptorium.functions.vectors import cosine
from scriptorium.operators import filters as fl
from scriptorium.operators import ranking as rk
from scriptorium.operators import statistics as st
from scriptorium.operators.bm25 import Matches, bm25_search
from scriptorium.operators.facets import facets
from scriptorium.operators.fusion import rrf_fuse
from scriptorium.operators.vector import chunks_to_papers, vector_search
from scriptorium.scale import cut_lineage, in_batches, rank_batches
from scriptorium.sources.index import build_index, build_term_stats

from .registry import (
    HITS_SQL, bm25_ctes, check, d_strip, d_tok, hits_out, index_ctes, precision_ctes, r6, ranked_cte, rrf_cte,
    vector_ctes,
)

WORDS = (*index_ctes(), *bm25_ctes("w", "queries"))
WORD_HITS = (*WORDS, ranked_cte("w_hits", "w_scores", 500))


def word_hits(d, k=500):
    return bm25_search(build_index(d.papers), d.queries.select("query_id", "q"), k=k)


@check("tokenize", f"select term, count(*) n from (select unnest({d_tok('text')}) term from documents) group by term")
def _(d):
    return d.documents.select(F.explode(tokenize("text")).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"))


@check("cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) "
                 "cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(d):
    e = d.embeddings
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", r6(cosine("embedding", "other"), "cosine"))


@check("build_index",
       "select field, term, df, 0.0::double avgdl from dfs union all "
       "select field, '' term, n df, round(avgdl, 6) from fstats", ("papers",), index_ctes())
def _(d):
    index = build_index(d.papers)
    terms = build_term_stats(index.postings).select("field", "term", "df", F.lit(0.0).alias("avgdl"))
    fields = index.field_stats.select("field", F.lit("").alias("term"), F.col("n_docs").alias("df"),
                                      r6("avgdl", "avgdl"))
    return terms.unionByName(fields)


FILTER = fl.SearchFilters(authors=["author1", " Author22"], affiliations=["Univ1"], clcs=["EN(x)", "FR", "（d"],
                          year_from=2003, year_to=2021, is_core=True)


@check("hard_filter",
       "select paper_id, publish_year, author from papers where (lower(author) like '%author1%' or "
       "lower(author) like '%author22%') and lower(affiliation) like '%univ1%' and (lower(clc_number) like '%en%' or "
       "lower(clc_number) like '%fr%' or lower(clc_number) like '%（d%') and publish_year between 2003 and 2021 "
       "and is_core = 1", ("papers",))
def _(d):
    return fl.hard_filter(d.papers, FILTER).select("paper_id", "publish_year", "author")


@check("field_lookup",
       "select paper_id, 0.0::double score, row_number() over (order by paper_id)::int rank from papers "
       f"where lower({d_strip('author')}) like 'author1%' and coalesce(is_core, 0) = 0", ("papers",))
def _(d):
    found = fl.field_lookup(d.papers, "first_author", " Author1", filters=fl.SearchFilters(is_core=False))
    return found.withColumn("rank", F.col("rank").cast("int"))


def filter_queries(d):
    """One analysis filter (a year, some without papers) and one user filter per benchmark query."""
    empty = F.array().cast("array<string>")
    base = d.queries.select("query_id")
    year = (F.lit(1995) + F.col("query_id") % 45).cast("int")
    author = F.concat(F.lit("author"), (F.col("query_id") % 37).cast("string"), F.lit(";"))
    none = F.array().cast("array<int>")

    def spec(authors, years):
        return F.struct(
            authors.alias("authors"), empty.alias("affiliations"), empty.alias("journals"), empty.alias("clcs"),
            years.alias("years"), F.lit(0).alias("year_from"), F.lit(0).alias("year_to"),
            F.lit(None).cast("boolean").alias("is_core"))

    user = F.when(F.col("query_id") % 3 < 2, spec(F.array(author), none))
    return base.withColumns({"analysis_filter": spec(empty, F.array(year)), "user_filter": user})


FILTER_QUERIES = (
    "fq as (select query_id, (1995 + query_id % 45)::int y, case when query_id % 3 < 2 then "
    "concat('author', (query_id % 37)::varchar, ';') end a from queries)",
    "alive as (select distinct y from fq where y in (select publish_year from papers))",
)
ALLOWED = ("(fq.y not in (select y from alive) or p.publish_year = fq.y) and "
           "(fq.a is null or lower(p.author) like concat('%', fq.a, '%'))")


@check("allowed_merge",
       f"select fq.query_id, p.paper_id from fq join papers p on {ALLOWED} "
       "where fq.a is not null or fq.y in (select y from alive)", ("papers", "queries"), FILTER_QUERIES)
def _(d):
    return fl.allowed_papers(fl.allowed_merge(d.papers, filter_queries(d)))


@check("locate_exact",
       "select r.query_id, min(p.paper_id) paper_id from (select doc_id query_id, case when doc_id % 3 = 0 then '' "
       f"else concat(' 10.1000/', (doc_id * 2)::varchar) end doi, {d_strip('split_part(text, chr(10), 1)')} title "
       f"from documents) r join papers p on ({d_strip('r.doi')} <> '' and p.doi = {d_strip('r.doi')}) or "
       "(r.title <> '' and p.title = r.title) group by r.query_id", ("papers",))
def _(d):
    doi = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit(" 10.1000/"), (F.col("doc_id") * 2).cast("string")))
    requests = d.documents.select(F.col("doc_id").alias("query_id"), doi.alias("doi"),
                                  F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return fl.locate_exact(d.papers, requests)


# --- statistics -------------------------------------------------------------

@check("corpus_counts", "select (select count(*) from papers) papers, (select count(*) from chunks) chunks",
       ("papers", "chunks"))
def _(d):
    return st.corpus_counts(d.papers, d.chunks)


@check("corpus_stats",
       "select 'size' stat, 'papers' \"value\", (select count(*) from papers) \"count\" union all "
       "select 'size', 'chunks', (select count(*) from chunks) union all "
       "select 'year', coalesce(publish_year, 0)::varchar, count(*) from papers group by 2 union all "
       "select * from (select 'journal', source_journal, count(*) n from papers where "
       f"{d_strip('source_journal')} <> '' group by 2 order by n desc, 2 limit 10)", ("papers", "chunks"))
def _(d):
    return st.corpus_stats(d.papers, d.chunks)


@check("year_distribution", "select publish_year, count(*) \"count\" from papers where publish_year is not null "
                            "group by 1", ("papers",))
def _(d):
    return st.year_distribution(d.papers)


def _split(column):
    return f"list_filter(list_transform(regexp_split_to_array({column}, '[，,；;、/|]'), lambda x: " \
           f"{d_strip('x')}), lambda x: x <> '')"


def _top(column, n):
    return (f"select value, count(*) \"count\" from (select unnest({_split(column)}) \"value\" from papers) "
            f"group by 1 order by 2 desc, 1 limit {n}")


@check("top_authors", _top("author", 20), ("papers",))
def _(d):
    return st.top_authors(d.papers)


@check("top_keywords", _top("keywords", 30), ("papers",))
def _(d):
    return st.top_keywords(d.papers)


@check("journal_distribution", f"select {d_strip('source_journal')} \"value\", count(*) \"count\" from papers "
                               "where \"value\" <> '' group by 1 order by 2 desc, 1 limit 20", ("papers",))
def _(d):
    return st.journal_distribution(d.papers)


@check("keyword_cooccurrence",
       "select x.w a, y.w b, count(*) \"count\" from k x join k y on x.paper_id = y.paper_id and x.w < y.w "
       "group by 1, 2 order by 3 desc, 1, 2 limit 30", ("papers",),
       (f"k as materialized (select distinct paper_id, unnest({_split('keywords')}) w from papers)",))
def _(d):
    return st.keyword_cooccurrence(d.papers)


@check("tfidf_keywords",
       "select paper_id, term, round(weight, 6) weight, rank::int rank from (select paper_id, term, weight, "
       "row_number() over (partition by paper_id order by round(weight, 6) desc, term) rank from (select t.paper_id, "
       "t.term, tf * (ln((1.0 + n) / (1 + df)) + 1) weight from tf t join df using (term), n where df <= 0.95 * n)) "
       "where rank <= 20", ("papers",), (
           f"docs as materialized (select paper_id, case when len({d_tok('abstract')}) > 0 then {d_tok('abstract')} "
           f"else list_filter(string_split({d_strip('abstract')}, ''), lambda x: {d_strip('x')} <> '') end terms "
           f"from papers where {d_strip('abstract')} <> '')",
           "n as (select count(*) n from docs)",
           "tf as materialized (select paper_id, term, count(*) tf from (select paper_id, unnest(terms) term from docs)"
           " group by all)",
           "df as (select term, count(*) df from tf group by 1)"))
def _(d):
    return st.tfidf_keywords(d.papers).select("paper_id", "term", r6("weight", "weight"), "rank")


FACET_ROWS = f"""
facet_values as (
  select paper_id, 'authors' facet, unnest(list_filter(regexp_split_to_array(author, '[；;，,、\\s\\p{{Z}}]+'),
    lambda x: length(x) >= 2)) "value" from papers
  union all select paper_id, 'journals', {d_strip('source_journal')} from papers
    where {d_strip('source_journal')} <> ''
  union all select paper_id, 'years', publish_year::varchar from papers where publish_year > 0
  union all select paper_id, 'core', case when is_core = 1 then '核心期刊' else '非核心' end from papers
  union all select * from (select paper_id, 'clc', {d_strip("unnest(regexp_split_to_array(clc_number, '[;；]'))")} v
    from papers) where v <> ''
  union all select * from (select paper_id, 'affiliations',
    {d_strip(f"list_filter(regexp_split_to_array({d_strip('affiliation')}, '[;；,，]'), lambda x: x <> '')[1]")} v
    from papers) where v <> ''
)"""


def facet_sql(hits):
    return (
        "select query_id, facet, \"value\", n \"count\", rank::int rank from (select *, row_number() over (partition "
        "by query_id, facet order by n desc, \"value\") rank from (select query_id, facet, \"value\", count(*) n from "
        f"{hits} join facet_values using (paper_id) group by all)) where rank <= case facet when 'years' then 20 "
        "when 'core' then 2 else 15 end")


@check("facets", facet_sql("w_hits"), ("papers", "queries"), (*WORD_HITS, FACET_ROWS))
def _(d):
    return facets(word_hits(d), d.papers)


# --- ranked lists -----------------------------------------------------------

@check("rank_topk", "select query_id, paper_id, rank::int rank from (select *, row_number() over (partition by "
                    "query_id order by round(score, 6) desc, paper_id) rank from w_scores)",
       ("papers", "queries"), WORDS)
def _(d):
    """k = 0: every match is ranked, no list is gathered in one task."""
    return word_hits(d, k=0).select("query_id", "paper_id", F.col("rank").cast("int").alias("rank"))


@check("paginate", "select query_id, paper_id, rank::int rank, total from w_hits join (select query_id, count(*) "
                   "total from w_hits group by 1) using (query_id) where rank > 20 and rank <= 40",
       ("papers", "queries"), WORD_HITS)
def _(d):
    return rk.paginate(word_hits(d), 2, 500).select("query_id", "paper_id", "rank", "total")


@check("sort_by_year",
       "select query_id, paper_id, round(score, 6) score, row_number() over (partition by query_id order by "
       "coalesce(publish_year, 0) desc, rank)::int rank from w_hits join papers using (paper_id)",
       ("papers", "queries"), WORD_HITS)
def _(d):
    return rk.sort_by_year(word_hits(d), d.papers, 500).select("query_id", "paper_id", r6("score", "score"), "rank")


# whole lists: several hundred papers a query
ALL_HITS = (*WORDS, ranked_cte("w_hits", "w_scores", 1_000_000_000))


@check("sort_by_year_all",
       "select query_id, paper_id, round(score, 6) score, row_number() over (partition by query_id order by "
       "coalesce(publish_year, 0) desc, rank)::int rank from w_hits join papers using (paper_id)",
       ("papers", "queries"), ALL_HITS)
def _(d):
    return rk.sort_by_year(Matches(build_index(d.papers), d.queries.select("query_id", "q")), d.papers).select(
        "query_id", "paper_id", r6("score", "score"), F.col("rank").cast("int").alias("rank"))


@check("rrf_fuse_long", HITS_SQL.format("fused"), ("papers", "queries"), (
    *ALL_HITS, "p_hits as (select query_id, paper_id, score, matched, row_number() over (partition by query_id order by "
    "paper_id) rank from w_scores)", rrf_cte("fused", "w_hits", "p_hits", 1_000_000_000)))
def _(d):
    """Lists without a limit: by score, and by paper."""
    words = word_hits(d, 0)
    found = in_batches(words.select("query_id", "paper_id", "matched_fields"), ["query_id"])
    by_paper = rank_batches(found, ["query_id"], [F.col("paper_id").asc()])
    return hits_out(rrf_fuse(words, by_paper))


@check("hydrate_hits",
       "select query_id, paper_id, rank::int rank, title, author, coalesce(publish_year, 0) \"year\", source_journal "
       "journal, affiliation, keywords, case when length(abstract) > 200 then concat(substr(abstract, 1, 200), '...') "
       "else abstract end abstract_preview from w_hits join papers using (paper_id)", ("papers", "queries"), WORD_HITS)
def _(d):
    return rk.hydrate_hits(word_hits(d).select("query_id", "paper_id", "rank"), d.papers)


ARMS = (*WORDS, ranked_cte("w_hits", "w_scores", 200), *vector_ctes("v", "queries", 0.2))


def arms(d, k=200):
    """Both ranked lists, stored once because most checks read them several times."""
    near = chunks_to_papers(vector_search(d.chunks, d.queries, None, 0.2, 200), 200)
    return cut_lineage(word_hits(d, k)), cut_lineage(near)


@check("chunks_to_papers", HITS_SQL.format("v_hits"), ("chunks", "queries"), vector_ctes("v", "queries", 0.2))
def _(d):
    return hits_out(chunks_to_papers(vector_search(d.chunks, d.queries, None, 0.2, 200), 200))


@check("rrf_fuse", HITS_SQL.format("fused"), ("papers", "chunks", "queries"),
       (*ARMS, rrf_cte("fused", "w_hits", "v_hits", 400)))
def _(d):
    return hits_out(rrf_fuse(*arms(d)))


@check("precision_filter", HITS_SQL.format("golden"), ("papers", "chunks", "queries"),
       (*ARMS, rrf_cte("fused", "w_hits", "v_hits", 400), *precision_ctes("golden", "fused")))
def _(d):
    return hits_out(rk.precision_filter(rrf_fuse(*arms(d))))


@check("matched_by",
       "select f.query_id, f.paper_id, case when w.paper_id is not null and v.paper_id is not null then '关键词+语义' "
       "when v.paper_id is not null then '语义' else '关键词' end matched_by from fused f left join w_hits w on "
       "w.query_id = f.query_id and w.paper_id = f.paper_id left join v_hits v on v.query_id = f.query_id and "
       "v.paper_id = f.paper_id", ("papers", "chunks", "queries"),
       (*ARMS, rrf_cte("fused", "w_hits", "v_hits", 400)))
def _(d):
    words, vectors = arms(d)
    return rk.matched_by(rrf_fuse(words, vectors), words, vectors).select("query_id", "paper_id", "matched_by")
