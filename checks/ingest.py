"""Checks of sources, linkage, table maintenance and streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators.linkage import backfill_column, match_metadata
from scriptorium.operators.packing import sliding_chunks
from scriptorium.plans.ingest import build_papers
from scriptorium.scale import scratch_path
from scriptorium.sources import metadata as md
from scriptorium.sources import paragraphs as pg
from scriptorium.sources import tables as tb
from scriptorium.sources.index import TOKEN_COLUMNS
from scriptorium.streaming import ingest as si
from scriptorium.streaming.statistics import StreamedStatistics

from .registry import check, d_strip, d_tok, index_ctes, r6

HEADERS = {
    "No": "paper_id", "题名": "title", "作者": "author", "关键词": "keywords", "摘要": "research_design_text",
    "DOI": "doi", "刊名": "source", "作者单位": "affiliation", "核心类型": "core_type", "分类号": "clc_number",
}
SOURCE = ("concat('  ', source_journal, case when paper_id like '%1' then '，' else ',' end, "
          "coalesce(publish_year::{S}, ''), ',46(8):12-20')")


def export(d):
    """Papers as a metadata export: padded values, journal, year and pages in one column."""
    papers = d.papers.withColumn("source", F.expr(SOURCE.replace("publish_year::{S}", "cast(publish_year as string)")))
    return papers.withColumn("title", F.concat(F.lit("　 "), "title", F.lit(" "))).select(
        *[F.col(c).alias(h) for h, c in HEADERS.items()])


JOURNAL = "regexp_extract({}, '^([^,;，；\\s\\p{{Z}}]*)', 1)"


@check("read_metadata",
       f"select paper_id serial, {d_strip('title')} title, {d_strip('author')} author, {d_strip('keywords')} keywords, "
       f"{d_strip('research_design_text')} abstract, doi, source, affiliation, core_type db_class, clc_number "
       f"subject_code, '' issn, {JOURNAL.format(d_strip('source'))} source_journal, "
       "nullif(regexp_extract(source, '(?:19|20)[0-9]{2}'), '')::int publish_year from (select *, "
       + SOURCE.replace("{S}", "varchar") + " source from papers)", ("papers",))
def _(d):
    d.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = scratch_path(d.spark, "export")
    (export(d).write.option("header", True).option("encoding", "gb18030").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return md.read_metadata(d.spark, path, encoding="gb18030").drop("cn", "pages")


THESES = """select paper_id no, case when paper_id like '%7' then '  ' else title end title, author, keywords,
  research_design_text abstract, doi, case when paper_id like '%3' then '' else affiliation end unit,
  coalesce(publish_year::{S}, '') y, clc_number clc from papers"""


@check("thesis_to_journal_schema",
       f"select no \"序号\", {d_strip('title')} \"题名\", author \"作者\", {d_strip('keywords')} \"关键词\", "
       f"{d_strip('abstract')} \"摘要\", doi \"DOI\", '' \"CN\", unit \"作者单位\", case when unit <> '' then "
       "concat(unit, '（学位论文）,', y) when y <> '' then concat('学位论文,', y) else '' end \"刊名\", '' \"ISSN\", "
       f"'' \"页码\", '学位论文' \"核心类型\", clc \"中图分类号\" from ({THESES.replace('{S}', 'varchar')}) "
       f"where {d_strip('title')} <> ''", ("papers",))
def _(d):
    p = d.papers
    rows = p.select(
        F.col("paper_id").alias("序号"),
        F.when(F.col("paper_id").endswith("7"), F.lit("  ")).otherwise(F.col("title")).alias("题名"),
        F.col("author").alias("作者"), F.col("keywords").alias("关键词"),
        F.col("research_design_text").alias("摘要"), F.col("doi").alias("DOI"),
        F.when(F.col("paper_id").endswith("3"), F.lit("")).otherwise(F.col("affiliation")).alias("学位授予单位"),
        F.coalesce(F.col("publish_year").cast("string"), F.lit("")).alias("学位年度"),
        F.col("clc_number").alias("中图分类号"))
    return md.thesis_to_journal_schema(rows)


# every paragraph of every document, with page numbers and footnotes put in
NOISY_SPARK = """select doc_id, array_join(transform(split(text, '\\\\n'), (p, i) -> case
  when i % 5 = 1 then concat(p, '\\n - ', cast(i as string), ' - \\n收稿日期：2024-01-01\\n')
  when i % 5 = 3 then concat('\\u3000', p, '\\n万方数据') else p end), '\\n') text from {documents}"""
NOISY_DUCK = """noisy as materialized (select doc_id, array_to_string(list_transform(range(len(l)), lambda i: case
  when i % 5 = 1 then concat(l[i + 1], chr(10), ' - ', i::varchar, ' - ', chr(10), '收稿日期：2024-01-01', chr(10))
  when i % 5 = 3 then concat(chr(12288), l[i + 1], chr(10), '万方数据') else l[i + 1] end), chr(10)) text
  from (select doc_id, string_split(text, chr(10)) l from documents))"""
LINES_DUCK = f"""lines as materialized (select doc_id, n, {d_strip('l[n + 1]')} para from (select doc_id, l,
  unnest(range(len(l))) n from (select doc_id, string_split(text, chr(10)) l from noisy)))"""
NOT_NOISE = ("para <> '万方数据' and not regexp_matches(para, '^[\\s\\-—–·.]*[0-9]{1,4}[\\s\\-—–·.]*$') and not "
             "regexp_matches(para, '^(收稿日期|修回日期|基金项目|作者简介|通信作者|通讯作者|第一作者|文章编号|文献标识码|"
             "中图分类号|DOI[:：]|doi[:：])')")


def noisy(d):
    return d.spark.sql(NOISY_SPARK, documents=d.documents)


@check("read_paragraphs", "select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int pos, para "
                          f"from lines where para <> '' and {NOT_NOISE}", (), (NOISY_DUCK, LINES_DUCK))
def _(d):
    return pg.read_paragraphs(noisy(d))


@check("noise_filter", f"select doc_id, n pos, para from lines where para <> '' and {NOT_NOISE}", (),
       (NOISY_DUCK, LINES_DUCK))
def _(d):
    from scriptorium.functions.text import strip

    lines = noisy(d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "para"))
    kept = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), strip("para").alias("para"))
    return pg.noise_filter(kept.filter(F.col("para") != ""))


@check("upsert_papers",
       "select paper_id, title, publish_year from papers where paper_id not in (select paper_id from u) union all "
       "select paper_id, title, publish_year from u", ("papers",), (
           "u as materialized (select (doc_id * 2)::varchar paper_id, concat('second ', doc_id::varchar) title, "
           "2030 publish_year from documents)",))
def _(d):
    new_id = (F.col("doc_id") * 2).cast("string").alias("paper_id")
    both = F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.lit("second ").alias("w")),
                             F.struct(F.lit(1).alias("seq"), F.lit("first ").alias("w"))))
    rows = d.documents.select(new_id, "doc_id", both.alias("v"))
    updates = rows.select("paper_id", F.concat("v.w", F.col("doc_id").cast("string")).alias("title"),
                          F.lit(2030).alias("publish_year"), F.col("v.seq").alias("seq"))
    return tb.upsert_papers(d.papers.select("paper_id", "title", "publish_year"), updates, "seq")


@check("replace_chunks",
       "select chunk_id, paper_id, chunk_index, length(chunk_text) n from chunks where paper_id not in (select paper_id "
       "from u) union all select chunk_id, paper_id, chunk_index, n from u", ("chunks",), (
           "u as materialized (select concat((paper_id::bigint * 2)::varchar, '::', chunk_index::varchar) chunk_id, "
           "(paper_id::bigint * 2)::varchar paper_id, chunk_index, length(chunk_text) n from chunks "
           "where chunk_index < 3)",))
def _(d):
    base = d.chunks.select("chunk_id", "paper_id", "chunk_index", F.length("chunk_text").alias("n"))
    other = (F.col("paper_id").cast("long") * 2).cast("string")
    updates = base.filter(F.col("chunk_index") < 3).select(
        F.concat_ws("::", other, F.col("chunk_index").cast("string")).alias("chunk_id"), other.alias("paper_id"),
        "chunk_index", "n")
    return tb.replace_chunks(base, updates)


@check("append_history", "select id, mode, query, filters, epoch_us(created_at) created_us from history",
       ("history",))
def _(d):
    """The events table as a stream, appended to a history table and read back."""
    schema = d.events.schema
    stream = (d.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d.sf_dir)
              .select(F.col("event_id").alias("id"), F.col("event_type").alias("mode"),
                      F.col("user_id").cast("string").alias("query"), F.col("props").alias("filters"),
                      F.col("ts").alias("created_at")))
    path = scratch_path(d.spark, "history")
    si.stream_history(stream, path, scratch_path(d.spark, "history-state")).awaitTermination()
    return d.spark.read.parquet(path).select(
        "id", "mode", "query", "filters", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


@check("recent_history", "select id, mode, query, filters from history order by id desc limit 150", ("history",))
def _(d):
    return tb.recent_history(d.history, 150).select("id", "mode", "query", "filters")


@check("paper_detail",
       "select p.paper_id, title, doi, author, keywords, abstract, source_journal, affiliation, core_type, clc_number, "
       "research_design_text, raw_body, coalesce(publish_year, 0) publish_year, is_core, c.chunk_list from papers p "
       "left join (select paper_id, string_agg(concat(chunk_id, '=', section_role, '=', chunk_text), '|' order by "
       "chunk_index) chunk_list from chunks group by 1) c on c.paper_id = p.paper_id", ("papers", "chunks"))
def _(d):
    detail = tb.paper_detail(d.papers, d.chunks, d.papers.select("paper_id"))
    listed = F.transform("chunks", lambda c: F.concat(
        c.chunk_id, F.lit("="), c.section_role, F.lit("="), c.chunk_text))
    return detail.withColumn("chunk_list", F.array_join(listed, "|")).drop("chunks")


# --- linkage ----------------------------------------------------------------

# ids: exact title, title without its first characters, longer than the title, unknown, other case and punctuation
FILES = """select doc_id, case doc_id % 5 when 0 then t when 1 then substr(t, 8) when 2 then concat(t, ' extra words')
  when 3 then concat('unknown ', cast(doc_id as {S})) else concat('《', replace(replace(t, ' ', '_'), 'a', 'A'), '》') end paper_id
  from (select doc_id, split_part(text, chr(10), 1) t from {documents})"""
CLEAN = r"""lower(regexp_replace({}, '[\s\p{{Z}}_\-—·•．.,，。:：;；!！?？“”"''‘’()（）\[\]【】《》<>/\\|]+', '', 'g'))"""

MATCHED = (
    "files as materialized (select distinct paper_id from (" + FILES.replace("{S}", "varchar").replace(
        "{documents}", "documents") + "))",
    f"ids as materialized (select paper_id, {CLEAN.format('paper_id')} k from files)",
    f"titles as materialized (select {CLEAN.format('title')} k, min(paper_id::bigint) first_row, "
    "max(paper_id::bigint) last_row from papers where k <> '' group by 1)",
    "matched as materialized (select i.paper_id, i.k, t.first_row hint, case when t.k is null and i.k <> '' then "
    "(select min(first_row) from titles x where contains(x.k, i.k) or contains(i.k, x.k)) end loose "
    "from ids i left join titles t on t.k = i.k)",
)


def files(d):
    return d.spark.sql(FILES.replace("{S}", "string"), documents=d.documents).select("paper_id").distinct()


def meta_rows(d):
    return d.papers.withColumn("row_no", F.col("paper_id").cast("long"))


@check("match_metadata",
       "select paper_id, coalesce(hint, loose) row_no, case when hint is not null then 1 when loose is not null then 3 "
       "end stage from matched", ("papers",), MATCHED)
def _(d):
    docs = files(d).withColumn("title_hint", F.col("paper_id"))
    return match_metadata(docs, meta_rows(d))


@check("match_metadata_by_id",
       "select i.paper_id, coalesce(t.last_row, (select min(first_row) from titles x where i.k <> '' and (contains(x.k, "
       "i.k) or contains(i.k, x.k)))) row_no from ids i left join titles t on t.k = i.k", ("papers",), MATCHED)
def _(d):
    docs = files(d).withColumn("title_hint", F.lit(""))
    return match_metadata(docs, meta_rows(d)).select("paper_id", "row_no")


@check("backfill_column",
       "select paper_id, affiliation from filled union all select k, v::varchar from (select count(*) total, "
       "count(row_no) matched, count(*) filter (where fresh <> '') filled, count(*) filter (where affiliation <> '') "
       "have from filled) unpivot (v for k in (total, matched, filled, have))", ("papers",), (
           "filled as materialized (select b.paper_id, m.doc_id row_no, m.fresh, case when m.fresh <> '' then m.fresh "
           "else b.old end affiliation from (select paper_id, case when paper_id like '%2' then '' else affiliation end "
           "old from papers) b left join (select doc_id, (doc_id * 3)::varchar paper_id, case when doc_id % 4 = 0 then "
           "'' else concat('New', doc_id::varchar) end fresh from documents) m on m.paper_id = b.paper_id)",))
def _(d):
    base = d.papers.select("paper_id", F.when(F.col("paper_id").endswith("2"), F.lit("")).otherwise(
        F.col("affiliation")).alias("affiliation"))
    docs = d.documents
    value = F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit(" New"), F.col("doc_id").cast("string"), F.lit("　")))
    meta = docs.select(F.col("doc_id").alias("row_no"), value.alias("affiliation"))
    links = docs.select((F.col("doc_id") * 3).cast("string").alias("paper_id"), F.col("doc_id").alias("row_no"))
    table, report = backfill_column(base, meta, links, "affiliation")
    counts = report.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("paper_id"), F.col(c).cast("string").alias("affiliation")) for c in report.columns
    ])).alias("r")).select("r.paper_id", "r.affiliation")
    return table.unionByName(counts)


DESIGN_DUCK = """design as materialized (select doc_id, paras, s, case when s is not null then coalesce((select min(i)
    from (select unnest(range(1, len(paras) + 1)) i, unnest(paras) p) where i > s and
    regexp_matches(p, '模型分析|实证分析|结果分析|实验结果|数据分析|讨论与结论')), len(paras) + 1) end e
  from (select doc_id, paras, (select min(i) from (select unnest(range(1, len(paras) + 1)) i, unnest(paras) p)
    where regexp_matches(p, '研究设计|研究方法|数据来源|实验设计|模型构建')) s from para_docs))"""
DESIGN_TEXT = f"case when s is null then '' else {d_strip('array_to_string(paras[s:e - 1], chr(10))')} end"


@check("build_papers",
       "select f.doc_id::varchar paper_id, coalesce(nullif(m.title, ''), f.doc_id::varchar) title, m.publish_year, "
       "coalesce(m.keywords, '') keywords, coalesce(m.core_type, '') core_type, case when regexp_matches(coalesce("
       "m.core_type, ''), '北大核心|CSSCI|CSCD|EI|SCI') then 1 else 0 end is_core, " + DESIGN_TEXT +
       " research_design_text, length(array_to_string(f.paras, chr(10) || chr(10))) body_chars, "
       f"len({d_tok('array_to_string(f.paras, chr(10) || chr(10))')}) body_tokens from design f left join "
       f"(select doc_id, min({CLEAN.format('t')}) k from (select doc_id, split_part(text, chr(10), 1) t from documents) "
       "group by 1) i on i.doc_id = f.doc_id left join (select *, paper_id::bigint row_no from (select paper_id, "
       f"{d_strip('title')} title, {d_strip('keywords')} keywords, core_type, publish_year from papers)) m on "
       "m.row_no = (select first_row from titles t where t.k = i.k)",
       ("papers", "para_docs"), (MATCHED[2], DESIGN_DUCK))
def _(d):
    docs = d.para_docs.join(
        d.documents.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title_hint")), "doc_id")
    docs = docs.select(F.col("doc_id").cast("string").alias("paper_id"), "title_hint", "paras")
    meta = meta_rows(d).withColumns({"db_class": F.col("core_type"), "subject_code": F.col("clc_number")})
    out = build_papers(docs, meta)
    return out.select(
        "paper_id", "title", "publish_year", "keywords", "core_type", "is_core", "research_design_text",
        F.length("raw_body").alias("body_chars"), F.size(TOKEN_COLUMNS["body"]).alias("body_tokens"))


# --- streaming --------------------------------------------------------------

def _wave(key, word, text):
    n = f"greatest(ceil((length({text}) - 100) / 400.0), 1)"
    return (f"select {key} paper_id, concat('{word} ', doc_id::varchar) title, case when length({text}) > 0 then "
            f"{n}::bigint end chunk_rows, case when length({text}) > 0 then (length({text}) + 100 * ({n} - 1))::bigint "
            "end chunk_chars from documents")


@check("stream_upsert",
       _wave("(doc_id * 2)::varchar", "wave two", "substr(text, instr(text, chr(10)) + 1)") + " union all "
       + _wave("doc_id::varchar", "wave one", "text") + " where doc_id::varchar not in (select (doc_id * 2)::varchar "
       "from documents)")
def _(d):
    """Two waves of papers; the second replaces every other paper by a shorter one."""
    docs = d.documents
    source, target, state = (scratch_path(d.spark, n) for n in ("waves", "target", "waves-state"))
    one = docs.select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(
        F.lit("wave one "), F.col("doc_id").cast("string")).alias("title"), "text", F.lit(1).alias("seq"))
    two = docs.select((F.col("doc_id") * 2).cast("string").alias("paper_id"), F.concat(
        F.lit("wave two "), F.col("doc_id").cast("string")).alias("title"),
        F.expr("substr(text, instr(text, chr(10)) + 1)").alias("text"), F.lit(2).alias("seq"))
    tables = si.BatchTables(d.spark, target)

    def to_chunks(rows):
        pieces = rows.select("paper_id", F.explode(sliding_chunks(F.col("text"))).alias("c"))
        return pieces.select("paper_id", "c.chunk_index", "c.chunk_text")

    for wave in (one, two):
        wave.write.mode("append").parquet(source)
        stream = d.spark.readStream.schema(wave.schema).parquet(source)
        si.stream_upsert(stream, tables, to_chunks, state, "seq").awaitTermination()
    sizes = tables.read("chunks").groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("chunk_rows"), F.sum(F.length("chunk_text")).alias("chunk_chars"))
    return tables.read("papers").select("paper_id", "title").join(sizes, "paper_id", "left")


_LAST = """last as materialized (select paper_id, case when w = 2 then null else title end title,
    case when w = 3 then null else keywords end keywords, case when w = 2 then null else abstract end abstract,
    case when w = 3 then null else research_design_text end research_design_text,
    case w when 2 then title when 3 then abstract else raw_body end raw_body from (select *,
    case when paper_id::bigint % 3 = 0 then 3 when paper_id::bigint % 2 = 0 then 2 else 1 end w from papers))"""


@check("stream_statistics", "select field, term, df, n n_docs, round(avgdl, 6) avgdl from dfs join fstats using (field)",
       ("papers",), (_LAST, *(c.replace("from papers", "from last") for c in index_ctes())))
def _(d):
    """Document frequencies and lengths after three waves of papers, of which the later ones shrink some."""
    none, whole = F.lit(None).cast("string"), d.papers.withColumn("seq", F.lit(1))
    number = F.col("paper_id").cast("bigint")
    waves = [
        whole,
        whole.filter(number % 2 == 0).withColumns({"title": none, "abstract": none, "raw_body": F.col("title")}),
        whole.filter(number % 3 == 0).withColumns(
            {"keywords": none, "research_design_text": none, "raw_body": F.col("abstract")}),
    ]
    source = scratch_path(d.spark, "waves")
    kept = StreamedStatistics(d.spark, scratch_path(d.spark, "statistics"))
    for wave in waves:
        wave.write.mode("append").parquet(source)
        kept.update(d.spark.readStream.schema(whole.schema).parquet(source), "seq")
    return kept.term_stats().join(kept.field_stats(), "field").select("field", "term", "df", "n_docs", r6("avgdl", "avgdl"))
