"""Test views over the driver tables, in Spark and as DuckDB text.

Both engines build the same rows: the Spark side with the SQL below, the DuckDB
side by inlining the same text as a CTE.  Every view covers whole tables and
whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("part", "documents", "embeddings", "benchmark", "events")

PAPERS = """
select cast(d.doc_id as {S}) paper_id,
  split_part(d.text, chr(10), 1) title,
  concat('10.1000/', cast(d.doc_id as {S})) doi,
  case when d.doc_id % 29 = 0 then null else cast(2000 + d.doc_id % 25 as int) end publish_year,
  concat('Author', cast(d.doc_id % 37 as {S}), ';Author', cast(d.doc_id % 11 as {S})) author,
  concat(p.p_brand, ';', p.p_type, ';', replace(p.p_name, ' ', ';')) keywords,
  substr(d.text, cast(instr(d.text, chr(10)) + 1 as int)) abstract,
  d.source source_journal,
  concat('Univ', cast(d.doc_id % 13 as {S}), '; Lab', cast(d.doc_id % 7 as {S})) affiliation,
  case d.doc_id % 5 when 0 then 'CSSCI' when 1 then 'EI;SCI' when 2 then '学位论文' else '' end core_type,
  case when d.doc_id % 5 in (0, 1) then 1 else 0 end is_core,
  concat(upper(d.lang), cast(d.doc_id % 9 as {S}), ';G', cast(d.doc_id % 4 as {S})) clc_number,
  split_part(d.text, chr(10), 2) research_design_text,
  d.text raw_body
from documents d
cross join (select count(*) n from part) c
join part p on p.p_partkey = d.doc_id % c.n
"""

# five chunks that together cover the whole text of each document; vectors repeat where there are fewer than chunks
CHUNKS = """
select concat(cast(d.doc_id as {S}), '::', cast(s.i as {S})) chunk_id,
  cast(d.doc_id as {S}) paper_id,
  cast(s.i as int) chunk_index,
  substr(d.text, cast(1 + s.i * ceil(length(d.text) / 5.0) as int), cast(ceil(length(d.text) / 5.0) as int)) chunk_text,
  case e.label % 6 when 0 then '概念解释' when 1 then '背景说明' when 2 then '方法依据' when 3 then '经验证据' when 4 then '研究空白' else '其他' end section_role,
  concat('chapter ', cast(s.i as {S})) chapter_title,
  e.embedding
from documents d
cross join (select 0 i union all select 1 union all select 2 union all select 3 union all select 4) s
cross join (select count(*) n from embeddings) c
join embeddings e on e.vec_id = (d.doc_id * 5 + s.i) % c.n
"""

QUERIES = """
select b.item_id query_id, b.text q, e.embedding q_vec
from benchmark b
join embeddings e on e.vec_id = b.item_id
"""

HISTORY = "select event_id id, event_type mode, cast(user_id as {S}) query, props filters, ts created_at from events"

HEADINGS = ("引言与背景", "研究方法与模型", "实验结果分析", "结论与展望", "参考文献")

_PARA_SPARK = """
select doc_id, flatten(transform(split(text, '\\\\n'), (para, pos) -> case when pos % 4 = 0
    then array(concat(cast(cast(floor(pos / 4) as int) + 1 as string), ' ',
      element_at(array('引言与背景', '研究方法与模型', '实验结果分析', '结论与展望', '参考文献'),
                 cast(floor(pos / 4) as int) % 5 + 1)), trim(para))
    else array(trim(para)) end)) paras
from documents
"""

_PARA_DUCK = """
select doc_id, flatten(list_transform(range(len(l)), lambda pos: case when pos % 4 = 0
    then [concat(cast(cast(floor(pos / 4) as int) + 1 as varchar), ' ',
      list_extract(['引言与背景', '研究方法与模型', '实验结果分析', '结论与展望', '参考文献'],
                   cast(floor(pos / 4) as int) % 5 + 1)), trim(l[pos + 1])]
    else [trim(l[pos + 1])] end)) paras
from (select doc_id, string_split(text, chr(10)) l from documents)
"""

_SPLITS: dict[tuple[str, int], int] = {}

VIEWS = {"papers": PAPERS, "chunks": CHUNKS, "queries": QUERIES, "history": HISTORY, "para_docs": None}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views above, reading only the tables it needs."""
    frames = {t: table(spark, sf_dir, t) for t in TABLES}
    text = _PARA_SPARK if name == "para_docs" else VIEWS[name].replace("{S}", "string")
    used = {t: df for t, df in frames.items() if f" {t}" in text.replace("\n", " ")}
    for t, df in used.items():
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(text, **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over all cores when the file has too few splits."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents":
        key = (sf_dir, cores)
        if key not in _SPLITS:
            _SPLITS[key] = df.rdd.getNumPartitions()
        if _SPLITS[key] < cores:
            return df.repartition(cores)
    return df


def duck_view(name: str) -> str:
    """CTE text of a view."""
    text = _PARA_DUCK if name == "para_docs" else VIEWS[name].replace("{S}", "varchar")
    return f"{name} as materialized ({text.strip()})"
