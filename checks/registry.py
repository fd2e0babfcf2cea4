"""Checks: a Spark query over the driver tables and its SQL twin.

Ranked lists, nested values and vectors are flattened to plain columns, doubles
are rounded to six digits, so both engines give comparable rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import VIEWS, duck_view, spark_view, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Views and tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return spark_view(self.spark, self.sf_dir, name)
        return table(self.spark, self.sf_dir, name)


def check(name: str, sql: str | None = None, views: tuple[str, ...] = (), ctes: tuple[str, ...] = ()):
    """Register a query; `views` and `ctes` are put in front of its SQL."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Data(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            parts = [duck_view(v) for v in views] + list(ctes)
            ORACLES[name] = (f"with {', '.join(parts)} " if parts else "") + sql
        return fn
    return register


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# --- SQL fragments shared by the oracles -------------------------------------

STRIP = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"


def d_strip(e: str) -> str:
    return f"regexp_replace({e}, {STRIP})"


def d_tok(e: str) -> str:
    """Token list of a text."""
    return (
        f"flatten(list_transform(regexp_extract_all({e}, '[A-Za-z0-9]+|\\p{{Han}}+'), lambda r: "
        "case when regexp_matches(r, '^[A-Za-z0-9]') then [lower(r)] else "
        "flatten(list_transform(range(1, length(r) + 1), lambda i: case when i < length(r) "
        "then [substr(r, i, 1), substr(r, i, 2)] else [substr(r, i, 1)] end)) end))")


_FIELD_ROWS = (
    ("title", "title", 8, 0), ("keywords", "keywords", 5, 1), ("abstract", "abstract", 3, 2),
    ("research_design", "research_design_text", 4, 3), ("body", "raw_body", 1, 4),
)


def index_ctes() -> tuple[str, ...]:
    toks = " union all ".join(
        f"select paper_id, '{f}' field, unnest({d_tok(c)}) term from papers" for f, c, _, _ in _FIELD_ROWS)
    return (
        f"toks as materialized ({toks})",
        "post as materialized (select paper_id, field, term, count(*) tf from toks group by all)",
        "dls as materialized (select paper_id, field, count(*) dl from toks group by all)",
        "dfs as materialized (select field, term, count(*) df from post group by all)",
        "fields(field, weight, no) as (values "
        + ", ".join(f"('{f}', {w}::double, {n})" for f, _, w, n in _FIELD_ROWS) + ")",
        "ndocs as (select count(*) n from papers)",
        "fstats as materialized (select field, weight, no, n, coalesce((select sum(dl) from dls d where "
        "d.field = f.field), 0)::double / n avgdl from fields f, ndocs)",
    )


def bm25_ctes(prefix: str, source: str, text: str = "q", mask: str = "true") -> tuple[str, ...]:
    """{prefix}_scores(query_id, paper_id, score, matched) for queries in `source`.

    `mask` is a condition on field (and on the source row s) for active fields.
    """
    return (
        f"{prefix}_terms as materialized (select query_id, f.field, t.term, f.weight, f.no, f.avgdl, f.n, "
        f"t.title_active from (select distinct s.query_id, unnest({d_tok('s.' + text)}) term, "
        f"(select count(*) > 0 from fields ff where ff.field = 'title' and {mask.replace('field', 'ff.field')}) "
        f"title_active, s from {source} s) t join fstats f on {mask.replace('field', 'f.field')} and f.avgdl > 0)",
        f"{prefix}_scores as materialized (select query_id, paper_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) "
        "* tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) * case when bool_or(title_active) and not "
        "bool_or(no = 0) then 0.7 else 1.0 end score, concat_ws(',', "
        + ", ".join(f"case when bool_or(no = {n}) then '{f}' end" for f, _, _, n in _FIELD_ROWS)
        + f") matched from {prefix}_terms join post using (field, term) join dfs using (field, term) "
        "join dls using (paper_id, field) group by query_id, paper_id)",
    )


def ranked_cte(name: str, source: str, k: int, where: str = "true") -> str:
    return (
        f"{name} as materialized (select * from (select *, row_number() over (partition by query_id order by "
        f"round(score, 6) desc, paper_id) rank from {source} where {where}) where rank <= {k})")


def vector_ctes(prefix: str, source: str, floor: float, k: int = 200, papers_k: int = 200,
                where: str = "true") -> tuple[str, ...]:
    """{prefix}_chunks and {prefix}_hits: chunk hits and paper hits by cosine."""
    return (
        f"{prefix}_pairs as materialized (select s.query_id, c.chunk_id, c.paper_id, c.chunk_index, "
        "list_cosine_similarity(c.embedding::double[], s.q_vec::double[]) score "
        f"from {source} s, chunks c where {where})",
        f"{prefix}_chunks as materialized (select * from (select *, row_number() over (partition by query_id order by "
        f"round(score, 6) desc, chunk_id) rank from {prefix}_pairs where score > 0 and score >= {floor}) "
        f"where rank <= {k})",
        f"{prefix}_best as (select query_id, paper_id, max(score) score, 'chunk' matched from {prefix}_chunks "
        "group by all)",
        ranked_cte(f"{prefix}_hits", f"{prefix}_best", papers_k),
    )


def rrf_cte(name: str, a: str, b: str, top: int) -> str:
    return (
        f"{name} as materialized (select * from (select *, row_number() over (partition by query_id order by "
        "round(score, 12) desc, paper_id) rank from (select query_id, paper_id, sum(1.0::double / (60 + rank)) score, "
        "array_to_string(list_sort(list_distinct(flatten(list(string_split(matched, ','))))), ',') matched "
        f"from (select query_id, paper_id, matched, rank from {a} union all "
        f"select query_id, paper_id, matched, rank from {b}) group by query_id, paper_id)) where rank <= {top})")


def precision_ctes(name: str, source: str) -> tuple[str, ...]:
    return (
        f"{name}_kept as (select query_id, paper_id, score, matched, row_number() over (partition by query_id "
        f"order by rank) pos from {source} where rank <= 12 or list_contains(string_split(matched, ','), 'chunk'))",
        f"{name}_next as (select *, lead(score) over (partition by query_id order by pos) nxt from {name}_kept)",
        f"{name}_cut as (select query_id, min(pos) cut_at from {name}_next where pos >= 4 and nxt < 0.55 * score "
        "group by query_id)",
        f"{name} as materialized (select n.query_id, paper_id, score, matched, pos rank from {name}_next n "
        f"left join {name}_cut c on c.query_id = n.query_id where pos <= 50 and (c.cut_at is null or pos <= c.cut_at))",
    )


def hits_out(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "paper_id", r6("score", "score"),
                       F.array_join("matched_fields", ",").alias("matched"), F.col("rank").cast("int").alias("rank"))


HITS_SQL = "select query_id, paper_id, round(score, 6) score, matched, rank::int rank from {}"
