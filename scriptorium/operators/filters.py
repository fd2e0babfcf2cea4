"""Hard filters, metadata lookup and exact location."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clc_code, strip
from ..scale import cut_lineage, global_rank, small_join
from .containment import contained
from .scopes import Scopes

TEXT_FILTERS = {
    "authors": "author", "affiliations": "affiliation", "journals": "source_journal", "clcs": "clc_number",
}
# bin of a missing year
NO_YEAR = -(2**31)
FILTER_TYPE = (
    "struct<authors:array<string>,affiliations:array<string>,journals:array<string>,clcs:array<string>,"
    "years:array<int>,year_from:int,year_to:int,is_core:boolean>"
)


@dataclass(frozen=True)
class SearchFilters:
    """Several values of one field are alternatives; different fields all apply."""

    authors: list[str] = field(default_factory=list)
    affiliations: list[str] = field(default_factory=list)
    journals: list[str] = field(default_factory=list)
    clcs: list[str] = field(default_factory=list)
    years: list[int] = field(default_factory=list)
    year_from: int = 0
    year_to: int = 0
    is_core: bool | None = None
    # single-value form of older callers
    author: str = ""
    journal: str = ""
    publish_year: int = 0

    def normalized(self) -> "SearchFilters":
        return SearchFilters(
            authors=[*self.authors, *([self.author] if self.author else [])],
            affiliations=list(self.affiliations),
            journals=[*self.journals, *([self.journal] if self.journal else [])],
            clcs=list(self.clcs),
            years=[*self.years, *([self.publish_year] if self.publish_year > 0 else [])],
            year_from=self.year_from, year_to=self.year_to, is_core=self.is_core,
        )

    def as_row(self) -> tuple:
        n = self.normalized()
        return (n.authors, n.affiliations, n.journals, n.clcs, n.years, n.year_from, n.year_to, n.is_core)


def _has(column: str, value: Column) -> Column:
    return F.lower(F.col(column)).contains(F.lower(value))


def filter_condition(filters: SearchFilters | None) -> Column | None:
    """The filter as a Column, or None when it sets no condition."""
    if filters is None:
        return None
    f = filters.normalized()
    parts: list[Column] = []
    for name, column in TEXT_FILTERS.items():
        values = [v.strip() for v in getattr(f, name) if v.strip()]
        if name == "clcs":
            values = [c for c in (_code(v) for v in values) if c]
        if values:
            parts.append(reduce(or_, [_has(column, F.lit(v)) for v in values]))
    if f.years:
        parts.append(F.col("publish_year").isin(f.years))
    if f.year_from > 0:
        parts.append(F.col("publish_year") >= f.year_from)
    if f.year_to > 0:
        parts.append(F.col("publish_year") <= f.year_to)
    if f.is_core is True:
        parts.append(F.col("is_core") == 1)
    elif f.is_core is False:
        parts.append(F.coalesce(F.col("is_core"), F.lit(0)) == 0)
    return reduce(and_, parts) if parts else None


def _code(value: str) -> str:
    at = min((i for i in (value.find("("), value.find("（")) if i > 0), default=-1)
    return (value[:at] if at > 0 else value).strip()


def hard_filter(papers: DataFrame, filters: SearchFilters | None) -> DataFrame:
    condition = filter_condition(filters)
    return papers if condition is None else papers.filter(condition)


# --- filters held in a table ------------------------------------------------

def clean_values(values: Column, code: bool = False) -> Column:
    return F.filter(F.transform(values, clc_code if code else strip), lambda v: v != "")


def normalize_filter(f: Column) -> Column:
    """Blank values removed, codes cut, NULL parts replaced by their neutral value."""
    none = F.array().cast("array<string>")
    texts = [
        F.coalesce(clean_values(f[name], name == "clcs"), none).alias(name) for name in TEXT_FILTERS
    ]
    return F.struct(
        *texts,
        F.coalesce(f["years"], F.array().cast("array<int>")).alias("years"),
        F.coalesce(f["year_from"], F.lit(0)).alias("year_from"),
        F.coalesce(f["year_to"], F.lit(0)).alias("year_to"),
        f["is_core"].alias("is_core"),
    )


def filter_is_set(f: Column) -> Column:
    """Whether a normalised filter has any condition."""
    lists = [F.size(f[n]) > 0 for n in (*TEXT_FILTERS, "years")]
    return F.coalesce(
        reduce(or_, lists) | (f["year_from"] > 0) | (f["year_to"] > 0) | f["is_core"].isNotNull(), F.lit(False))


def _number_test(f: Column, year: Column, core: Column) -> Column:
    """The years and the core mark of a normalised filter, tested against values."""
    known = F.coalesce(year, F.lit(-1))
    return reduce(and_, [
        (F.size(f["years"]) == 0) | F.array_contains(f["years"], known),
        (f["year_from"] <= 0) | (known >= f["year_from"]),
        (f["year_to"] <= 0) | ((known <= f["year_to"]) & year.isNotNull()),
        f["is_core"].isNull() | (f["is_core"] == core),
    ])


def _number_matches(numbers: DataFrame, filters: DataFrame) -> DataFrame:
    """(scope, field, value) for filters with a condition on years or the core mark.

    numbers(publish_year, core, value) are the distinct pairs of the papers.  Pairs and filters meet by
    bins of years; the bin of missing years is asked by every filter.
    """
    f = F.col("filter")
    first, last = numbers.agg(F.min("publish_year"), F.max("publish_year")).first()
    first, last = (0, 0) if first is None else (first, last)
    since = F.greatest(F.when(f["year_from"] > 0, f["year_from"]), F.lit(first))
    until = F.least(F.when(f["year_to"] > 0, f["year_to"]), F.lit(last))
    bins = (F.when(F.size(f["years"]) > 0, F.transform(f["years"], lambda y: F.shiftright(y, 4)))
            .when(since <= until, F.sequence(F.shiftright(since, 4), F.shiftright(until, 4)))
            .otherwise(F.array().cast("array<int>")))
    asked = filters.filter(_asks_numbers(f)).select(
        "scope", "filter", F.explode(F.array_distinct(F.concat(bins, F.array(F.lit(NO_YEAR))))).alias("bin"))
    offered = numbers.withColumn("bin", F.coalesce(F.shiftright("publish_year", 4), F.lit(NO_YEAR)))
    met = offered.join(asked, "bin").filter(_number_test(f, F.col("publish_year"), F.col("core")))
    return met.select("scope", F.lit("numbers").alias("field"), "value")


def _asks_numbers(f: Column) -> Column:
    return (F.size(f["years"]) > 0) | (f["year_from"] > 0) | (f["year_to"] > 0) | f["is_core"].isNotNull()


def _scope_matches(papers: DataFrame, filters: DataFrame) -> DataFrame:
    """(paper_id, scope) for the distinct filters of a batch.

    Conditions are settled on the distinct values of each column: substrings by
    their rarest gram, years by bins.  Papers then look their own values up, and belong to
    a scope if all of its conditions found them; filters are never tested paper by paper.
    """
    filters = cut_lineage(filters)
    f = F.col("filter")
    lists = F.array(*[F.struct(F.lit(c).alias("field"), f[n].alias("values")) for n, c in TEXT_FILTERS.items()])
    asked = filters.select("scope", F.explode(lists).alias("t")).select(
        "scope", "t.field", F.explode("t.values").alias("v")).select("scope", "field", F.lower("v").alias("needle")).distinct()
    core = F.coalesce(F.col("is_core"), F.lit(0)) == 1
    pair = F.concat_ws(",", F.coalesce(F.col("publish_year").cast("string"), F.lit("")), core.cast("string"))
    values = [(c, F.lower(F.coalesce(F.col(c), F.lit("")))) for c in TEXT_FILTERS.values()]
    entry = F.array(*[F.struct(F.lit(c).alias("field"), v.alias("value")) for c, v in [*values, ("numbers", pair)]])
    held = papers.select("paper_id", F.explode(entry).alias("e")).select("paper_id", "e.field", "e.value")
    hays = held.filter("field != 'numbers' and value != ''").select("field", F.col("value").alias("hay")).distinct()
    # only columns that some filter asks about are cut into grams
    hays = hays.join(F.broadcast(asked.select("field").distinct()), "field", "left_semi")
    texts = contained(asked.select("field", "needle").distinct(), hays).join(asked, ["field", "needle"]).select(
        "scope", "field", F.col("hay").alias("value")).distinct()
    numbers = papers.select("publish_year", core.alias("core"), pair.alias("value")).distinct()
    met = cut_lineage(texts.unionByName(_number_matches(numbers, filters)))
    found = small_join(held, met, ["field", "value"], spread_by=["paper_id"]).groupBy("paper_id", "scope").agg(
        F.size(F.collect_set("field")).alias("_got"))
    need = reduce(lambda a, b: a + b, [(F.size(f[n]) > 0).cast("int") for n in TEXT_FILTERS], _asks_numbers(f).cast("int"))
    return small_join(found, filters.select("scope", need.alias("_need")), ["scope"], spread_by=["paper_id"]).filter(
        "_got = _need").select("paper_id", "scope")


def scope_name(f: Column) -> Column:
    return F.md5(F.to_json(f))


def allowed_merge(papers: DataFrame, queries: DataFrame, analysis: str = "analysis_filter",
                  user: str = "user_filter") -> Scopes:
    """Scopes of a batch: analysis filter and user filter must both hold.

    An analysis filter that matches no paper at all is dropped; a user filter
    never is.
    """
    wanted = queries.select(
        "query_id",
        normalize_filter(F.col(analysis)).alias("a"),
        normalize_filter(F.col(user)).alias("u"),
    )
    options = F.array(
        F.struct(F.lit(True).alias("soft"), F.col("a").alias("filter")),
        F.struct(F.lit(False).alias("soft"), F.col("u").alias("filter")),
    )
    listed = (
        wanted.select("query_id", F.explode(options).alias("o"))
        .select("query_id", "o.soft", "o.filter")
        .filter(filter_is_set(F.col("filter")))
        .withColumn("scope", scope_name(F.col("filter")))
    )
    filters = listed.groupBy("scope").agg(F.first("filter").alias("filter"))
    # read for the dropped filters, and by every search arm: the papers are tested once
    matches = cut_lineage(_scope_matches(papers, filters))
    alive = matches.groupBy("scope").agg(F.lit(True).alias("alive"))
    kept = listed.join(alive, "scope", "left").filter(~F.col("soft") | F.col("alive"))
    return Scopes(
        queries=kept.groupBy("query_id").agg(F.collect_set("scope").alias("scopes")),
        papers=matches.groupBy("paper_id").agg(F.collect_set("scope").alias("scopes")),
        batch=queries.select("query_id"),
    )


def user_scopes(papers: DataFrame, queries: DataFrame, column: str = "filter") -> Scopes:
    """Scopes of a batch with one filter per query that is never dropped."""
    none = F.lit(None).cast(FILTER_TYPE)
    return allowed_merge(papers, queries.select("query_id", none.alias("_none"), column), "_none", column)


def allowed_papers(scopes: Scopes) -> DataFrame:
    """(query_id, paper_id) of the restricted queries, by an equi-join on scope."""
    need = scopes.queries.select("query_id", F.size("scopes").alias("_need"), F.explode("scopes").alias("scope"))
    have = scopes.papers.select("paper_id", F.explode("scopes").alias("scope"))
    found = have.join(need, "scope").groupBy("query_id", "paper_id").agg(
        F.count(F.lit(1)).alias("_got"), F.first("_need").alias("_need"))
    return found.filter(F.col("_got") == F.col("_need")).select("query_id", "paper_id")


# --- metadata search --------------------------------------------------------

def lookup_condition(field_name: str, q: str, year: int = 0, filters: SearchFilters | None = None) -> Column | None:
    parts = []
    if year > 0:
        parts.append(F.col("publish_year") == year)
    q = (q or "").strip()
    if field_name in ("author", "affiliation", "doi") and q:
        parts.append(_has(field_name, F.lit(q)))
    elif field_name == "first_author" and q:
        parts.append(F.lower(strip("author")).startswith(q.lower()))
    extra = filter_condition(filters)
    if extra is not None:
        parts.append(extra)
    return reduce(and_, parts) if parts else None


def field_lookup(papers: DataFrame, field_name: str, q: str, year: int = 0,
                 filters: SearchFilters | None = None) -> DataFrame:
    """Papers by a metadata column, score 0, ranked by id; no condition, no hits."""
    condition = lookup_condition(field_name, q, year, filters)
    found = papers.filter(F.lit(False) if condition is None else condition)
    hits = found.select("paper_id", F.lit(0.0).alias("score"))
    return global_rank(hits, [], [F.col("paper_id").asc()])


def locate_exact(papers: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(query_id, doi, title) -> the smallest matching paper_id."""
    def by(column):
        asked = requests.select("query_id", strip(column).alias(column)).filter(F.col(column) != "")
        # one row per value first: titles repeat
        held = papers.groupBy(column).agg(F.min("paper_id").alias("paper_id"))
        return held.join(asked, column).select("query_id", "paper_id")
    return by("doi").unionByName(by("title")).groupBy("query_id").agg(F.min("paper_id").alias("paper_id"))
