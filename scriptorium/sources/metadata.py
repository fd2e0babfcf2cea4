"""Bibliographic metadata: CSV exports and thesis sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import extract_journal, extract_year, strip

TRIMMED = ("title", "author", "keywords", "abstract", "doi", "source_journal")


def normalize_metadata(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename known headers, add missing columns, derive journal and year.

    An unknown first column is the serial number.  Several headers may map to
    one name; the first in the alias list with a value wins.
    """
    aliases = rules.METADATA_ALIASES if aliases is None else aliases
    headers = df.columns
    sources: dict[str, list[str]] = {}
    if headers and headers[0].strip() not in aliases:
        sources["serial"] = [headers[0]]
    for header, name in aliases.items():
        if header in headers:
            sources.setdefault(name, []).append(header)
    used = {h for hs in sources.values() for h in hs}
    columns = [
        F.coalesce(*[F.col(f"`{h}`").cast("string") for h in sources.get(name, [])], F.lit("")).alias(name)
        for name in rules.METADATA_COLUMNS
    ]
    extra = [F.col(f"`{h}`") for h in headers if h not in used and h not in rules.METADATA_COLUMNS]
    named = df.select(*columns, *extra)
    derived = named.withColumns({
        "source_journal": extract_journal("source"), "publish_year": extract_year("source")})
    return derived.withColumns({c: strip(c) for c in TRIMMED})


def read_metadata(spark: SparkSession, path: str, encoding: str = "utf-8", aliases: dict[str, str] | None = None,
                  multiline: bool = False) -> DataFrame:
    """Read a metadata CSV, all columns as text.

    gb18030 and gbk need spark.sql.legacy.javaCharsets=true.  Set `multiline`
    only for files with line breaks inside quotes: such files are not split.
    """
    raw = (
        spark.read.option("header", True).option("encoding", encoding).option("multiLine", multiline)
        .option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path))
    return normalize_metadata(raw, aliases)


def thesis_to_journal_schema(df: DataFrame) -> DataFrame:
    """Thesis rows in the columns of the journal export; blank titles dropped."""
    def text(name):
        return strip(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in df.columns else F.lit("")

    unit, year = text("学位授予单位"), text("学位年度")
    source = (
        F.when(unit != "", F.concat(unit, F.lit("（学位论文）,"), year))
        .when(year != "", F.concat(F.lit("学位论文,"), year)).otherwise(F.lit("")))
    values = {name: text(name) for name in ("序号", "题名", "作者", "关键词", "摘要", "DOI", "中图分类号")}
    values.update({"作者单位": unit, "刊名": source, "核心类型": F.lit(rules.THESIS_CLASS)})
    return df.filter(text("题名") != "").select(
        *[values.get(h, F.lit("")).alias(h) for h in rules.JOURNAL_HEADERS])
