"""Documents as ordered paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import derive_paper_id
from ..operators.segmentation import clean_paragraphs, is_noise

# fixed values: lock and companion files that office programs leave behind
SKIPPED_FILES = r"(^|/)(~\$|\._)[^/]*$"


def noise_filter(paragraphs: DataFrame, text: str = "para") -> DataFrame:
    """Drop watermark, page-number and footnote paragraphs."""
    return paragraphs.filter(~is_noise(F.col(text)))


def with_paragraphs(docs: DataFrame, text: str = "text", keep_noise: bool = False) -> DataFrame:
    """Add paras, the clean paragraph array; the document stays one row."""
    return docs.withColumn("paras", clean_paragraphs(F.coalesce(text, F.lit("")), keep_noise))


def read_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, para): non-blank trimmed paragraphs without noise, numbered from 0."""
    return with_paragraphs(docs.select(key, text), text).select(key, F.posexplode("paras").alias("pos", "para"))


def full_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs joined by blank lines."""
    return docs.select(key, F.array_join("paras", "\n\n").alias("full_text"))


def hidden_documents(spark: SparkSession, path: str, glob: str = "*.txt") -> list[str]:
    """Names in a folder that match but that Spark lists for no reader: those that start with an underscore."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_{glob}")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(s.getPath().getName() for s in found or [])


def read_documents(spark: SparkSession, path: str, glob: str = "*.txt", skip_hidden: bool = False) -> DataFrame:
    """One row per text file: (paper_id, text); lock and companion files skipped.

    Spark lists no file whose name starts with an underscore.  Such a file is an
    error, so that none is lost in silence, unless `skip_hidden` is set.
    """
    hidden = [] if skip_hidden else hidden_documents(spark, path, glob)
    if hidden:
        raise ValueError(f"rename {len(hidden)} files whose names start with an underscore: {', '.join(hidden[:5])}")
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    # names are percent-encoded; a plus sign is one
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    named = files.select(name.alias("path"), F.col("value").alias("text"))
    return named.filter(~F.col("path").rlike(SKIPPED_FILES)).select(derive_paper_id("path").alias("paper_id"), "text")
