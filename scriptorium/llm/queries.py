"""The operators of this package as queries over the driver tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, toxicity
from .hamming_search import nearest_codes, sign_code
from .max_sketch import rank_documents
from .near_dedup import near_duplicates
from .packing import pack
from .secret_scan import KINDS, counted, listed, scan
from .source_mix import mix
from .spelling import count_words, group_variants
from .store import saved
from .substring_dedup import remove_repeats
from .token_counts import section_tokens
from .url_filter import judge
from .vector_search import nearest_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]+"
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup", rf"""
with words as (select doc_id, {WORDS_SQL} w from documents),
windows as (select doc_id, s, array_to_string(list_slice(w, s + 1, s + 20), ' ') k
  from (select doc_id, w, unnest(range(len(w) - 19)) s from words where len(w) >= 20)),
firsts as (select k, min((doc_id, s)) f from windows group by k),
covered as (select distinct doc_id, unnest(range(s, s + 20)) i from windows join firsts using (k)
  where (doc_id, s) > f),
lost as (select doc_id, list(i) gone from covered group by doc_id)
select w.doc_id, len(w)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
  sha256(array_to_string(case when gone is null then w else
    list_transform(list_filter(range(len(w)), lambda x: not list_contains(gone, x)), lambda x: w[x + 1]) end, ' ')) kept_sha256
from words w left join lost l on l.doc_id = w.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), min_words=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = bpe.default_ranks()
    both = bpe.encode(table(spark, sf_dir, "documents"), path=path, pattern=pattern, decoded="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    counts = [counted(F.col("spans"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@query("op7_exact_topk", """
with codes as (select distinct vec_id, list_transform(embedding, lambda x: (x > 0)::int) b from embeddings
  where embedding is not null),
pairs as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.b, c.b), lambda z: (z[1] <> z[2])::int))::int
  distance from codes q join codes c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int rank, vec_id, distance from (select *, row_number() over (partition by query_id
  order by distance, vec_id) rank from pairs) where rank <= 10""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes (a bit a component) of every row whose id is divisible by 20."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    found = nearest_codes(codes, codes.filter("vec_id % 20 = 0"), "vec_id", "code", k=10)
    return found.withColumnRenamed("id", "vec_id")


@query("op8_near_dedup", rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as materialized (select distinct doc_id, array_to_string(list_slice(w, s + 1, s + 4), ' ') g from (select doc_id, w,
    unnest(range(greatest(len(w) - 3, 1))) s from words where len(w) > 0)),
sizes as materialized (select doc_id, count(*) n from sets group by doc_id),
links as materialized (select a, b from (select x.doc_id a, y.doc_id b, count(*) c from sets x join sets y
    on x.g = y.g and x.doc_id <> y.doc_id group by all) join sizes s on s.doc_id = a join sizes t on t.doc_id = b
    where 100 * c >= 80 * (s.n + t.n - c)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a doc_id, least(a, min(b)) c from reach group by a)
select w.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(c, w.doc_id)::bigint component_id,
    coalesce(c, w.doc_id) = w.doc_id kept
from words w left join sizes s on s.doc_id = w.doc_id left join least l on l.doc_id = w.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


@query("op9_nearest_vectors")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest_vectors(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query("op10_source_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), share=1.5, weights=(3.0, 1.0, 2.0), epochs=2.0)
    return mixed.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_times") * F.col("_size")).alias("taken"))


LISTED = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled through `labels` of the same id: bad quality or toxic is to be blocked."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return judge(table(spark, sf_dir, "pages"), labels, LISTED)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.slice("evidence", 1, 3).alias("evidence"))


@query("op11_ranked_search", r"""
with terms as materialized (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from documents),
counts as materialized (select doc_id, t, count(*) tf from terms group by all),
lengths as materialized (select doc_id, sum(tf)::bigint n from counts group by all),
total as (select count(*) docs, sum(n)::bigint l from lengths),
weights as (select t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint w from counts, total group by t),
asked as (select item_id, t, count(*) times from (select item_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t
    from benchmark) group by all),
scores as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // l))))::bigint
    score from asked join counts using (t) join weights using (t) join lengths using (doc_id), total group by all)
select item_id, rank::int rank, doc_id, score from (select *, row_number() over (partition by item_id
    order by score desc, doc_id) rank from scores where score > 0) where rank <= 20""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    found = rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents; one in 31 words of a document lacks a letter."""
    words = saved(count_words(table(spark, sf_dir, "documents"), shortest=7, least=2, typos_every=31), "words")
    return group_variants(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens."""
    return pack(table(spark, sf_dir, "documents"), window=1_024).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
