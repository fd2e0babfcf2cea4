"""URL filter: listed rules first, and association rules mined from labelled urls for the rest.

Listed rules name a host and the start of a path; a rule fits its host and all
subdomains, and the longest fitting rule decides.  For urls that none fits, the
method decides: a url becomes a set of tokens, Spark's FP-growth finds the token
sets that are frequent together with a label, and of the rules {tokens} ->
block those are kept that reach the support and the confidence asked for and
that no shorter rule of at least their confidence makes redundant.  A url is
blocked if a kept rule's tokens are all among its own.

Tokens are all parts of a url: its places (scheme, top-level domain, site, names before it, first and second
path segment, file ending, whether it has a query), every further host label and path segment, every query key, every key with its value,
and every word behind `://`.  Before FP-growth two things go that no rule can miss:
tokens that too few blocked urls have, and of tokens that exactly the same labelled
urls have all but one.  So copies of one long url add one token, however long it is.

A rule is as sure as its evidence allows: the lower end of the Wilson interval (`deviations` wide) of its
confidence has to reach the confidence asked for.  A set that too few blocked urls have cannot reach it
even if all its urls are blocked, which gives the least count that FP-growth needs; with
deviations=0 the plain confidence decides.

Rules are matched by an inverted index: each rule is filed under its rarest token, each distinct token set
looks up its own tokens and checks what it meets.  Urls of equal tokens are looked up once,
so a common host costs one lookup, and the answer is joined to the urls with a salt.

Defined cases: a null url or one without `://` has an empty host and path and no
tokens; it fits no rule and is allowed.  Repeated rows repeat.  Without labels, or
without frequent sets, no rule is mined.  Empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.scale import SALT, is_small

from .store import saved

SUPPORT = 0.002
CONFIDENCE = 0.7
DEVIATIONS = 3.0
PORTION = 1_000
BLOCK = "label=block"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# of tokens that the same urls have, the first kind stands for all
KINDS = ("tld", "site", "name", "sub", "scheme", "first", "second", "ending", "query", "label", "segment", "key", "param", "word")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, or nulls; rules are (host/path, verdict)."""
    none = F.lit(None).cast("string")
    rule, verdict = none, none
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _named(name: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(name + "="), v))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url, sorted."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    last = F.element_at(parts, -1)
    slots = [
        ("tld", F.element_at(labels, -1)), ("site", F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), "."))),
        ("name", F.when(F.size(labels) > 2, F.element_at(labels, -3))), ("sub", F.when(F.size(labels) > 3, F.get(labels, F.lit(0)))),
        ("scheme", F.substring_index(url, "://", 1)), ("first", F.get(parts, F.lit(1))), ("second", F.get(parts, F.lit(2))),
        ("ending", F.regexp_extract(last, r"\.([A-Za-z0-9]{1,8})$", 1)), ("query", F.when(url.contains("?"), F.lit("yes"))),
    ]
    filled = F.array(*[F.when(value != "", F.concat(F.lit(name + "="), value)) for name, value in slots])
    params = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    behind = F.translate(F.substring(url, F.instr(url, "://") + 3, F.length(url)), _UPPER, _LOWER)
    lists = [
        ("label", F.slice(labels, 1, F.greatest(F.size(labels) - 3, F.lit(0)))),
        ("segment", F.slice(parts, 4, F.size(parts))),
        ("key", F.transform(params, lambda p: F.substring_index(p, "=", 1))), ("param", params),
        ("word", F.regexp_extract_all(behind, F.lit(WORD), F.lit(0))),
    ]
    every = [_named(name, values) for name, values in lists]
    found = F.array_sort(F.array_distinct(F.concat(F.array_compact(filled), *every)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


def _repeated(rows: DataFrame) -> DataFrame:
    """Every row as often as `times` says, in portions that are spread over the tasks."""
    portions = rows.filter("times > 0").select("items", "times", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("times") - 1, F.lit(PORTION).cast("bigint"))).alias("from")).hint("rebalance")
    return portions.select("items", F.explode(F.array_repeat(
        F.lit(0), F.least(F.lit(PORTION), F.col("times") - F.col("from")).cast("int")))).select("items")


def _telling(labelled: DataFrame, least: int) -> DataFrame:
    """Baskets of FP-growth: tokens of `least` blocked urls, one of those that the same urls have."""
    sets = saved(labelled.groupBy("tokens").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("b")).withColumn("set", F.sha2(F.to_json("tokens"), 256)), "sets")
    each = sets.select("set", "n", "b", F.explode("tokens").alias("t"))
    alike = [F.bit_xor(F.xxhash64("set", F.lit(i))).alias(f"same{i}") for i in range(2)]
    counted = each.groupBy("t").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), *alike).filter(F.col("b") >= least)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.substring_index("t", "=", 1))
    first = counted.groupBy("n", "b", "same0", "same1").agg(F.min(F.struct(kind.alias("kind"), "t")).alias("first"))
    kept = each.join(first.select("first.t"), "t").groupBy("set", "n", "b").agg(F.collect_list("t").alias("items"))
    marked = _repeated(kept.select(F.concat("items", F.array(F.lit(BLOCK))).alias("items"), F.col("b").alias("times")))
    plain = _repeated(kept.select("items", (F.col("n") - F.col("b")).alias("times")))
    return marked.unionByName(plain)


def lower_end(confidence: Column, n: Column, deviations: float) -> Column:
    """Lower end of the Wilson interval of a share that was seen in n cases."""
    z = deviations * deviations
    spread = F.sqrt(confidence * (1 - confidence) / n + z / (4 * n * n))
    return (confidence + z / (2 * n) - deviations * spread) / (1 + z / n)


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE,
                deviations: float = DEVIATIONS) -> DataFrame:
    """(tokens, blocked) rows -> rules: antecedent, confidence, support; without redundant rules.

    `support` is the share of the labelled urls that have the rule's tokens and are blocked.
    """
    labelled = labelled.filter(F.size("tokens") > 0)
    schema = "antecedent array<string>, confidence double, support double"
    none = labelled.sparkSession.createDataFrame([], schema)
    total = labelled.count()
    evidence = deviations**2 * confidence / (1 - confidence) if confidence < 1 else deviations and math.inf
    # tolerances keep a count that is meant to suffice: shares and bounds are doubles
    wanted = max(support * total, evidence, 1) - 1e-6
    if wanted > total:
        return none
    least = math.ceil(wanted)
    baskets = saved(_telling(labelled, least), "baskets")
    n = baskets.count()
    if not n:
        return none
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(baskets)
    share, seen = F.col("support") * n / total, F.round(F.col("support") * n / F.col("confidence"))
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK))).filter(
        lower_end(F.col("confidence"), seen, deviations) >= confidence - 1e-9).select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", share.alias("support"))
    rules = saved(rules, "rules")
    # a rule is redundant if one with a part of its tokens is as sure: looked up by the shorter rule's first token
    long, short = rules.alias("l"), rules.alias("s")
    beaten = (long.withColumn("t", F.explode("antecedent")).join(
        short.select(F.col("antecedent").alias("part"), F.col("confidence").alias("sure"),
                     F.element_at("antecedent", 1).alias("t")), "t")
        .filter((F.size("part") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence"))
                & (F.size(F.array_except("part", "antecedent")) == 0))
        .select("antecedent").distinct())
    return rules.join(beaten, "antecedent", "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Token sets (tokens) that contain a rule -> tokens, matched, confidence of the surest (then longest) rule."""
    frequency = rules.select(F.explode("antecedent").alias("t")).groupBy("t").count()
    filed = rules.withColumn("t", F.explode("antecedent")).join(frequency, "t")
    index = filed.groupBy("antecedent", "confidence").agg(F.min_by("t", F.struct("count", "t")).alias("t"))
    met = (sets.withColumn("t", F.explode("tokens")).join(index, "t")
           .filter(F.size(F.array_except("antecedent", "tokens")) == 0))
    best = F.max_by(F.struct("antecedent", "confidence"), F.struct("confidence", F.size("antecedent"), "antecedent"))
    return met.groupBy("tokens").agg(best.alias("b")).select(
        "tokens", F.col("b.antecedent").alias("matched"), F.col("b.confidence").alias("confidence"))


def _with_answers(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the answer of their token set, if there is one; one set may be that of most rows."""
    if is_small(found):
        return rows.join(F.broadcast(found), "set", "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "path"), F.lit(SALT)).cast("int"))
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies, ["set", "_salt"], "left")


def judge(pages: DataFrame, labels: DataFrame, listed: list[tuple[str, str]], id_col: str = "page_id",
          url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE,
          deviations: float = DEVIATIONS) -> DataFrame:
    """id, host, path, rule, verdict (allow or block), matched tokens and confidence of every row.

    `labels` has (id, blocked).
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    rows = rows.select("_id", "host", "path", rule.alias("rule"), verdict.alias("listed"),
                       tokens(F.col("_url"), F.col("host"), F.col("path")).alias("tokens"))
    rows = saved(rows.withColumn("set", F.sha2(F.to_json("tokens"), 256)), "urls")
    known = labels.groupBy(F.col("id").alias("_id")).agg(F.max("blocked").alias("_blocked"))
    labelled = saved(rows.join(known, "_id").select("tokens", F.col("_blocked").alias("blocked")), "labelled")
    rules = saved(mined_rules(labelled, support, confidence, deviations), "rules")
    sets = rows.filter("listed is null").groupBy("set").agg(F.first("tokens").alias("tokens"))
    found = saved(match(sets, rules), "answers").withColumn("set", F.sha2(F.to_json("tokens"), 256)).drop("tokens")
    out = _with_answers(rows, found)
    mined = F.col("matched").isNotNull() & F.col("listed").isNull()
    return out.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("listed", F.when(mined, "block").otherwise("allow")).alias("verdict"),
        F.when(mined, F.array_join("matched", " ")).alias("matched"), F.when(mined, F.col("confidence")).alias("confidence"))
