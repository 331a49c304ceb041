"""URL filters with native expressions: rules for hosts and paths, matched by hashed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 500_000  # a digest, two short strings each: below 200 MB
BROADCAST_BYTES = 64 << 20
PREFIX = 8  # hex digits of a digest that the join compares first: 32 bits


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(rest, upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of rules from ``(host, path, verdict)`` triples."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    # A host holds no "/", so host and path cannot run into each other.
    return F.sha2(F.concat(host, path), 256)


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` holds ``(host, path, verdict)``. A rule fits its host and all subdomains if the
    page's path starts with the rule's; the longest rule (host and path together) wins, on equal
    length the one with the longer host, then ``block`` before ``allow``. Without a rule, ``rule`` is null and the verdict is
    ``default``. A null url, or one without ``://``, has an empty host and path, which only a
    rule without host could fit. Repeated rows are judged each; null ids are ids like others.
    Empty tables give empty results, other columns are ignored. Rules with a null in
    any column are no rules.

    Each url gives one expression for each suffix of its host, as far as rules have that many
    labels, and each path length that rules have. The expressions meet the rules by a short
    prefix of their digest, which then has to agree in full. The rules are broadcast after a check of
    their size; otherwise Spark joins by a shuffle and splits hot hosts.
    """
    clean = (
        rules.select("host", "path", "verdict").dropna().distinct()
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("digest", _digest(F.col("host"), F.col("path")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX))
    )
    n, n_bytes, labels, lengths = clean.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length("rule")), F.lit(0)),
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)), F.sort_array(F.collect_set(F.length("path"))),
    ).head()
    known = clean.select("prefix", "digest", "rule", F.length("host").alias("host_length"), F.col("verdict").alias("rule_verdict"))
    if n <= BROADCAST_RULES and n_bytes <= BROADCAST_BYTES:
        known = F.broadcast(known)

    rows = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
    )
    # Equal rows meet once; with a partial aggregation a page that fills the table costs nothing.
    rows = rows.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("_copies"))
    part = F.split("host", r"\.")
    kept = F.least(F.size(part), F.lit(labels))
    suffixes = F.when(kept > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(kept, F.lit(1))),
        lambda i: F.array_join(F.slice(part, F.size(part) - i + 1, i), "."),
    )).otherwise(F.array().cast("array<string>"))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: x <= F.length("path")),
        lambda x: F.substr(F.col("path"), F.lit(1), x),
    )
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    asked = rows.select("page_id", "host", "path", "_copies", F.explode(F.concat(F.array(F.lit("")), expressions)).alias("_digest"))
    # The empty expression keeps a row for pages that no rule fits.
    joined = asked.withColumn("prefix", F.substring("_digest", 1, PREFIX)).join(known, "prefix", "left")
    fits = F.col("digest") == F.col("_digest")
    rank = F.struct(
        F.length("rule").alias("length"), F.col("host_length"),
        (F.col("rule_verdict") == "block").alias("block"), F.col("rule"), F.col("rule_verdict"),
    )
    best = joined.groupBy("page_id", "host", "path").agg(
        F.max("_copies").alias("_copies"), F.max(F.when(fits, rank)).alias("best")
    )
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
