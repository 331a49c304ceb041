"""The enrichment job: analyse each distinct text once, remember it, give it to every row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import strip_spaces, text_key
from murmur.operators.classify import classify, classify_as_result
from murmur.operators.joins import broadcast_if_small
from murmur.operators.lexicon import Lexicon
from murmur.operators.replies import numbered_results, parse_replies, with_fallback, with_numbered_entry
from murmur.schema import ORD, RESULT_FIELDS
from murmur.session import cut_lineage, small_arrow_batches

# Texts in, one reply text per text out. A raised error sends the batch to the rule classifier.
Scorer = Callable[[list[str]], list[str]]
# Texts in, one reply out: a JSON array whose entries name their text by ``id``, from 1.
BatchScorer = Callable[[list[str]], str]

BATCH_SIZE = 10
BATCH_BYTES = 8 << 20  # of texts in one call; a longer text goes alone


@dataclass
class Enriched:
    rows: DataFrame
    fresh: DataFrame  # (cache_key, result) of the texts analysed now, for ``save_cache``


def batches(frame: pd.DataFrame, rows: int, size: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """The frame in order, cut by number of rows and by bytes of text."""
    start = used = 0
    for i, text in enumerate(frame["feedback"]):
        own = len(text.encode()) if text else 0
        if i > start and (i - start >= rows or used + own > size):
            yield frame.iloc[start:i]
            start, used = i, 0
        used += own
    if start < len(frame):
        yield frame.iloc[start:]


def _ask(scorer: Scorer, batch_size: int):
    """Feed a partition's texts to the scorer in small batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame, batch_size):
                texts = part["feedback"].tolist()
                try:
                    replies, error = list(scorer(texts)), None
                    if len(replies) != len(texts):
                        raise ValueError(f"{len(replies)} replies for {len(texts)} texts")
                except Exception as problem:
                    replies, error = [None] * len(texts), f"API error: {problem}"
                replies = [r if r is None or isinstance(r, str) else json.dumps(r) for r in replies]
                yield part.assign(reply=replies, error=error)

    return run


def _ask_numbered(scorer: BatchScorer, batch_size: int):
    """Send a partition's texts in numbered batches; each row keeps the reply to its batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame, batch_size):
                try:
                    reply, error = scorer(part["feedback"].tolist()), None
                except Exception as problem:
                    reply, error = None, f"API error: {problem}"
                yield part.assign(item_no=range(1, len(part) + 1), reply=reply, error=error)

    return run


def score_numbered(
    texts: DataFrame, lexicon: Lexicon, scorer: BatchScorer, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Results for a table of distinct texts (cache_key, feedback) from array replies.

    What a reply skips is sent once more, alone; what stays without an entry goes to the rules, as
    do the texts of a failed call. Blank texts are not sent. A reply travels with its rows, at most
    ``batch_size`` times, so entries are picked without a join.
    """
    schema = "cache_key string, feedback string, item_no long, reply string, error string"
    small_arrow_batches(texts)
    given = texts.select("cache_key", "feedback")
    blank = strip_spaces(F.coalesce("feedback", F.lit(""))) == ""

    def sent(some: DataFrame, size: int) -> DataFrame:
        """Each row's entry, looked for once; replies are not stored, texts only where there is no entry."""
        found = with_numbered_entry(some.mapInPandas(_ask_numbered(scorer, size), schema))
        left = F.when(F.col("_entry").isNull(), F.col("feedback")).alias("feedback")
        return cut_lineage(found.select("cache_key", left, "_entry", "error"))

    first = sent(given.where(~blank), batch_size)
    settled = F.col("error").isNotNull() | F.col("_entry").isNotNull()
    again = sent(first.where(~settled).select("cache_key", "feedback"), 1)
    nothing = {"_entry": F.lit(None).cast("variant"), "error": F.lit(None).cast("string")}
    entries = first.where(settled).unionByName(again).unionByName(given.where(blank).withColumns(nothing))
    return numbered_results(entries, lexicon).select("cache_key", "result")


def score(
    texts: DataFrame, lexicon: Lexicon, scorer: Scorer, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Results for a table of distinct texts (cache_key, feedback)."""
    schema = "cache_key string, feedback string, reply string, error string"
    small_arrow_batches(texts)
    replies = texts.select("cache_key", "feedback").mapInPandas(_ask(scorer, batch_size), schema)
    return parse_replies(replies, lexicon).select("cache_key", "result")


def first_texts(keyed: DataFrame, unknown: DataFrame, at_once: bool = True) -> DataFrame:
    """(cache_key, feedback) once for each key of ``unknown``, from the key's first row in source order.

    Keys and row numbers are aggregated, texts are not: they are picked up by the numbers of the
    rows that were chosen, which are broadcast if they are few, or cut the rows by Spark's runtime filter. Nothing runs before the result is read unless ``at_once``.
    """
    if ORD not in unknown.columns:
        return unknown.groupBy("cache_key").agg(F.first("feedback").alias("feedback"))
    chosen = unknown.groupBy("cache_key").agg(F.min(ORD).alias(ORD)).select(ORD)
    chosen = broadcast_if_small(cut_lineage(chosen)) if at_once else chosen
    return keyed.select(ORD, "cache_key", "feedback").join(chosen, ORD, "left_semi").drop(ORD)


def enrich(
    df: DataFrame,
    lexicon: Lexicon,
    cache: DataFrame | None = None,
    scorer: Scorer | None = None,
    prompt: str = "",
    batch_scorer: BatchScorer | None = None,
) -> Enriched:
    """Analyse every text of ``df`` that the cache does not know.

    Without a scorer the rules rate each row where it lies. For a scorer the keys of equal texts meet in one
    partial aggregation before the shuffle, so a text that fills a third of the table costs one key
    per task, and only the first row's text is moved. On the way back to the rows Spark's adaptive join splits such texts. The scorer's
    output is written to the checkpoint folder: it is paid for once although it is used twice. Of
    several cached results for one key the smallest counts.
    """
    keyed = df.withColumn("feedback", F.coalesce("feedback", F.lit(""))).withColumn(
        "cache_key", text_key(F.col("feedback"), prompt)
    )
    known = None if cache is None else cache.groupBy("cache_key").agg(F.min("result").alias("result"))
    unknown = keyed if known is None else keyed.join(known, "cache_key", "left_anti")
    by_rules = scorer is None and batch_scorer is None
    pending = first_texts(keyed, unknown, at_once=not by_rules)
    if by_rules:
        fresh = classify_as_result(pending, lexicon).select("cache_key", "result")
        if known is None:
            rows = classify_as_result(keyed, lexicon)
        else:
            rated = keyed.join(known, "cache_key", "left")
            rows = with_fallback(rated, lexicon, F.col("result").isNull(), F.lit(None).cast("string"))
    else:
        fresh = score(pending, lexicon, scorer) if scorer else score_numbered(pending, lexicon, batch_scorer)
        fresh = cut_lineage(fresh)
        results = fresh if known is None else fresh.unionByName(known.select("cache_key", "result"))
        rows = keyed.join(results, "cache_key", "left")
    flat = rows.select(*df.columns, "cache_key", *[F.col(f"result.{n}").alias(n) for n in RESULT_FIELDS])
    return Enriched(flat, fresh.where(F.col("result.analysis_error").isNull()))


def analyze(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rule analysis without cache or scorer: a projection, no shuffle at all."""
    return classify(df, lexicon).withColumn("analysis_error", F.lit(None).cast("string"))


def analysis_failures(df: DataFrame) -> DataFrame:
    """How many rows fell back to the rules, out of how many, and the first reason."""
    failed = F.col("analysis_error").isNotNull()
    return df.agg(
        F.count_if(failed).alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.min_by("analysis_error", F.when(failed, F.col(ORD))).alias("first_error"),
    )
