"""Record lines, severity order, relevance and short lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import prefixes, query_words, search_form
from murmur.operators.summaries import basic_location_table, datasets_to_text, label_tables
from murmur.schema import ORD, is_analyzed, severity_weight

# Rows given as context, and the headings above them.
MAX_CONTEXT_ROWS = 150
ANALYZED_HEADING = "feedback_id | date | location | category | sentiment | severity | feedback | action"
PLAIN_HEADING = "feedback_id | date | location | feedback"
NOT_ANALYZED_NOTE = (
    "(AI analysis has not been run yet, so category/sentiment/severity datasets are not available.)"
)


def severity_order(df: DataFrame) -> list[Column]:
    """Most severe first, then source order; source order alone before analysis."""
    return [F.desc("_weight"), F.asc(ORD)] if "_weight" in df.columns else [F.asc(ORD)]


def by_severity(df: DataFrame, limit: int | None = None) -> DataFrame:
    if "severity" not in df.columns:
        ordered = df.orderBy(ORD)
    else:
        ordered = df.orderBy(severity_weight().desc(), F.asc(ORD))
    return ordered if limit is None else ordered.limit(limit)


def high_severity_list(df: DataFrame, limit: int = 6) -> DataFrame:
    return by_severity(df.where(F.col("severity") == "High"), limit)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def record_line(df: DataFrame, with_action: bool = True) -> Column:
    """A record on one line: id, day, place, labels, text, and the action if there is one to take."""
    day = F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("NaT"))
    parts = [_text("feedback_id"), day, _text("location")]
    if "category" in df.columns:
        parts += [_text("category"), _text("sentiment"), _text("severity")]
    line = F.concat_ws(" | ", *parts, _text("feedback"))
    if not with_action or "suggested_action" not in df.columns:
        return line
    action = F.coalesce(F.col("suggested_action"), F.lit(""))
    shown = (action != "") & (F.lower(action) != "no action needed")
    return F.when(shown, F.concat(line, F.lit(" | Action: "), action)).otherwise(line)


def bullet_line(df: DataFrame) -> Column:
    """``- **place** (labels or day): text`` with the summary if there is one."""
    text = F.col("feedback")
    if "summary" in df.columns:
        text = F.coalesce(F.when(F.col("summary") != "", F.col("summary")), text)
    tag = F.date_format("date", "yyyy-MM-dd")
    if "category" in df.columns:
        tag = F.concat(_text("severity"), F.lit(" severity, "), _text("category"))
    return F.concat(
        F.lit("- **"), _text("location"), F.lit("** ("), F.coalesce(tag, F.lit("None")),
        F.lit("): "), F.coalesce(text, F.lit("")),
    )


def more_line(total: Column, limit: int) -> Column:
    """``- ...and N more.`` or null."""
    return F.when(
        total > limit, F.concat(F.lit("- ...and "), (total - limit).cast("string"), F.lit(" more."))
    )


def bullets(df: DataFrame, limit: int = 5) -> DataFrame:
    """The first rows as bullet lines (position, line) and a last line counting the others."""
    first = df.orderBy(ORD).limit(limit)
    ranked = first.withColumn("position", F.expr(f"row_number() over (order by {ORD})").cast("long"))
    more = df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(limit + 1).cast("long").alias("position"), more_line(F.col("total"), limit).alias("line")
    )
    lines = ranked.select("position", bullet_line(df).alias("line"))
    return lines.unionByName(more.where(F.col("line").isNotNull())).orderBy("position")


def relevance_topk(df: DataFrame, question: str, k: int = MAX_CONTEXT_ROWS) -> DataFrame:
    """The ``k`` rows closest to the question with their ``score``, best first.

    A word counts when its first five letters occur in text or place. Severity breaks ties of an
    analyzed table. A table of up to ``k`` rows keeps its order and scores 0.
    """
    # The words of one question are few; Spark folds them to a literal array. The text is named
    # outside the lambda as well, which keeps it from being computed for every word.
    words = prefixes(query_words(F.lit(question)))
    text = F.concat(search_form(F.col("feedback")), F.lit(" "), search_form(F.col("location")))
    found = F.filter(words, lambda w: F.contains(F.col("_search"), w))
    score = F.when(F.octet_length("_search") > 0, F.size(found)).otherwise(0).cast("long")
    if is_analyzed(df):
        score = score * 10 + severity_weight()
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.withColumn("_search", text)
        .withColumn("score", F.when(total > k, score).otherwise(F.lit(0).cast("long")))
        .drop("_search")
        .orderBy(F.desc("score"), F.asc(ORD)).limit(k)
    )


def context_lines(df: DataFrame, question: str, k: int = MAX_CONTEXT_ROWS) -> DataFrame:
    """The context of a question as (part, block_no, block, position, line).

    Part 0 is the note on the records shown and the heading, 2 the records, 3 the summary tables,
    4 the note that there are no more. Sorted by ``part``, ``block_no`` and ``position`` the lines
    read as one text.
    """
    total = df.agg(F.count(F.lit(1)).alias("n"))
    count = F.col("n").cast("string")
    shown = F.when(
        F.col("n") > k,
        F.concat(
            F.lit(f"Showing the {k} most relevant of "), count,
            F.lit(" records (summary datasets cover all "), count, F.lit(")."),
        ),
    ).otherwise(F.concat(F.lit("All "), count, F.lit(" records are listed.")))
    heading = ANALYZED_HEADING if is_analyzed(df) else PLAIN_HEADING

    def block(lines: DataFrame, part: int, name: str) -> DataFrame:
        return lines.select(
            F.lit(part).alias("part"), F.lit(0).alias("block_no"), F.lit(name).alias("block"),
            F.col("position").cast("long").alias("position"), "line",
        )

    opening = total.select(F.posexplode(F.array(
        F.concat(F.lit("### Dataset: Feedback (Full) - "), shown), F.lit(heading)
    )).alias("position", "line"))
    best = relevance_topk(df, question, k)
    records = best.withColumn(
        "position", F.expr(f"row_number() over (order by score desc, {ORD})")
    ).select("position", record_line(df).alias("line"))
    blocks = [block(opening, 0, "records"), block(records, 2, "records")]
    if is_analyzed(df):
        tables = label_tables(df)
    else:
        tables = {"By Location": basic_location_table(df)}
        note = df.limit(1).select(F.lit(0).alias("position"), F.lit(NOT_ANALYZED_NOTE).alias("line"))
        blocks.append(block(note, 4, "note"))
    blocks.append(datasets_to_text(tables).select(
        F.lit(3).alias("part"), F.col("dataset_no").alias("block_no"), F.col("dataset").alias("block"),
        (F.col("part") + F.greatest(F.col("row_no") - 1, F.lit(0))).cast("long").alias("position"), "line",
    ))
    return reduce(DataFrame.unionByName, blocks)
