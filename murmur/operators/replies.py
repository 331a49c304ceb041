"""Turning raw scorer replies into checked analysis results.

Replies are parsed as variants, because results differ between a missing entry and a null one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.ordering import top_rows
from murmur.functions.text import strip_spaces
from murmur.operators.classify import NO_ACTION, NO_ISSUE, classify
from murmur.operators.lexicon import FALLBACK_CATEGORY, Lexicon
from murmur.schema import CATEGORIES, RESULT_FIELDS, SENTIMENTS, SEVERITIES

# Reasons recorded when the rule classifier had to step in.
EMPTY_TEXT = "Empty feedback text."
NOT_JSON = "AI returned an invalid (non-JSON) response."
SKIPPED = "The reply holds no usable entry for this text."


def clean_reply(reply: Column) -> Column:
    """Without reasoning blocks, code fences and outer white space."""
    spoken = strip_spaces(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))
    return strip_spaces(F.regexp_replace(spoken, r"(?dm)^```(?:json)?|```$", ""))


def _parse(text: Column) -> Column:
    """The text as one JSON value; null when it is none or has anything after it.

    Spark ignores what follows a complete value. Text that ends a wrapping object early cannot be
    the only item of a wrapping array as well, so passing both means there is nothing left over.
    """
    single = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(single, F.try_variant_get(wrapped, "$.v", "variant"))


def extract_object(reply: Column) -> Column:
    """The JSON object between the first ``{`` and the last ``}``; null when there is none."""
    return _parse(F.regexp_extract(clean_reply(reply), r"(?s)\{.*\}", 0))


def extract_array(reply: Column) -> Column:
    """The JSON array between the first ``[`` and the last ``]``; null when there is none."""
    return _parse(F.regexp_extract(clean_reply(reply), r"(?s)\[.*\]", 0))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _spoken(value: Column) -> Column:
    """A JSON scalar as text: null reads ``None``, true reads ``True``."""
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(F.is_variant_null(value), "None")
        .when(_kind(value) == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def _field(entry: Column, name: str, missing: str, blank: str) -> Column:
    value = F.try_variant_get(entry, f"$.{name}", "variant")
    text = F.when(_kind(value) == "MISSING", missing).otherwise(strip_spaces(_spoken(value)))
    return F.when(text == "", blank).otherwise(text)


def _choice(entry: Column, name: str, allowed: list[str], default: str) -> Column:
    value = F.try_variant_get(entry, f"$.{name}", "string")
    return F.when(value.isin(allowed), value).otherwise(default)


def is_object(entry: Column) -> Column:
    return F.startswith(_kind(entry), F.lit("OBJECT"))


def sanitize(entry: Column) -> Column:
    """A result struct with only allowed values; null when the entry is not a JSON object."""
    return F.when(is_object(entry), _allowed(entry))


def sanitized(df: DataFrame) -> DataFrame:
    """The rows whose ``reply`` holds a JSON object, with the checked ``result``.

    The object is a column of its own before its fields are taken. As one expression it would be parsed
    again for every mention.
    """
    parsed = df.withColumn("_entry", extract_object(F.col("reply"))).where(is_object(F.col("_entry")))
    return parsed.withColumn("result", _allowed(F.col("_entry"))).drop("_entry")


def _allowed(entry: Column) -> Column:
    listed = F.try_variant_get(entry, "$.keywords", "array<variant>")
    words = F.transform(listed, lambda k: strip_spaces(F.coalesce(_spoken(k), F.lit("None"))))
    return F.struct(
        _choice(entry, "sentiment", SENTIMENTS, "Neutral").alias("sentiment"),
        _choice(entry, "category", CATEGORIES, FALLBACK_CATEGORY).alias("category"),
        _choice(entry, "severity", SEVERITIES, "Low").alias("severity"),
        F.coalesce(F.filter(words, lambda k: k != ""), F.array().cast("array<string>")).alias("keywords"),
        _field(entry, "main_issue", NO_ISSUE, NO_ISSUE).alias("main_issue"),
        _field(entry, "summary", "", "").alias("summary"),
        _field(entry, "suggested_action", NO_ACTION, NO_ACTION).alias("suggested_action"),
        F.lit(None).cast("string").alias("analysis_error"),
    )


def with_fallback(df: DataFrame, lexicon: Lexicon, missing: Column, reason: Column) -> DataFrame:
    """Replace the ``result`` of ``missing`` rows by the rule classifier's and the reason for it.

    The classifier sees no text where there is a result, so only the failed rows cost anything.
    """
    given = F.col("result")
    failed = df.withColumns({
        "_missing": missing, "_reason": F.when(missing, reason),
        "_text_to_rate": F.when(missing, F.col("feedback")),
    })
    ruled = classify(failed, lexicon, "_text_to_rate")
    names = [n for n in RESULT_FIELDS if n != "analysis_error"]
    fields = [
        F.when(F.col("_missing"), F.col(n)).otherwise(given.getField(n)).alias(n) for n in names
    ]
    return ruled.withColumn("result", F.struct(
        *fields, F.coalesce("_reason", given.getField("analysis_error")).alias("analysis_error")
    )).drop(
        *names, "_missing", "_reason", "_text_to_rate"
    )


def parse_replies(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One reply per text: ``feedback``, ``reply`` and optionally ``error`` give ``result``.

    ``error`` holds the reason when no reply arrived at all. Blank texts need no reply.
    """
    blank = F.coalesce(strip_spaces(F.col("feedback")) == "", F.lit(True))
    failed = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    reason = F.when(blank, EMPTY_TEXT).otherwise(F.coalesce(failed, F.lit(NOT_JSON)))
    usable = ~blank & F.col("reply").isNotNull() & failed.isNull()
    parsed = df.withColumn("_entry", F.when(usable, extract_object(F.col("reply"))))
    entry = F.col("_entry")
    checked = parsed.withColumns({"result": _allowed(entry), "_usable": is_object(entry)})
    return with_fallback(checked, lexicon, ~F.col("_usable"), reason).drop("_entry", "_usable")


def _entry_number(entry: Column) -> Column:
    """The 1-based ``id`` of an entry: whole numbers, also as text; other numbers are cut off."""
    value = F.try_variant_get(entry, "$.id", "variant")
    text = F.try_variant_get(value, "$", "string")
    whole = F.when(strip_spaces(text).rlike(r"\A[+-]?[0-9]+\z"), strip_spaces(text)).try_cast("long")
    cut = F.try_variant_get(value, "$", "double").try_cast("long")
    kind = _kind(value)
    return (
        F.when(kind == "STRING", whole)
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long"))
        .when(kind.isin("MISSING", "VOID"), F.lit(None).cast("long"))
        .otherwise(cut)
    )


def numbered_entry(reply: Column, number: Column) -> Column:
    """The first JSON object of an array reply that names the 1-based ``number``; null without one."""
    listed = F.try_variant_get(extract_array(reply), "$", "array<variant>")
    return F.try_element_at(F.filter(listed, lambda e: is_object(e) & (_entry_number(e) == number)), F.lit(1))


def with_numbered_entry(df: DataFrame) -> DataFrame:
    """Add ``_entry``, what the row's ``reply`` says of its ``item_no``."""
    return df.withColumn("_entry", numbered_entry(F.col("reply"), F.col("item_no")))


def numbered_results(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``feedback``, ``_entry`` and ``error`` give ``result``; the text is looked at only without an entry."""
    blank = strip_spaces(F.coalesce("feedback", F.lit(""))) == ""
    reason = F.when(blank, EMPTY_TEXT).otherwise(F.coalesce("error", F.lit(SKIPPED)))
    checked = df.withColumn("result", sanitize(F.col("_entry")))
    return with_fallback(checked, lexicon, F.col("result").isNull(), reason).drop("_entry")


def parse_numbered(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``feedback``, ``item_no``, ``reply`` and ``error`` give ``result``, row by row."""
    return numbered_results(with_numbered_entry(df), lexicon)


def parse_batch_replies(requests: DataFrame, replies: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Match the entries of array replies to the numbered texts that were sent.

    ``requests`` has ``batch_id``, ``item_no`` and ``feedback``, ``replies`` one ``reply`` per
    batch. Entries that are no objects or name no requested number are dropped, of several for
    one number the first counts, texts left over go to the rule classifier.
    """
    listed = F.try_variant_get(extract_array(F.col("reply")), "$", "array<variant>")
    entries = (
        replies.select("batch_id", F.posexplode(listed).alias("_position", "_entry"))
        .withColumn("item_no", _entry_number(F.col("_entry")))
        .where(is_object(F.col("_entry")) & F.col("item_no").isNotNull())
        .select("batch_id", "item_no", "_position", "_entry")
    )
    first = top_rows(entries, ["batch_id", "item_no"], [F.col("_position")], 1, "_rank")
    matched = requests.join(
        first.select("batch_id", "item_no", _allowed(F.col("_entry")).alias("result"), F.lit(True).alias("_found")),
        ["batch_id", "item_no"], "left",
    )
    blank = strip_spaces(F.coalesce("feedback", F.lit(""))) == ""
    reason = F.when(blank, EMPTY_TEXT).otherwise(SKIPPED)
    return with_fallback(matched, lexicon, F.col("_found").isNull(), reason).drop("_found")
