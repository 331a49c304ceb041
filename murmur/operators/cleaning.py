"""Cleaning steps and the whole chain.

The order of the steps is part of the result: duplicates are dropped before dates are parsed, so
a row with a bad date can shadow a later good one, and locations are compared before they are
title-cased, so case variants survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.ordering import keep_first
from murmur.functions.text import collapse_spaces, is_blank, title_case
from murmur.schema import ORD, ValidationError
from murmur.sources.feedback import validate_columns

TEXT_COLUMNS = ["feedback_id", "location", "feedback"]
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def normalize_whitespace(df: DataFrame) -> DataFrame:
    return df.withColumns({c: collapse_spaces(F.col(c).cast("string")) for c in TEXT_COLUMNS})


def drop_blank_text(df: DataFrame) -> DataFrame:
    """Keep rows with a feedback text; ``nan`` and ``None`` stand for a missing one.

    White space around the text does not matter, so this may come before it is collapsed: as a
    filter close to the scan it then looks at the first letters only.
    """
    return df.where(~is_blank(F.col("feedback").cast("string")))


def fill_location(df: DataFrame) -> DataFrame:
    location = F.col("location")
    known = F.when(~location.isin("nan", ""), location)
    return df.withColumn("location", F.coalesce(known, F.lit("Unspecified")))


def fill_id(df: DataFrame) -> DataFrame:
    """Give all rows without an id the same one, so that only the first of them is kept."""
    return df.withColumn("feedback_id", F.coalesce("feedback_id", F.lit("nan")))


def dedup_by_id(df: DataFrame) -> DataFrame:
    return keep_first(df, ["feedback_id"])


def dedup_by_content(df: DataFrame) -> DataFrame:
    return keep_first(df, ["location", "feedback"])


def title_case_location(df: DataFrame) -> DataFrame:
    return df.withColumn("location", title_case(F.col("location")))


def iso_date(text: Column) -> Column:
    """An ISO date with optional time of day; null for anything else."""
    text = F.trim(text)
    return F.when(text.rlike(_ISO_DATE), text).try_cast("timestamp_ntz")


def read_date(text: Column, formats: list[str] | None = None) -> Column:
    """A date in ISO form or, tried in turn, in one of the given patterns such as ``MM/dd/yyyy``."""
    others = [F.try_to_timestamp(F.trim(text), F.lit(f)).cast("timestamp_ntz") for f in formats or []]
    return F.coalesce(iso_date(text), *others)


def parse_dates(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Rows with a readable date; ``unreadable_dates`` counts the others."""
    if dict(df.dtypes)["date"] == "string":
        df = df.withColumn("date", read_date(F.col("date"), formats))
    return df.where(F.col("date").isNotNull())


def unreadable_dates(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """``(total, unreadable)``: how many rows there are and how many lack a readable date."""
    date = F.col("date")
    date = read_date(date, formats) if dict(df.dtypes)["date"] == "string" else date
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(date.isNull()).alias("unreadable"))


def clean_feedback(
    df: DataFrame, null_ids_are_equal: bool = True, formats: list[str] | None = None
) -> DataFrame:
    """The full chain: white space, blanks, two deduplications, title case, dates.

    Both deduplications run on digests: id, content digest and row order are shuffled twice, the
    texts themselves only once, to pick up the surviving rows by row order. White space is
    collapsed by then, so a line break separates location and text without ambiguity.
    """
    validate_columns(df)
    prepared = fill_location(normalize_whitespace(drop_blank_text(df)))
    if null_ids_are_equal:
        prepared = fill_id(prepared)
    id_key = F.coalesce("feedback_id", F.concat(F.lit("\n"), F.col(ORD).cast("string")))
    content = F.sha2(F.concat_ws("\n", "location", "feedback"), 256)
    keys = prepared.select(ORD, id_key.alias("_id"), content.alias("_content"))
    survivors = keep_first(keep_first(keys, ["_id"]), ["_content"]).select(ORD)
    # Row order is unique, so this is a semi join; unlike one, it is not repeated per union branch.
    kept = prepared.join(survivors, ORD)
    return parse_dates(title_case_location(kept), formats)


def require_rows(df: DataFrame) -> DataFrame:
    """Reject a table that cleaning has emptied."""
    if df.isEmpty():
        raise ValidationError(
            "After cleaning, no valid feedback records remained. "
            "Please check the dataset for missing dates or feedback text."
        )
    return df
