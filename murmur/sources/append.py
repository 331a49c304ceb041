"""Append-only ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.ordering import number_rows
from murmur.functions.text import strip_spaces
from murmur.schema import ORD
from murmur.session import cut_lineage


# Numbers beyond this leave no room for new ids in 64 bits.
LARGEST_ID = (1 << 63) - (1 << 40)


def new_rows(existing: DataFrame, incoming: DataFrame, last: int | None = None) -> DataFrame:
    """Incoming rows whose text is not in ``existing`` yet, with ids following its largest one.

    Who knows that largest number passes it as ``last``, and the stored ids are not read.

    Stored texts are compared stripped, incoming ones as they are, and incoming rows are not
    compared with each other. Texts meet as digests, and Spark's adaptive join splits a text that
    fills a large part of the incoming table. An id too large for 64 bits is an error. Which rows are new is decided once and kept as row
    numbers in the checkpoint folder, so the texts are moved only for the final pick.
    """
    if ORD not in incoming.columns:
        raise ValueError(f"incoming rows need their source order in {ORD}")
    digest = F.coalesce(F.sha2(F.col("feedback"), 256), F.lit(""))
    known = (
        existing.select(F.sha2(strip_spaces(F.col("feedback")), 256).alias("_text")).distinct()
    )
    keyed = incoming.select(ORD, digest.alias("_text"))
    fresh = keyed.join(known, "_text", "left_anti")
    numbers = number_rows(cut_lineage(fresh.select(ORD)), "_number")
    number = F.col("_number") + F.lit(last_number(existing) if last is None else last)
    return incoming.join(numbers, ORD).select(
        F.format_string("FB%04d", number).alias("feedback_id"),
        "date", "location", "feedback",
    )


def last_number(existing: DataFrame) -> int:
    """The largest number behind the two letters of an id, compared at its full length; 0 without any."""
    digits = F.regexp_extract("feedback_id", r"^..0*(\d+)$", 1)
    largest = existing.agg(F.max(F.struct(F.length(digits), digits.alias("digits"))).alias("m")).head()["m"]
    number = int(largest["digits"] or 0) if largest else 0
    if number > LARGEST_ID:
        raise ValueError(f"the id number {number} is too large to count on from")
    return number


def append_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` and the new rows together, sorted by date and id."""
    columns = ["feedback_id", "date", "location", "feedback"]
    added = new_rows(existing, incoming)
    return existing.select(*columns).unionByName(added).orderBy("date", "feedback_id")
