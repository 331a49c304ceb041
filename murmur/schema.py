"""Record types, value domains, filter state and errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Required input columns and the value domains of the analysis columns.
REQUIRED_COLUMNS = ["feedback_id", "date", "location", "feedback"]
SENTIMENTS = ["Positive", "Neutral", "Negative", "Mixed"]
CATEGORIES = [
    "Internet", "Hardware", "Software", "Facilities", "Cleanliness", "Food Service",
    "Transportation", "Safety", "Environment", "Academic", "Other",
]
SEVERITIES = ["Low", "Medium", "High"]
SEVERITY_ORDER = ["High", "Medium", "Low"]
COMPLAINT_SENTIMENTS = ["Negative", "Mixed"]
ANALYSIS_COLUMNS = ["category", "sentiment", "severity"]

# Columns of the detail view, in display order.
DETAIL_COLUMNS = [
    "feedback_id", "date", "location", "feedback", "category", "sentiment", "severity",
    "keywords", "summary", "suggested_action",
]

# Row order of the source. Every "first" in the package means smallest ORD.
ORD = "_ord"

CLEAN_SCHEMA = T.StructType([
    T.StructField("feedback_id", T.StringType(), False),
    T.StructField("date", T.TimestampNTZType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("feedback", T.StringType(), False),
])

RESULT_FIELDS = [
    "sentiment", "category", "severity", "keywords", "main_issue", "summary",
    "suggested_action", "analysis_error",
]
RESULT_SCHEMA = T.StructType([
    T.StructField(name, T.ArrayType(T.StringType()) if name == "keywords" else T.StringType())
    for name in RESULT_FIELDS
])


class FeedbackError(Exception):
    """Base of the errors raised by this package."""


class ValidationError(FeedbackError):
    """The input is not a usable feedback table."""


@dataclass(frozen=True)
class FilterSpec:
    """Selected filter values; an empty selection means no restriction."""

    location: list[str] = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    sentiment: list[str] = field(default_factory=list)
    severity: list[str] = field(default_factory=list)
    date_range: tuple[date | datetime, ...] = ()

    def is_active(self, name: str) -> bool:
        return bool(getattr(self, name))


def has_columns(df: DataFrame, names: list[str]) -> bool:
    return set(names) <= set(df.columns)


def is_analyzed(df: DataFrame) -> bool:
    """True once the analysis columns are present; decided from the schema, no job."""
    return has_columns(df, ANALYSIS_COLUMNS)


def severity_weight(column: str | Column = "severity") -> Column:
    """Low 1, Medium 2, High 3; anything else, null included, counts as 1."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value == "High", 3).when(value == "Medium", 2).otherwise(1).cast("long")


def complaints(df: DataFrame) -> DataFrame:
    """Negative and mixed rows; the whole table before analysis."""
    return df.where(F.col("sentiment").isin(COMPLAINT_SENTIMENTS)) if is_analyzed(df) else df
