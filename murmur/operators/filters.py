"""Selections, their relaxation when nothing matches, and text search."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.schema import CATEGORIES, DETAIL_COLUMNS, SENTIMENTS, SEVERITIES, FilterSpec

SELECTIONS = ["location", "category", "sentiment", "severity"]

# Filters are given up in this order, least important first, under these names.
RELAX_ORDER = ["severity", "sentiment", "category", "date_range", "location"]
LABELS = {
    "severity": "Severity", "sentiment": "Sentiment", "category": "Category",
    "date_range": "Date range", "location": "Location",
}
HIGH_BUT_NOT_NEGATIVE_HINT = (
    "Positive or neutral feedback is almost never High severity (High means a serious problem)."
)


def predicates(df: DataFrame, spec: FilterSpec) -> dict[str, Column]:
    """One condition per filter that has an effect on ``df``, in a form the scan understands."""
    found = {}
    for name in SELECTIONS:
        if spec.is_active(name) and name in df.columns:
            found[name] = F.col(name).isin(list(getattr(spec, name)))
    if len(spec.date_range) == 2 and "date" in df.columns:
        start, end = (F.lit(day).cast("timestamp_ntz") for day in spec.date_range)
        found["date_range"] = (F.col("date") >= start) & (F.col("date") <= end)
    return found


def filter_multiselect(df: DataFrame, column: str, selected: list[str]) -> DataFrame:
    """Rows whose value is selected; nothing selected or no such column means all rows."""
    return df.where(F.col(column).isin(list(selected))) if selected and column in df.columns else df


def filter_date_range(df: DataFrame, start, end) -> DataFrame:
    """Both ends inclusive at midnight: later hours of the last day are outside."""
    return apply_filters(df, FilterSpec(date_range=(start, end)))


def apply_filters(df: DataFrame, spec: FilterSpec, skip: tuple[str, ...] = ()) -> DataFrame:
    conditions = [c for name, c in predicates(df, spec).items() if name not in skip]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def _drop_sets(active: list[str]) -> list[tuple[str, ...]]:
    """Every set of filters to give up, in the order in which they are tried."""
    return [c for size in range(len(active) + 1) for c in combinations(active, size)]


def filter_with_relaxation(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """The matching rows, or those of the smallest relaxation that has any.

    ``ignored_filters`` names the filters given up. The smallest set that lets a row through is
    the set of filters it fails, so one pass finds the answer: number the sets in trying order
    and take the minimum over all rows. When every filter has to go, all rows are returned.
    """
    conditions = predicates(df, spec)
    active = [name for name in RELAX_ORDER if spec.is_active(name)]
    tried = _drop_sets(active)

    def mask(names: tuple[str, ...]) -> int:
        return sum(1 << active.index(n) for n in names)

    rank_of_mask = {mask(names): rank for rank, names in enumerate(tried)}
    failed = reduce(
        lambda a, b: a + b,
        [
            F.when(conditions[n], 0).otherwise(1 << i) if n in conditions else F.lit(0)
            for i, n in enumerate(active)
        ],
        F.lit(0),
    )
    ranks = F.array(*[F.lit(rank_of_mask[m]) for m in range(len(tried))])
    best = df.agg(F.min(F.get(ranks, failed))).scalar()
    masks = F.array(*[F.lit(mask(names)) for names in tried])
    labels = F.array(*[F.lit(", ".join(LABELS[n] for n in names)) for names in tried])
    still_on = F.bitwise_not(F.get(masks, best))
    return df.where(failed.bitwiseAND(still_on) == 0).withColumn(
        "ignored_filters", F.get(labels, best)
    )


def explain_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """How many rows each selection matches on its own: (filter_name, selected, records)."""
    conditions = {n: c for n, c in predicates(df, spec).items() if n in SELECTIONS}
    if not conditions:
        return df.sparkSession.createDataFrame([], "filter_name string, selected string, records long")
    counts = df.agg(*[F.count_if(c).alias(f"_{n}") for n, c in conditions.items()])
    lines = F.array(*[
        F.struct(
            F.lit(LABELS[n]).alias("filter_name"),
            F.lit(", ".join(getattr(spec, n))).alias("selected"),
            F.col(f"_{n}").alias("records"),
        )
        for n in conditions
    ])
    return counts.select(F.inline(lines))


def filter_hint(spec: FilterSpec) -> str:
    """Advice for a combination that hardly ever occurs, else an empty text."""
    calm = spec.sentiment and set(spec.sentiment) <= {"Positive", "Neutral"}
    return HIGH_BUT_NOT_NEGATIVE_HINT if calm and set(spec.severity) == {"High"} else ""


def search_text(df: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive regular expression search; a missing text never matches.

    Patterns within the common subset of Java and RE2 syntax mean the same everywhere.
    """
    return df.where(F.col("feedback").rlike(f"(?i){pattern}")) if pattern else df


def feedback_details(df: DataFrame) -> DataFrame:
    """The columns of the detail view, as far as they exist."""
    return df.select(*[c for c in DETAIL_COLUMNS if c in df.columns])


def filter_domains(df: DataFrame) -> DataFrame:
    """Values on offer in each filter: (filter_name, value), locations sorted, dates as min and max."""
    spark = df.sparkSession
    fixed = [("category", v) for v in CATEGORIES] + [("sentiment", v) for v in SENTIMENTS]
    fixed += [("severity", v) for v in SEVERITIES]
    locations = df.where(F.col("location").isNotNull()).select("location").distinct()
    bounds = df.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    days = bounds.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("filter_name"), F.date_format(c, "yyyy-MM-dd").alias("value"))
        for c in bounds.columns
    ])))
    return (
        locations.select(F.lit("location").alias("filter_name"), F.col("location").alias("value"))
        .unionByName(spark.createDataFrame(fixed, "filter_name string, value string"))
        .unionByName(days.where(F.col("value").isNotNull()))
        .orderBy("filter_name", "value")
    )
