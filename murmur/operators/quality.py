"""Coverage, label agreement and data-quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.numbers import percent
from murmur.functions.text import strip_spaces
from murmur.operators.summaries import DIMENSIONS
from murmur.schema import CATEGORIES, REQUIRED_COLUMNS, SENTIMENTS, SEVERITIES

MIN_ROWS = 5  # Fixed value: fewer rows than this are flagged.
LABEL_COLUMNS = ["category", "sentiment", "severity"]


def coverage_values(
    df: DataFrame, domains: dict[str, list[str]] | None = None, minimum: int = MIN_ROWS
) -> DataFrame:
    """Rows per value of the four dimensions, 0 for domain values that do not occur.

    Locations are those found in the data. Zero rows for the domain values join the count, so
    there is one aggregation and no join.
    """
    domains = domains or {"category": CATEGORIES, "sentiment": SENTIMENTS, "severity": SEVERITIES}
    zeros = df.sparkSession.createDataFrame(
        [(c, v, 0) for c, values in domains.items() for v in values], "column string, value string, n long"
    )
    listed = [F.col("column") == "location"] + [
        (F.col("column") == c) & F.col("value").isin(values) for c, values in domains.items()
    ]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in DIMENSIONS])
    seen = df.select(F.inline(pairs)).where(F.col("value").isNotNull() & reduce(Column.__or__, listed))
    return (
        seen.withColumn("n", F.lit(1).cast("long")).unionByName(zeros)
        .groupBy("column", "value").agg(F.sum("n").alias("rows"))
        .withColumn("thin", F.col("rows") < minimum)
    )


def coverage_pairs(
    df: DataFrame, intended: DataFrame | None = None,
    categories: list[str] | None = None, minimum: int = MIN_ROWS,
) -> DataFrame:
    """Intended (location, category) pairs with too few rows.

    Only pairs of a location that occurs and a listed category are looked at, so the intended
    pairs are the starting point and no product of the two lists is formed.
    """
    pairs = df.groupBy("location", "category").agg(F.count(F.lit(1)).alias("rows"))
    wanted = (pairs if intended is None else intended).select("location", "category").distinct()
    wanted = wanted.where(F.col("category").isin(categories or CATEGORIES))
    if intended is not None:
        wanted = wanted.join(df.select("location").distinct(), "location", "left_semi")
    return (
        wanted.join(pairs, ["location", "category"], "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
        .where(F.col("rows") < minimum)
    )


def label_agreement(analyzed: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of equal labels per column over the rows that meet by ``feedback_id``.

    Both sides are first counted per id and label combination. An id occurring often on both
    sides then meets as a few weighted combinations, not as all pairs of its rows.
    """
    def counted(df: DataFrame, prefix: str) -> DataFrame:
        labels = [F.col(c).alias(f"{prefix}{c}") for c in LABEL_COLUMNS]
        keys = [f"{prefix}{c}" for c in LABEL_COLUMNS]
        return (
            df.where(F.col("feedback_id").isNotNull()).select("feedback_id", *labels)
            .groupBy("feedback_id", *keys).agg(F.count(F.lit(1)).alias(f"{prefix}n"))
        )

    met = counted(analyzed, "").join(counted(gold, "gold_"), "feedback_id")
    weight = F.col("n") * F.col("gold_n")
    equal = [
        F.sum(F.when(F.col(c) == F.col(f"gold_{c}"), weight).otherwise(0)).alias(f"_{c}")
        for c in LABEL_COLUMNS
    ]
    totals = met.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_rows"), *equal)
    lines = F.array(*[
        F.struct(
            F.lit(c).alias("label"), F.col("_rows").alias("rows"),
            F.coalesce(F.col(f"_{c}"), F.lit(0)).alias("equal"),
        ) for c in LABEL_COLUMNS
    ])
    return totals.select(F.inline(lines)).withColumn("agreement", percent(F.col("equal"), F.col("rows")))


def quality_rules(
    df: DataFrame, locations: list[str], categories: list[str],
    intended: DataFrame | None = None, min_records: int = 500, minimum: int = MIN_ROWS,
) -> DataFrame:
    """Pass or fail of each rule as (rule, ok).

    One pass counts locations, categories and their pairs, one more the records and texts.
    """
    copies = df.select(F.col("location").alias("l"), F.col("category").alias("c"))
    counts = copies.groupingSets([["l"], ["c"]], "l", "c").agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n")
    )
    by_location, by_category = F.col("_set") == 1, F.col("_set") == 2
    some_location = by_location & F.col("l").isin(locations)
    some_category = by_category & F.col("c").isin(categories)
    enough = F.col("n") >= minimum
    groups = counts.agg(
        (F.count_if(some_location) == len(locations)).alias("every_location_present"),
        (F.count_if(some_category) == len(categories)).alias("every_category_present"),
        (F.count_if(some_location & enough) == len(locations)).alias("every_location_sufficient"),
        (F.count_if(some_category & enough) == len(categories)).alias("every_category_sufficient"),
        ((F.count_if(by_location) == len(locations)) & (F.count_if(by_category) == len(categories)))
        .alias("no_other_values"),
    )
    filled = reduce(
        Column.__and__,
        [F.coalesce(strip_spaces(F.col(c).cast("string")) != "", F.lit(False)) for c in REQUIRED_COLUMNS],
    )
    records = df.agg(
        (F.count(F.lit(1)) >= min_records).alias("enough_records"),
        (F.count_distinct(F.sha2("feedback", 256)) == F.count(F.lit(1))).alias("texts_unique"),
        (F.count_if(~filled) == 0).alias("no_blank_fields"),
    )
    thin = coverage_pairs(df, intended, categories, minimum)
    if intended is not None:
        listed = intended.select("location", "category").distinct()
        lost = listed.where(F.col("category").isin(categories)).join(
            df.select("location").distinct(), "location", "left_anti"
        )
        thin = thin.unionByName(lost.withColumn("rows", F.lit(0).cast("long")))
    pairs = thin.agg((F.count(F.lit(1)) == 0).alias("every_intended_pair_sufficient"))

    def lines(one_row: DataFrame) -> DataFrame:
        return one_row.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("rule"), F.col(c).alias("ok")) for c in one_row.columns
        ])))

    return lines(records).unionByName(lines(groups)).unionByName(lines(pairs))
