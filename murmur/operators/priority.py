"""Ranking of problem categories by frequency, severity and recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.schema import is_analyzed, severity_weight

# Shares of the three parts of the score, and whole days in microseconds.
FREQUENCY_SHARE, SEVERITY_SHARE, RECENCY_SHARE = 0.4, 0.4, 0.2
MAX_WEIGHT = 3.0
DAY_MICROS = 86_400_000_000
PRIORITY_SCHEMA = "priority_problem string, reports long, severity_label string, priority_score double"


def priority_problems(df: DataFrame) -> DataFrame:
    """One row per category, most pressing first; empty before analysis.

    Rows without a category have no line of their own, but the most recent of them counts when
    the age of the other reports is measured. Age is in whole days of elapsed time.
    """
    if not is_analyzed(df):
        return df.sparkSession.createDataFrame([], PRIORITY_SCHEMA)
    grouped = df.groupBy("category").agg(
        F.count("category").alias("reports"),
        F.sum(severity_weight()).alias("weight"),
        F.max("date").alias("recent"),
    )
    # From here on there is one row per category; the window needs no partitioning.
    everything = Window.partitionBy()
    micros = F.timestamp_diff("MICROSECOND", F.col("recent"), F.col("latest"))
    aged = (
        grouped.withColumn("latest", F.max("recent").over(everything))
        .where(F.col("category").isNotNull())
        .withColumn("age", F.call_function("div", micros, F.lit(DAY_MICROS)))
        .withColumn("most", F.max("reports").over(everything))
        .withColumn("oldest", F.max("age").over(everything))
    )
    span = F.when(F.col("oldest") > 0, F.col("oldest")).otherwise(1)
    frequency = F.col("reports") / F.col("most")
    severity = (F.col("weight") / F.col("reports")) / F.lit(MAX_WEIGHT)
    recency = F.lit(1.0) - F.col("age") / span
    score = (
        frequency * F.lit(FREQUENCY_SHARE) + severity * F.lit(SEVERITY_SHARE)
        + recency * F.lit(RECENCY_SHARE)
    ) * F.lit(100.0)
    label = (
        F.when(F.col("weight") * 2 >= F.col("reports") * 5, "High")
        .when(F.col("weight") * 2 >= F.col("reports") * 3, "Medium")
        .otherwise("Low")
    )
    return aged.select(
        F.col("category").alias("priority_problem"), "reports", label.alias("severity_label"),
        F.round(score, 1).alias("priority_score"),
    ).orderBy(F.desc("priority_score"), "priority_problem")
