"""The numbers behind the charts; drawing is left to the user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.numbers import percent
from murmur.schema import SEVERITIES


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def _counts(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        return _empty(df, f"{column} string, count long")
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    )


def chart_sentiment(df: DataFrame) -> DataFrame:
    """Count and share of each sentiment; shares are of the rows that have one."""
    counts = _counts(df, "sentiment")
    if "sentiment" not in df.columns:
        return counts.withColumn("share", F.lit(None).cast("double"))
    total = df.agg(F.count("sentiment")).scalar()
    return (
        counts.withColumn("_total", total)
        .select("sentiment", "count", percent(F.col("count"), F.col("_total")).alias("share"))
        .orderBy(F.desc("count"), "sentiment")
    )


def chart_location(df: DataFrame) -> DataFrame:
    return _counts(df, "location").orderBy(F.desc("count"), "location")


def chart_category(df: DataFrame) -> DataFrame:
    return _counts(df, "category").orderBy(F.desc("count"), "category")


def chart_severity(df: DataFrame) -> DataFrame:
    """Counts of all three severities in order, 0 for those that do not occur.

    Zero rows for the domain are added before counting, which needs no join.
    """
    schema = "position int, severity string, count long"
    if "severity" not in df.columns or df.isEmpty():
        return _empty(df, schema)
    domain = df.sparkSession.createDataFrame([(s, 0) for s in SEVERITIES], "severity string, n long")
    seen = df.where(F.col("severity").isin(SEVERITIES)).select("severity", F.lit(1).cast("long").alias("n"))
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")).cast("int")
    return (
        seen.unionByName(domain).groupBy("severity").agg(F.sum("n").alias("count"))
        .select(place.alias("position"), "severity", "count").orderBy("position")
    )


def chart_over_time(df: DataFrame, unit: str = "week") -> DataFrame:
    """Reports per category and period."""
    return (
        df.where(F.col("category").isNotNull() & F.col("date").isNotNull())
        .groupBy(F.date_trunc(unit, "date").cast("timestamp_ntz").alias("period"), "category")
        .agg(F.count(F.lit(1)).alias("count")).orderBy("period", "category")
    )


def chart_keywords(df: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent keywords; accepts lists or comma-separated text."""
    column = F.col("keywords")
    if dict(df.dtypes)["keywords"] == "string":
        column = F.split(column, ", ")
    return (
        df.select(F.explode(column).alias("keyword")).where(F.col("keyword") != "")
        .groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "keyword").limit(top)
    )
