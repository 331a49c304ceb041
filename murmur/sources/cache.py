"""The table of earlier analysis results.

Results lie in folders by the first two characters of their key, so a job that knows its keys reads
only their folders. Files that cannot be read cost their results, never the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from murmur.schema import RESULT_SCHEMA

CACHE_SCHEMA = T.StructType([
    T.StructField("cache_key", T.StringType()),
    T.StructField("result", RESULT_SCHEMA),
])
PREFIX = "key_prefix"
PREFIX_LETTERS = 2


def _prefix(key: str) -> Column:
    return F.substring(key, 1, PREFIX_LETTERS)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What can be read: files that are cut off or gone are left out."""
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    try:
        partitioned = T.StructType([*CACHE_SCHEMA.fields, T.StructField(PREFIX, T.StringType())])
        return reader.schema(partitioned).parquet(path)
    except AnalysisException:
        return None


def load_cache(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The stored results, or none when there is no readable table.

    With ``keys``, a table with a column ``cache_key``, only folders that may hold one of them
    are read; their prefixes are few, whatever the number of keys.
    """
    stored = _stored(spark, path)
    if stored is None:
        return spark.createDataFrame([], CACHE_SCHEMA)
    if keys is not None:
        wanted = [r[0] for r in keys.select(_prefix("cache_key").alias("p")).distinct().collect()]
        # A table written without folders has no prefix.
        stored = stored.where(F.col(PREFIX).isNull() | F.col(PREFIX).isin(wanted))
    return stored.select("cache_key", "result")


def unreadable_files(spark: SparkSession, path: str) -> int:
    """How many files of the cache give no row, because they are damaged or empty."""
    stored = _stored(spark, path)
    if stored is None:
        return 0
    # The whole row is looked at, so that a file damaged in one column shows.
    read = stored.where(F.xxhash64("cache_key", "result").isNotNull()).select(F.col("_metadata.file_path").alias("f"))
    return len(stored.inputFiles()) - read.distinct().count()


def save_cache(cache: DataFrame, path: str) -> bool:
    """Append new results. A failed write is reported, not raised: the cache only saves work.

    Spark's commit protocol makes an append visible as a whole or not at all.
    """
    try:
        usable = cache.where(F.col("result.analysis_error").isNull()).select("cache_key", "result")
        usable.withColumn(PREFIX, _prefix("cache_key")).write.mode("append").partitionBy(PREFIX).parquet(path)
        return True
    except Exception:
        return False


def compact_cache(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Write one result for each key, the smallest as ``enrich`` takes it, to a new folder.

    Each prefix becomes one file or few; unreadable files are left behind.
    """
    once = load_cache(spark, path).groupBy("cache_key").agg(F.min("result").alias("result"))
    once = once.withColumn(PREFIX, _prefix("cache_key"))
    # AQE may split a prefix that has grown large.
    once.hint("rebalance", PREFIX).write.mode("overwrite").partitionBy(PREFIX).parquet(target)
    return load_cache(spark, target)
