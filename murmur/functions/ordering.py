"""Deterministic "first", per-group ranks and gap-free numbering that work at any size."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.schema import ORD


def with_ordinal(df: DataFrame, sequence: str | None = None) -> DataFrame:
    """Add the row order of the source as ``_ord``.

    Pass the source's own sequence column when it has one. Without it rows are ordered by file
    path, then by their position in the file, so this must come directly after the read, before
    any shuffle. Within one file the scan's row ids follow the position; which file comes first in
    a scan depends on sizes, so several files are numbered by their sorted paths.
    """
    if sequence is not None:
        return df.withColumn(ORD, F.col(sequence).cast("long"))
    position = F.monotonically_increasing_id()
    paths = sorted(_plain_path(p) for p in df.inputFiles())
    if len(paths) < 2:
        return df.withColumn(ORD, position)
    rows = 63 - len(paths).bit_length() - df.rdd.getNumPartitions().bit_length()
    inside = F.shiftleft(F.shiftright(position, 33), rows).bitwiseOR(position.bitwiseAND(F.lit((1 << 33) - 1)))
    crowded = position.bitwiseAND(F.lit((1 << 33) - 1)) >= F.lit(1 << min(rows, 33))
    files = df.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), "_path string, _file long")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/+", "$1:/")
    numbered = df.withColumns({"_path": path, "_inside": inside, "_crowded": crowded})
    order = F.shiftleft(F.col("_file"), 63 - len(paths).bit_length()).bitwiseOR(F.col("_inside"))
    full = F.raise_error(F.lit("a read task holds too many rows to be numbered; pass a sequence column"))
    # One short row for each file of the listing that the driver holds anyway.
    joined = numbered.join(F.broadcast(files), "_path", "left")
    lost = F.raise_error(F.lit("a file of the scan is not in its listing; pass a sequence column"))
    return joined.withColumn(
        ORD, F.when(F.col("_crowded"), full.cast("long")).when(F.col("_file").isNull(), lost.cast("long")).otherwise(order)
    ).select(*[F.col(f"`{c}`") for c in df.columns], ORD)


def _plain_path(path: str) -> str:
    return re.sub("^([a-z0-9]+):/+", r"\1:/", path)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1.

    The filter on the rank lets Spark cut every group to ``k`` rows per map task before the
    shuffle (WindowGroupLimit), so a key holding a third of the table sends only
    ``k`` rows per task to the reducer.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list[str], order: str = ORD) -> DataFrame:
    """One row per key: the one that comes first in the source."""
    return top_rows(df, keys, [F.col(order)], 1, "_rank").drop("_rank")


def number_rows(df: DataFrame, name: str, order: str = ORD, bits: int = 20) -> DataFrame:
    """Number the rows 1, 2, 3 … by a unique non-negative long, without one global sort.

    The order column is cut into buckets of ``2^bits`` values and those into buckets of
    ``2^(2*bits)``. Counting upwards gives each bucket the number of rows before it, so the
    sorts stay within a bucket: at most ``2^bits`` rows or buckets each, and at most
    ``2^(63 - 2*bits)`` totals on the top level whatever the data looks like.
    """
    low, high = "_low_bucket", "_high_bucket"
    buckets = (
        df.groupBy(F.shiftright(F.col(order), bits).alias(low))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(high, F.shiftright(F.col(low), bits))
    )
    within = Window.partitionBy(high).orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy(high).rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        buckets.groupBy(high).agg(F.sum("_n").alias("_n"))
        .select(high, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before_high"))
    )
    offsets = (
        buckets.withColumn("_before_low", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(tops, high)
        .select(low, (F.col("_before_low") + F.col("_before_high")).alias("_before"))
    )
    position = F.row_number().over(Window.partitionBy(low).orderBy(order))
    return (
        df.withColumn(low, F.shiftright(F.col(order), bits))
        .withColumn("_position", position)
        .join(offsets, low)
        .withColumn(name, F.col("_before") + F.col("_position"))
        .drop(low, "_position", "_before")
    )
