"""What several operators share: stored tables, held-out rows, dealing of hot cells, components."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are long, so Arrow batches hold few rows: 256 texts of 100 KB are 25 MB in a worker.
BATCH_ROWS = 256
ROOT = str(Path(__file__).resolve().parents[2])


def bounded_batches(spark: SparkSession) -> None:
    """Prepare Python workers: few rows in an Arrow batch, and this package on their path.

    Spark's own 10,000 rows do not suit whole texts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset, as in tests, a folder below the warehouse is taken, which a
    cluster shares as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm"
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    A Parquet table instead of a checkpoint, since later steps read single columns of it. Task
    commits make each part appear once, so values that depend on the task that wrote them
    (numbers within a part) stay fixed even if executors are lost afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that a column of ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column, parts: int) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def dealt_pairs(df: DataFrame, cell: list[str], spread: Column, limit: int, chunk: int) -> DataFrame:
    """Add ``_chunk`` and ``_chunks``: into how many chunks a row's cell is cut, and the row's own.

    A cell of at most ``limit`` rows stays whole. A larger one is cut into chunks of about
    ``chunk`` rows by the hash of ``spread``; pairs of chunks are then compared by different
    tasks, so no task holds a hot cell and no pair of rows is lost.
    """
    hot = (
        df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
        .select(*cell, F.ceil(F.col("_rows") / chunk).cast("int").alias("_chunks"))
    )
    chunks = F.coalesce(F.col("_chunks"), F.lit(1))
    return (
        df.join(hot, cell, "left")
        .withColumn("_chunks", chunks)
        .withColumn("_chunk", F.pmod(F.xxhash64(spread), F.col("_chunks")).cast("int"))
    )


def forest(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0 to n-1 the smallest node each is linked with, directly or through others."""
    label = np.arange(n) if label is None else label
    while left.size:
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        while not np.array_equal(deeper := label[label], label):
            label = deeper
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def _state(edges: DataFrame) -> tuple:
    # Addition of hashes wraps around on purpose: it is a checksum that no row order changes.
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.bit_xor(F.xxhash64("b", F.lit(1), "a")).alias("y"),
    ).head()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``: one row ``(node, root)`` per linked node.

    The root is the smallest node of the component; a node without links, null ends and links
    of a node with itself give no row. Large-star and small-star steps alternate until nothing
    changes (a logarithmic number of rounds in practice), each written to the shared folder.
    Neighbourhoods are never gathered: a step takes the least neighbour of each node, which is
    aggregated before the shuffle, and joins it back, where Spark splits the rows of a hub.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct(), "links",
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        large = (
            both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        )
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = (
            large.join(least, "a").where("b <> _m")
            .select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .unionByName(least.select("a", F.col("_m").alias("b")))
            .distinct()
        )
        edges = stored(small, "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
