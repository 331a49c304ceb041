"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches, components, dealt_pairs, forest, stored

BLOCK = 1024  # rows of a block of products: 8 MB of cosines
CELL_ROWS = 4096  # vectors of a label that a cell is meant to hold
MAX_CELLS = 1024
SLACK = 1e-9  # against rounding, where a vector is as far from a cell as it may be


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; they are scaled first, so that no square over- or underflows."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Centres of length one; an empty cell keeps its centre."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]]  # at most as many as rows
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def cells_of(rows: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row, and the (row, cell) pairs where it has to be a guest.

    Two vectors with at least that cosine are at most ``reach`` apart. If one is at home in
    cell c, it lies on c's side of the plane between c and any other centre, so the other one
    lies at most ``reach`` beyond that plane. A row is a guest wherever that holds; thus
    each link is seen in the home cell of both its ends.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    near = rows @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T))
    needed = near[np.arange(len(rows)), home][:, None] - reach * apart[home]
    row, cell = np.nonzero(near >= needed - SLACK)
    guest = cell != home[row]
    return home, row[guest], cell[guest]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``(label, vector, h1, h2, least, copies)`` of the vectors that can have links at all."""
    v = F.col("vector")
    usable = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return (
        rows.where(F.coalesce(usable, F.lit(False)))
        .groupBy("label", "h1", "h2").agg(
            F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    )


def _links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """For each run of equal (label, dim, cell, pair): links of home rows, and a forest of them."""

    def compare(batch: pa.Table) -> pa.RecordBatch:
        name = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        ids, copies = name["least"].to_numpy(), name["copies"].to_numpy()
        asks = name["asks"].to_numpy(zero_copy_only=False).astype(bool)
        rows = unit(_matrix(name["vector"].combine_chunks(), name["dim"][0].as_py()))
        order = np.lexsort((~asks, ids))
        ids, copies, asks, rows = ids[order], copies[order], asks[order], rows[order]
        nodes, node = np.unique(ids, return_inverse=True)
        ask, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        links = np.zeros(nodes.size, np.int64)
        label = np.arange(nodes.size)
        for i in range(0, ask.size, BLOCK):
            a = ask[i : i + BLOCK]
            for j in range(0, other.size, BLOCK):
                b = other[j : j + BLOCK]
                x, y = np.nonzero(rows[a] @ rows[b].T >= cosine)
                x, y = a[x], b[y]
                different = node[x] != node[y]
                x, y = x[different], y[different]
                links += np.bincount(node[x], copies[y], nodes.size).astype(np.int64)
                label = forest(nodes.size, node[x], node[y], label)
        linked = np.flatnonzero((links > 0) | (label != np.arange(nodes.size)))
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[linked]), pa.array(links[linked]), pa.array(nodes[label[linked]])], ["least", "links", "root"])

    rest: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if (key := tuple(keys[start])) != open_key and rest:
                yield compare(pa.Table.from_batches(rest))
                rest = []
            open_key = key
            rest.append(batch.slice(start, end - start))
    if rest:
        yield compare(pa.Table.from_batches(rest))


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.98, sample_rows: int = 16_384,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors are compared if their labels are equal and not null and they are of equal length.
    Two are linked if their cosine, in double precision, is at least ``cosine`` (above 0).
    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the
    smallest id reachable; ``kept`` marks the row that stands for its group. Vectors that are
    null, empty or zero, or have null or non-finite components, and rows without a label or id
    link with nothing; a row without an id has no component and is kept. Rows that repeat an id
    are rows of their own in ``n_links``. Empty tables give empty results; other columns are ignored.

    Exact copies meet as one row first. Centres are fitted on about ``sample_rows`` vectors at most
    (of those of the most frequent length, by hash); every vector is then assigned to its cell
    and, as a guest, to all cells where it could have a link, so no link is lost. Large
    cells are cut into chunks that are compared pair by pair in different tasks.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col(embedding)
    kind = F.col(label)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.xxhash64(kind.cast("string")).alias("_l"), kind.alias("_label"),
        v.alias("vector"), F.xxhash64(kind, v).alias("h1"), F.xxhash64(v, kind, F.lit(1)).alias("h2"),
    ).withColumn("label", F.when(F.col("_label").isNotNull(), F.col("_l"))).drop("_l", "_label")
    distinct = stored(distinct_vectors(rows).withColumn("dim", F.size("vector")), "vectors")

    n = distinct.count()
    common = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").head()
    dim = common["dim"] if common else 0
    largest = distinct.groupBy("label").count().agg(F.max("count")).head()[0] or 0
    cells = min(MAX_CELLS, max(1, math.ceil(largest / CELL_ROWS)))
    share = int(min(1.0, 0.9 * sample_rows / max(1, n)) * (1 << 30))
    sample = distinct.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < share))
    rows_ = sample.select("least", "vector").collect() if cells > 1 else []
    taken = [r["vector"] for r in sorted(rows_, key=lambda r: r["least"])]
    centres = spark.sparkContext.broadcast(spherical_kmeans(unit(np.array(taken)), cells) if taken else None)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            cell, row, home = np.zeros(size, np.int64), np.arange(size), np.ones(size, bool)
            dims = batch.column(1).to_numpy()
            if centres.value is not None and (own := np.flatnonzero(dims == dim)).size:
                part = _matrix(batch.column(2).take(pa.array(own)), dim)
                homes, guest, where = cells_of(unit(part), centres.value, cosine)
                cell[own] = homes
                row = np.concatenate([row, own[guest]])
                cell, home = np.concatenate([cell, where]), np.concatenate([home, np.zeros(guest.size, bool)])
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(cell.astype(np.int32)), pa.array(home)], [*batch.schema.names, "cell", "home"])

    vector_type = dict(distinct.dtypes)["vector"]
    placed = distinct.select("label", "dim", "vector", "least", "copies").mapInArrow(
        assign, f"label long, dim int, vector {vector_type}, least long, copies long, cell int, home boolean")
    placed = stored(placed, "cells")
    dealt = dealt_pairs(placed, ["label", "dim", "cell"], F.col("least"), 2 * CELL_ROWS, CELL_ROWS)
    other = F.sequence(F.lit(0), F.col("_chunks") - 1)

    def role(asks: bool):
        first, second = ("_chunk", None) if asks else (None, "_chunk")
        return F.transform(other, lambda c: F.struct(
            ((F.col(first) if first else c).cast("long") * F.col("_chunks") + (F.col(second) if second else c)).alias("pair"),
            F.lit(asks).alias("asks"),
        ))

    none = F.array().cast("array<struct<pair:bigint,asks:boolean>>")
    roles = F.concat(F.when(F.col("home"), role(True)).otherwise(none), role(False))
    tasks = dealt.select("label", "dim", "cell", "vector", "least", "copies", F.explode(roles).alias("r"))
    tasks = tasks.select("label", "dim", "cell", "r.pair", "r.asks", "vector", "least", "copies")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "dim", "cell", "pair"]
    found = stored(
        tasks.repartition(parts, *keys).sortWithinPartitions(*keys)
        .mapInArrow(lambda batches: _links(batches, cosine), "least long, links long, root long"), "vector-links")

    roots = components(found.select(F.col("least").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("least").agg(F.sum("links").alias("links"))
    known = (
        distinct.select("label", "h1", "h2", "least", "copies")
        .join(links, "least", "left").join(roots.withColumnRenamed("node", "least"), "least", "left")
        .select(
            F.col("label").alias("_label"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "least").alias("component"),
        )
    )
    same = (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    own = F.col("vec_id").isNotNull()
    joined = rows.join(known, same & own, "left")
    component = F.when(own, F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
