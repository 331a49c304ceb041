"""Embedding whitening: exact integer moments, leading components by spectrum slicing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches

SCALE, OFFSET = 64, 1_000_000  # an entry c becomes floor(64 c) + 1,000,000
LARGEST = float(2**25)  # entries from here on have no exact place in the moments
MAX_DIM = 2048  # the driver holds a matrix of this many rows and columns, whatever the number of vectors
LIMB = 40  # sums travel as two whole numbers: multiples of 2**40, and the rest
SMALL = 1 << 20  # products of numbers below this add up exactly in a double, for a batch


class Whitening(NamedTuple):
    """What whitens a vector: ``n`` vectors, the sums of their numbers less ``centre`` each, and
    components (as columns) with their eigenvalues and shares of the whole variance."""

    n: int
    centre: np.ndarray
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``.

    By Sylvester's law of inertia that is the number of positive pivots in the LDLᵀ
    factors of the matrix less ``shift`` on its diagonal. Pivots are single entries or 2 x 2
    blocks, chosen so that no factor grows large (Bunch and Kaufman's rule).
    """
    a = matrix - shift * np.eye(len(matrix))
    threshold = (1 + math.sqrt(17)) / 8
    positive = 0
    while (n := len(a)) > 0:
        pair = False
        if n > 1:
            r = int(np.abs(a[1:, 0]).argmax()) + 1
            largest, first = abs(a[r, 0]), abs(a[0, 0])
            if first < threshold * largest:
                others = np.abs(a[r])
                others[r] = 0.0
                if first * others.max() < threshold * largest * largest:
                    pair = abs(a[r, r]) < threshold * others.max()
                    to = 1 if pair else 0
                    a[[to, r]] = a[[r, to]]
                    a[:, [to, r]] = a[:, [r, to]]
        if pair:
            block, side = a[:2, :2], a[2:, :2]
            det, trace = block[0, 0] * block[1, 1] - block[0, 1] ** 2, block[0, 0] + block[1, 1]
            positive += 1 if det < 0 else 2 * int(trace > 0)
            a = a[2:, 2:] - side @ np.linalg.solve(block, side.T)
        else:
            pivot, side = a[0, 0], a[1:, 0]
            positive += int(pivot > 0)
            a = a[1:, 1:] - np.outer(side, side / pivot) if pivot else a[1:, 1:]
    return positive


def leading_components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns.

    Counts of eigenvalues above a shift cut the spectrum until one slice holds the
    wanted eigenvalue alone; Rayleigh quotient iteration then converges from its middle, cubically.
    Where it leaves the slice, the slice is halved again. Counts on both sides of the result
    certify that it is the one with its number. Eigenvalues too close to be told
    apart get an orthonormal basis of what they span. Fewer are returned if fewer
    differ from zero beyond rounding. The largest entry of each vector is positive.
    """
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    unsure = n * np.finfo(float).eps * norm
    counted: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counted:
            counted[shift] = eigenvalues_above(matrix, shift)
        return counted[shift]

    if not norm:
        return np.zeros(0), np.zeros((n, 0))
    rank, top = above(16 * unsure), norm + 2 * unsure
    above(top)
    values: list[float] = []
    found = np.zeros((n, 0))

    def converge(low: float, high: float, slack: float, start: np.ndarray) -> tuple[float, np.ndarray] | None:
        x, rho = start, (low + high) / 2
        for step in range(16):
            try:
                y = np.linalg.solve(matrix - rho * np.eye(n), x)
            except np.linalg.LinAlgError:
                rho += unsure / n
                continue
            x = y / np.abs(y).max()
            for _ in range(2):
                x = x - found @ (found.T @ x)
            x /= np.sqrt(x @ x)
            if step < 2:  # the middle of the slice stays the shift until x leans to the wanted vector
                continue
            rho = float(x @ matrix @ x)
            if not low - slack <= rho <= high + slack:
                return None
            if np.sqrt(np.square(matrix @ x - rho * x).sum()) <= 2 * unsure:
                return rho, x
        return None

    for k in range(1, min(most, rank) + 1):
        start = np.random.default_rng(k).standard_normal(n)
        while True:
            low = max(s for s, c in counted.items() if c >= k)
            high = min(s for s, c in counted.items() if c < k)
            alone = counted[low] == k and counted[high] == k - 1
            narrow = high - low <= 2 * unsure
            result = converge(low, high, 2 * unsure if narrow else 0.0, start) if alone or narrow else None
            if result is not None:
                value, x = result
                if above(value + 8 * unsure) < k <= above(value - 8 * unsure):
                    break
            if narrow:
                raise ArithmeticError(f"eigenvalue {k} was not found, or its number not certified")
            above((low + high) / 2)
        values.append(value)
        found = np.column_stack([found, x * np.sign(x[np.abs(x).argmax()])])
    return np.array(values), found


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector has only entries that are numbers below LARGEST in size (and ``dim`` of them)."""
    entries = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < LARGEST) & ~F.isnan(x))
    length = F.size(vector) > 0 if dim is None else F.size(vector) == dim
    return F.coalesce(vector.isNotNull() & length & entries, F.lit(False))


def whole_numbers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(64 c) of each entry, a row for each vector."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * entries).astype(np.int64).reshape(-1, dim)


def products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of products of columns, exactly, as multiples of 2**40 and rest."""
    def gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)

    mask = (1 << LIMB) - 1
    if np.abs(y).max(initial=0) < SMALL:
        sums = gram(y, y)
        return sums >> LIMB, sums & mask
    upper, lower = y >> 16, y & 0xFFFF
    high, cross, low = gram(upper, upper), gram(upper, lower), gram(lower, lower)
    rest = ((high & 255) << 32) + ((cross + cross.T) << 16) + low
    return (high >> 8) + (rest >> LIMB), rest & mask


def _added(rows: DataFrame, work: Callable, *sums: str) -> dict[tuple[int, int], list]:
    """Sum up the ``(i, j, ...)`` rows that ``work`` gives once for each partition."""
    schema = "i int, j int, " + ", ".join(f"{s} {'double' if s == 'value' else 'long'}" for s in sums)
    total = rows.mapInArrow(work, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    return {(r[0], r[1]): list(r[2:]) for r in total.collect()}  # at most dim * (dim + 1) / 2 rows


def _entries(i: np.ndarray, j: np.ndarray, **sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, sums.values())], ["i", "j", *sums])


def fit(rows: DataFrame, dim: int, most: int = 32) -> Whitening:
    """Components of the column ``vector`` of ``rows``, all of which are usable and ``dim`` long.

    Two passes: whole sums first, then products of the numbers less the nearest whole number to
    their mean. Both are exact whatever the order of rows, and so is the covariance made of
    them, rounded once for each entry.
    """
    mask = (1 << LIMB) - 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim + 1, np.int64), np.zeros(dim + 1, np.int64)
        for batch in batches:
            x = whole_numbers(batch.column(0), dim)
            sums = np.append(x.sum(axis=0), len(x))
            high, low, n = high + (sums >> LIMB), low + (sums & mask), n + len(x)
        if n:
            places = np.arange(dim + 1)
            yield _entries(places, places, high=high + (low >> LIMB), low=low & mask)

    def total(pair: list[int]) -> int:
        return (pair[0] << LIMB) + pair[1]

    vectors = rows.select("vector")
    sums = _added(vectors, add_up, "high", "low")
    n = total(sums[dim, dim]) if sums else 0
    if not n:
        return Whitening(0, np.zeros(dim, np.int64), [0] * dim, np.zeros((dim, 0)), np.zeros(0), np.zeros(0))
    first = [total(sums[i, i]) for i in range(dim)]
    centre = [(2 * s + n) // (2 * n) for s in first]
    middle = rows.sparkSession.sparkContext.broadcast(np.array(centre, np.int64))
    i, j = np.triu_indices(dim)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(i.size, np.int64), np.zeros(i.size, np.int64)
        for batch in batches:
            h, rest = products(whole_numbers(batch.column(0), dim) - middle.value)
            high, low, n = high + h[i, j], low + rest[i, j], n + batch.num_rows
        if n:
            yield _entries(i, j, high=high + (low >> LIMB), low=low & mask)

    second = {place: total(pair) for place, pair in _added(vectors, multiply, "high", "low").items()}
    left = [s - n * c for s, c in zip(first, centre, strict=True)]
    covariance = np.zeros((dim, dim))
    for (a, b), value in second.items():
        covariance[a, b] = covariance[b, a] = (n * value - left[a] * left[b]) / (n * n)
    values, components = leading_components(covariance, most)
    return Whitening(n, middle.value, left, components, values, values / max(np.trace(covariance), np.finfo(float).tiny))


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    mean = np.array([s / model.n for s in model.sums])
    return (x - model.centre - mean) @ (model.vectors / np.sqrt(model.values))


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The exact sum of (n x - S)**2 for each row; none where it exceeds a long."""
    y = x - model.centre
    size = model.n * (int(np.abs(y).max(initial=0)) + 1)
    if size * size * max(1, y.shape[1]) < 1 << 63:
        apart = model.n * y - np.array(model.sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = model.n * y.astype(object) - np.array(model.sums, object)
    return [v if v < 1 << 63 else None for v in (apart * apart).sum(axis=1).tolist()]


def whiten(
    vectors: DataFrame, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` by vector and component.

    Entries become whole numbers x = floor(64 c) + 1,000,000. With the n vectors' sums S
    and covariance V (divisor n), ``whitened`` is x - S/n projected on the unit eigenvector of
    V with the ``component``-th largest eigenvalue, divided by its root; ``explained`` is that
    eigenvalue's share of V's trace; ``deviation`` is the exact sum over dimensions of
    (n x - S) ** 2, null where that exceeds a long; ``identity_error`` is the largest absolute
    entry of the whitened numbers' covariance minus the identity, measured over all rows.

    Vectors that are null or empty or hold null or non-finite entries have no rows, nor have those
    with entries of 2**25 or more, which no exact sum could hold, and those not of the most
    frequent length (the smaller of two). Components stop where eigenvalues are zero up to
    rounding, so equal vectors, a single one, or an empty table give no rows. Equal vectors
    count as often as they occur; ids keep their type and may be null or repeat; other columns are ignored.
    More than 2,048 dimensions are a ValueError, as the covariance is solved on the driver.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    every = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    common = (
        every.where(usable(F.col("vector"))).groupBy(F.size("vector").alias("dim")).count()
        .orderBy(F.desc("count"), "dim").head()
    )
    dim = common["dim"] if common else 1
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} dimensions; at most {MAX_DIM} can be solved")
    rows = every.where(usable(F.col("vector"), dim))
    model = fit(rows, dim, components)
    shared = spark.sparkContext.broadcast(model)  # dim x components
    found = model.values.size
    i, j = np.triu_indices(found)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, means, both = 0, np.zeros(found), np.zeros((found, found))
        for batch in batches:
            w = _projected(whole_numbers(batch.column(0), dim), shared.value)
            n, means, both = n + len(w), means + w.sum(axis=0), both + w.T @ w
        if n:
            places = np.arange(found)
            yield _entries(np.append(places, i), np.append(np.full(found, -1), j), value=np.append(means, both[i, j]))

    error = 0.0
    if found:
        # The numbers are centred before they are projected, so their means are rounding errors.
        sums = {place: value / model.n for place, (value,) in _added(rows.select("vector"), spread, "value").items()}
        error = max(abs(v - sums[a, -1] * sums[b, -1] - (a == b)) for (a, b), v in sums.items() if b >= 0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column(1), dim)
            size = len(x)
            each = pa.array(np.repeat(np.arange(size), found))
            deviation = pa.array(deviations(x, shared.value) if found else [None] * size, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), size)),
                pa.array(np.full(size * found, model.n)), deviation.take(each),
                pa.array(_projected(x, shared.value).reshape(-1)), pa.array(np.tile(model.explained, size)),
                pa.array(np.full(size * found, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(
        write, f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double")
