"""Periodic runs of words, found online on sparse diagonals, and texts with the repeats taken out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches

WIDEN = 4  # lags of one level reach from a shingle's length to this many times of it


def shingle_names(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each stretch of ``size`` words, equal exactly where the stretches are.

    Names of two halves make the name of a whole, so nothing is hashed.
    """
    names, length = ids, 1
    while length < size and names.size:
        step = min(length, size - length)
        if names.size <= step:
            return names[:0]
        pairs = names[:-step] * (names.max() + 1) + names[step:]
        names, length = np.unique(pairs, return_inverse=True)[1], length + step
    return names


def repeating(ids: np.ndarray, doc: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Which documents of a batch hold some stretch of ``size`` words twice; the others have no run."""
    names = shingle_names(ids, size)
    inside = doc[: names.size] == doc[ids.size - names.size :]
    keys = np.sort((doc[: names.size] * (names.max(initial=0) + 1) + names)[inside])
    found = np.zeros(docs, bool)
    found[keys[1:][keys[1:] == keys[:-1]] // (names.max(initial=0) + 1)] = True
    return found


def _earlier(names: np.ndarray) -> np.ndarray:
    """For each position the last earlier one of the same name, else -1."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    earlier = np.full(names.size, -1, np.int64)
    earlier[order[1:][same]] = order[:-1][same]
    return earlier


def _divided(q: int) -> Iterator[int]:
    """q divided by each of its prime factors."""
    rest, prime = q, 2
    while prime * prime <= rest:
        if rest % prime == 0:
            yield q // prime
            while rest % prime == 0:
                rest //= prime
        prime += 1
    if rest > 1:
        yield q // rest


def find_runs(ids: np.ndarray, min_words: int = 12) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period.

    A run is a stretch whose words at distance ``period`` are the same, with no smaller such distance,
    of at least ``min_words`` words and two periods, that no neighbour extends.

    The scan goes through a text once for each level of lags. Each earlier occurrence of a word
    adds one to the match length of its lag; a lag that finds no match any more has its
    diagonal ended, and if that was long enough its run is emitted at once. A run of
    period q matches q words on its diagonal and min_words - q at least, so words are looked up
    as shingles: of half of ``min_words`` for small lags, of the level's smallest lag for
    larger ones, with lags below four times that in a level. Such shingles seldom recur within
    the level's reach unless they are part of a run, and within a run of period q the lags 2q,
    3q, ... are passed over: their diagonals end with the run and have no smallest period.
    """
    runs = set()
    size = max(1, -(-min_words // 2))
    least = 1
    while 2 * least <= ids.size and size < ids.size:
        names = shingle_names(ids, size)
        earlier = _earlier(names)
        reach = WIDEN * size
        places = np.flatnonzero((earlier >= 0) & (np.arange(names.size) - earlier < reach))
        if not places.size and not (earlier >= 0).any():
            break  # no longer stretch occurs twice either
        runs.update(_scan(ids, places.tolist(), earlier, size, least, reach, min_words))
        size = least = reach
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _scan(ids, places, earlier, size, least, reach, min_words) -> Iterator[tuple[int, int, int]]:
    before = earlier.tolist()
    onward: dict[int, int] = {}  # the occurrence to go on with after a place's nearest one
    active: dict[int, int] = {}
    last = -2

    def ended(lags: dict[int, int], stop: int) -> Iterator[tuple[int, int, int]]:
        for q, matches in lags.items():
            words = matches + size - 1
            if q >= least and words >= max(min_words - q, q):
                start = stop - matches - q
                block = ids[start : start + q]
                if all((block[d:] != block[:-d]).any() for d in _divided(q)):
                    yield start, words + q, q

    for i in places:
        if i != last + 1:
            yield from ended(active, last + 1)
            active = {}
        grown = {}
        j = before[i]
        q = i - j
        grown[q] = matches = active.get(q, 0) + 1
        start = i - matches + 1 - q  # where the stretch of period q begins
        following = before[j]
        if following == j - q and following >= start:
            following = onward.get(j, following)
        onward[i] = following
        while following >= 0 and (lag := i - following) < reach:
            grown[lag] = active.get(lag, 0) + 1
            following = before[following]
        if len(grown) < len(active) or grown.keys() != active.keys():
            yield from ended({q: n for q, n in active.items() if q not in grown}, i)
        active, last = grown, i
    yield from ended(active, last + 1)


def repeats(runs: list[tuple[int, int, int]], words: int) -> np.ndarray:
    """Which words some run holds after its first period."""
    edge = np.zeros(words + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, min_words: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start,length,period>>, collapsed)`` of every whole text.

    Words are runs without ASCII white space, numbered from 0. ``runs`` has all runs of at least
    ``min_words`` words and two periods by start, then period (see ``find_runs``). ``collapsed``
    joins with one space the words that no run holds after its first period.

    Null and blank texts have no words, no runs and an empty collapsed text. Texts may be of any
    length; ids may be null and keep their type; rows may repeat, each has a row of its own;
    an empty table gives an empty one; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            number = defaultdict(count().__next__)
            ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
            number.clear()
            doc = np.repeat(np.arange(sizes.size), sizes)
            asked = repeating(ids, doc, sizes.size, -(-min_words // 2))
            ends = np.cumsum(sizes)
            runs, collapsed = [], []
            for i, words in enumerate(texts):
                found = find_runs(ids[ends[i] - sizes[i] : ends[i]], min_words) if asked[i] else []
                if found:
                    gone = repeats(found, len(words)).tolist()
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                collapsed.append(b" ".join(words))
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        work, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
