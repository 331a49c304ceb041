"""Training-order materialisation: every sequence gets a slot by a keyed permutation.

A shard is a run of slots with records of one fixed length, so a reader finds slot s at byte
``(s - first_slot) * stride`` of its shard and can go on from any place.
"""

from __future__ import annotations

import base64
import functools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches, stored

# What Unicode calls white space, which is what ``\s`` of the pattern means.
_SPACE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# A chunk is white space and the word after it: no piece of the pattern goes on from a word into white
# space, and none looks back, so a text's tokens are those of its chunks.
_CHUNK = re.compile("[S]*[^S]+|[S]+".replace("S", _SPACE))
# A fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_WORDS, MEMO_CHARS = 1_000_000, 64
ROUNDS = 6
HEADER = np.dtype([("doc_id", "<i8"), ("number", "<i4"), ("n_tokens", "<i4")])
NO_ID = -(1 << 63)  # doc_id in the header of a record whose document has none
# Records in a row of shards; a row is then about a megabyte with 512 tokens.
SHARD_RECORDS = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """The merges of a byte-level vocabulary file: a base64 piece and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def byte_pair_encoder(path: str, pattern: str = PATTERN) -> Callable[[], Callable[[str], list[int]]]:
    """A function that, called in a worker, gives the encoder of that vocabulary file."""
    return lambda: _encoder(path, pattern).encode_ordinary


class Chunks(dict):
    """Token ids of chunks as bytes, remembered up to a bound."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), "<u2").tobytes()
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[chunk] = ids
        return ids


def mix(value: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing function: multiply and shift, wrapping around."""
    value = (value ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    value = value * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(32))


def slots(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 to n-1: balanced Feistel rounds with cycle-walking.

    The rounds permute the numbers of an even number of bits, at most four times as many as n.
    A result beyond n is sent through again until it lies below, which keeps the whole one-to-one.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [(seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64) for r in range(ROUNDS)]

    def rounds(value: np.ndarray) -> np.ndarray:
        left, right = value >> shift, value & mask
        for key in keys:
            left, right = right, left ^ (mix(right, key) & mask)
        return (left << shift) | right

    out = rounds(index.astype(np.uint64))
    while (beyond := np.flatnonzero(out >= np.uint64(n))).size:
        out[beyond] = rounds(out[beyond])
    return out.astype(np.int64)


def sequences(
    docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], length: int, end_id: int, doc_id: str, text: str
) -> DataFrame:
    """Fixed-length token sequences of whole texts, written once.

    Columns: ``part`` (the task that wrote it), ``place`` (its number there), ``doc_id``,
    ``number`` (within the document), ``n_tokens`` (without padding) and ``tokens`` (16-bit ids,
    padded with ``end_id``). Each text ends with ``end_id``. The numbering
    is part of the committed table, so it stays as it is if an executor is lost later.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(encoder())
        part, place = TaskContext.get().partitionId(), 0
        end, size = np.array([end_id], "<u2").tobytes(), 2 * length
        for batch in batches:
            rows: list[tuple] = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = b"".join(map(chunks.__getitem__, _CHUNK.findall(data or ""))) + end
                for number, start in enumerate(range(0, len(ids), size)):
                    record = ids[start : start + size]
                    n = len(record) // 2
                    rows.append((part, place, i, number, n, record + end * (length - n)))
                    place += 1
            yield pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([
        ("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int32()),
        ("n_tokens", pa.int32()), ("tokens", pa.binary()),
    ])
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(
        rows.mapInArrow(scan, "part int, place long, doc_id long, number int, n_tokens int, tokens binary"), "sequences")


def materialise(
    docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], seed: int = 42, length: int = 512,
    end_id: int = 50256, records: int = SHARD_RECORDS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Shards of fixed-stride records in training order, one row for each shard.

    Columns: ``shard``, ``first_slot``, ``n_records``, ``stride``, ``n_tokens``, ``doc_ids``
    (by record) and ``data``: ``n_records`` times ``stride`` bytes, each record a header
    (doc_id, number, n_tokens; little endian) and ``length`` 16-bit ids. The sequences of all
    texts are numbered densely, a keyed permutation gives each its slot, and slots are dealt to
    partitions by range; all shards but the last are full.

    A null or blank text gives one sequence that holds its end (and white space, if any). Rows
    may repeat; a null id is null in ``doc_ids`` and the least 64-bit number in the header.
    Empty tables give no shard; other columns are ignored.
    """
    if not 0 <= end_id < 1 << 16 or length < 1 or records < 1:
        raise ValueError("ids have 16 bits, and sequences and shards at least one element")
    spark = docs.sparkSession
    rows = sequences(docs, encoder, length, end_id, doc_id, text)
    # One row for each task that wrote sequences.
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part] = total
        total += sizes[part]
    shared = spark.sparkContext.broadcast(starts)
    stride = HEADER.itemsize + 2 * length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.array([shared.value[p] for p in batch.column(0).to_pylist()], np.int64)
            slot = slots(first + batch.column(1).to_numpy(), total, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), *batch.columns[2:]], ["slot", *batch.schema.names[2:]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []

        def shard() -> pa.RecordBatch:
            slot, ids, numbers, n, tokens = zip(*open_, strict=True)
            header = np.zeros(len(open_), HEADER)
            header["doc_id"] = [NO_ID if i is None else i for i in ids]
            header["number"], header["n_tokens"] = numbers, n
            data = b"".join(h + t for h, t in zip(map(np.void.tobytes, header), tokens, strict=True))
            values = [slot[0] // records, slot[0], len(open_), stride, int(sum(n)), list(ids), data]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and open_[0][0] // records != row[0] // records:
                    yield shard()
                    open_ = []
                open_.append(row)
        if open_:
            yield shard()

    schema = pa.schema([
        ("shard", pa.int64()), ("first_slot", pa.int64()), ("n_records", pa.int32()), ("stride", pa.int32()),
        ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary()),
    ])
    placed = rows.mapInArrow(place, "slot long, doc_id long, number int, n_tokens int, tokens binary")
    n_shards = max(1, -(-total // records))
    parts = min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Contiguous runs of shards: the ranges are known, so no sampling pass is needed.
    target = F.floor(F.floor(F.col("slot") / records) * parts / n_shards).cast("int")
    ordered = placed.repartitionById(parts, target).sortWithinPartitions("slot")
    return ordered.mapInArrow(gather, (
        "shard long, first_slot long, n_records int, stride int, n_tokens long, doc_ids array<bigint>, data binary"
    ))


def write_shards(shards: DataFrame, folder: str) -> str:
    """Write the shards below ``folder`` under a new name and return it."""
    path = f"{folder.rstrip('/')}/training-{uuid.uuid4().hex}"
    shards.write.parquet(path)
    return path


def read_from(spark: SparkSession, path: str, slot: int = 0) -> DataFrame:
    """The records from ``slot`` on, in order: ``(slot, doc_id, number, tokens)``.

    Shards that end before the slot are skipped by their statistics. ``tokens`` is without padding.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, stride, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for i in range(max(0, slot - first), n):
                    record = data[i * stride : (i + 1) * stride]
                    header = np.frombuffer(record[: HEADER.itemsize], HEADER)[0]
                    tokens = np.frombuffer(record, "<u2", int(header["n_tokens"]), HEADER.itemsize)
                    own = int(header["doc_id"])
                    rows.append({
                        "slot": first + i, "doc_id": None if own == NO_ID else own, "number": int(header["number"]),
                        "tokens": tokens.astype(np.int32).tolist()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("slot", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int32()), ("tokens", pa.list_(pa.int32()))]))

    shards = spark.read.parquet(path).where(F.col("first_slot") + F.col("n_records") > slot)
    return (
        shards.select("first_slot", "n_records", "stride", "data")
        .mapInArrow(cut, "slot long, doc_id long, number int, tokens array<int>").orderBy("slot")
    )
