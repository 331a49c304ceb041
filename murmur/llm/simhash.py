"""SimHash near-duplicates: fingerprints, tiled exact comparison, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches, components, dealt_pairs, forest, stored, unused

TILE = 512  # rows on each side of a tile pair: 2 MB of distances
SEED = 42
SLICE = 1 << 16  # shingles whose bits are counted at once


def fingerprint(data: bytes | None, shingle: int) -> int:
    """SimHash of a text's word shingles under XXH64; 0 for a text without words.

    Words are runs without ASCII white space in a text whose A-Z are lower-cased. A text with
    fewer words than a shingle takes is one shingle. A bit is 1 if set in over half the hashes.
    """
    words = (data or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n = len(words) - shingle + 1
    pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if shingle > 1 else words
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in pieces), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        part = hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", digest: Column | None = None
) -> DataFrame:
    """One row ``(doc_id, fp)`` per document, ``fp`` being the 64 bits as a signed long.

    A ``digest`` of the row, if one is given, is carried along as a third column.
    """
    carried = [] if digest is None else [digest.alias("digest")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            bits = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bits), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    bounded_batches(docs.sparkSession)
    return (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carried)
        .mapInArrow(scan, "doc_id long, fp long" + ", digest string" * len(carried))
    )


def tile_labels(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the position of the smallest one it is linked with.

    The rows are ordered by population count and compared tile by tile with exclusive-or and
    bit counts. Two fingerprints whose counts differ by more than the radius differ in more
    bits than that, so the inner loop ends at the first tile that lies beyond it.
    """
    order = np.lexsort((fps, np.bitwise_count(fps)))
    rows = fps[order]
    ones = np.bitwise_count(rows).astype(np.int64)
    label = np.arange(rows.size)
    for i in range(0, rows.size, TILE):
        left = rows[i : i + TILE]
        for j in range(i, rows.size, TILE):
            if ones[j] - ones[i + left.size - 1] > radius:
                break
            near = np.bitwise_count(left[:, None] ^ rows[None, j : j + TILE]) <= radius
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            label = forest(rows.size, a + i, b + j, label)
    out = np.empty_like(label)
    out[order] = order[label]
    return out


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal ``(bucket, pair)``; runs may span batches."""

    def links(fps: np.ndarray) -> pa.RecordBatch:
        label = tile_labels(fps.view(np.uint64), radius)
        moved = label != np.arange(label.size)
        return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[label[moved]])], ["a", "b"])

    rest: list[np.ndarray] = []
    open_key = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
        fps = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(fps)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if (key := tuple(keys[start])) != open_key and rest:
                if sum(map(len, rest)) > 1:
                    yield links(np.concatenate(rest))
                rest = []
            open_key = key
            rest.append(fps[start:end])
    if sum(map(len, rest)) > 1:
        yield links(np.concatenate(rest))


def block_count(n: int, radius: int, bucket_rows: int = 1024) -> int:
    """How many blocks make ``n`` fingerprints cheapest to compare.

    With ``b`` blocks each row is in as many buckets as there are choices of ``b - radius`` blocks, and a
    bucket is told by the bits of those blocks: more blocks mean more buckets a row, but smaller ones.
    """
    def compared(blocks: int) -> float:
        bits = (64 // blocks) * (blocks - radius)
        return math.comb(blocks, radius) * max(bucket_rows, n / 2**bits)

    return min(range(radius + 1, min(64, 2 * radius + 2) + 1), key=compared)


def near_links(prints: DataFrame, radius: int = 3, bucket_rows: int = 1024, blocks: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` within ``radius`` bits of each other.

    The 64 bits are cut into ``blocks``, more than ``radius``. Two fingerprints within the radius
    differ in at most ``radius`` blocks, so they agree in all others, and for each choice of that
    many blocks the rows with the same leading bits of them meet. The number of bits is chosen so
    that a bucket holds about ``bucket_rows``, the number of blocks by ``block_count``: as few as
    possible while their bits are enough, more beyond some 10**8 rows. Buckets far above that are cut
    into chunks, and each pair of chunks is compared on its own. A task returns a spanning
    forest of what it linked, never the pairs.
    """
    if not 0 <= radius < 64:
        raise ValueError("the radius must be between 0 and 63 bits")
    n = prints.count()
    blocks = block_count(n, radius, bucket_rows) if blocks is None else blocks
    if not radius < blocks <= 64:
        raise ValueError("there must be more blocks than the radius, and 64 at most")
    width = 64 // blocks
    wanted = min(48, max(0, math.ceil(math.log2(max(1, n / bucket_rows)))))
    buckets = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        bucket, left = F.lit(number).cast("long"), wanted
        for b in chosen:
            bits = min(width, left)
            bucket = bucket * (1 << bits) + F.shiftrightunsigned("fp", b * width).bitwiseAND(
                F.lit((1 << bits) - 1).cast("long"))
            left -= bits
        buckets.append(bucket)
    rows = prints.select("fp", F.explode(F.array(*buckets)).alias("bucket"))
    dealt = dealt_pairs(rows, ["bucket"], F.col("fp"), 4 * bucket_rows, 2 * bucket_rows)
    other = F.sequence(F.lit(0), F.col("_chunks") - 1)
    pair = F.transform(
        other, lambda c: F.least(c, "_chunk").cast("long") * F.col("_chunks") + F.greatest(c, "_chunk")
    )
    dealt = dealt.select("bucket", F.explode(pair).alias("pair"), "fp")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(parts, "bucket", "pair").sortWithinPartitions("bucket", "pair")
        .mapInArrow(lambda batches: _compare(batches, radius), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id reachable by
    links of at most ``radius`` bits, the row's own included. Exact copies share a fingerprint
    and meet as one. A null or blank text has fingerprint zero, which is linked like any other.
    Rows may repeat. A row without an id has no say in ``component_id``, which is null if
    no row of its component has an id. An empty table gives an empty table; other columns are
    ignored.
    """
    return _grouped(fingerprints(docs, shingle, doc_id, text), radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """The rows of ``prints`` with ``root``, which names their component, and its ``component_id``."""
    prints = stored(prints, "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    label = F.coalesce("root", "fp")
    linked = rooted.where("root is not null").select("root").distinct().withColumnRenamed("root", "_root")
    groups = (
        rooted.join(linked, label == F.col("_root"), "left_semi")
        .groupBy(label.alias("root")).agg(F.min("least").alias("_least"))
    )
    known = (
        rooted.withColumn("root", label).join(groups, "root", "left")
        .select("fp", "root", F.coalesce("_least", "least").alias("component_id"))
    )
    return prints.join(known, "fp", "left")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id, with all its columns.

    Rows are told apart by id and text, so an id may repeat with texts of several groups, and one row of
    each stays. Of rows of a group with that id the one with the smallest digest of its text stays, of
    those with the same text the one with the smallest hash of all its columns but maps. Rows without
    an id stand for themselves and stay.
    """
    digest = F.coalesce(F.md5(F.col(text).cast("string")), F.lit(""))
    groups = _grouped(fingerprints(docs, shingle, doc_id, text, digest), radius)
    own, mark, row = unused(docs, "_kept", "_digest", "_row")
    kept = (
        groups.where("doc_id = component_id").groupBy("root")
        .agg(F.min("component_id").alias(own), F.min("digest").alias(mark))
    ).drop("root")
    named = docs.join(kept, (F.col(doc_id).cast("long") == F.col(own)) & (digest == F.col(mark)), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*[c for c, (_, kind) in zip(columns, docs.dtypes, strict=True) if "map<" not in kind])
    one = named.groupBy(F.col(doc_id).cast("long"), digest).agg(F.min_by(F.struct(*columns), order).alias(row))
    one = one.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
    return one.unionByName(docs.where(F.col(doc_id).isNull()))
