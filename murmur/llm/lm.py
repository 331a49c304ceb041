"""Language-model scoring: a smoothed three-word model in Elias-Fano tries, sharded by context.

Every word of the training texts has a number of its own. The most frequent ones, the head, are
numbered on the driver and looked up in a broadcast list; all others are numbered where they were
counted and joined to the vocabulary of each block. Shards hold the successors of some middle
words; documents send their word triples to the shards and add up what comes back, so neither the
corpus nor the model nor the vocabulary passes through one task or the driver.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches, stored
from murmur.llm.elias_fano import Trie

BEGIN, END, RARE, FIRST = 0, 1, 2, 3  # numbers: text begin, text end, words without their own, the head
BITS = 18  # of a number in the head; all other words are numbered from 1 << BITS
HEAD_WORDS = (1 << 17) - FIRST
HEAD_BYTES = 64  # longer words are looked up by a join, so the head is below 10 MB
WORD_BITS = 63 - BITS  # of any word's number, so that one beside a number in the head fits a long
BLOCK_TOKENS, BLOCK_DOCS = 1 << 19, 1 << 16
GRAINS = 64  # steps to a doubling, when the head's least count is chosen
BASE = 0.1  # added to each count of the base distribution


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers take next to nothing."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = raw.size // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(-1))
        at += n * size
    return out


def _pack_longs(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0, all of one length, without the byte planes that none of them needs."""
    widths = [(int(a.max(initial=0)).bit_length() + 7) // 8 for a in arrays]
    planes = [
        np.ascontiguousarray(a.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()
        for a, k in zip(arrays, widths, strict=True)
    ]
    head = bytes([len(arrays), *widths]) + arrays[0].size.to_bytes(8, "little")
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack_longs(data: bytes) -> list[np.ndarray]:
    end = data[0] + 1
    n, at, out = int.from_bytes(data[end : end + 8], "little"), 0, []
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[end + 8 :]), np.uint8)
    for k in data[1:end]:
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :k] = raw[at : at + n * k].reshape(k, n).T
        out.append(planes.view("<i8").reshape(-1))
        at += n * k
    return out


@dataclass(frozen=True)
class Head:
    """Numbers of the frequent words, and the distribution of single words.

    ``cut`` says that words outside the head have no number of their own.
    """

    words: pa.Array
    counts: np.ndarray
    tokens: int
    distinct: int
    cut: bool

    @property
    def rare_mass(self) -> float:
        if not self.cut:
            return BASE  # only words that were never learnt from
        own = self.distinct - int((self.counts > 0).sum())
        return self.tokens - float(self.counts.sum()) + BASE * (own + 1)

    @property
    def whole(self) -> float:
        return self.tokens + BASE * (self.distinct + 1)

    def unigram(self) -> np.ndarray:
        p = (self.counts + BASE) / self.whole
        p[RARE] = self.rare_mass / self.whole
        p[BEGIN] = 1.0  # never predicted
        return p

    def classes(self, vocabulary: pa.Array) -> np.ndarray:
        place = pc.index_in(vocabulary.cast(pa.binary()), value_set=self.words)
        return pc.fill_null(pc.add(place, FIRST), RARE).to_numpy(zero_copy_only=False)


@dataclass
class Plan:
    """Which shard gets a triple, by units of middle words, hot ones cut by the word before them.

    ``parts`` and ``first`` give each word of the head its units, ``shard`` each unit its shard. A
    hot pair (a word and a hot middle word) has units of its own, dealt by block. Middle words
    outside the head go to one of ``n_shards`` by a hash of their number; after a word never
    learnt from nothing is known in any shard, so with ``spread`` such rows go anywhere.
    """

    parts: np.ndarray
    first: np.ndarray
    shard: np.ndarray
    pairs: dict[int, tuple[int, int]] = field(default_factory=dict)
    n_shards: int = 1
    spread: bool = False

    def shards(self, u: np.ndarray, v: np.ndarray, block: int) -> np.ndarray:
        known = v < self.parts.size
        inner = np.where(known, v, BEGIN)
        unit = self.first[inner].astype(np.int64)
        parts = self.parts[inner]
        cut = np.flatnonzero((parts > 1) & known)
        unit[cut] += _dealt(u[cut], parts[cut])
        for at, first, n in hot_rows(self, u, v):
            unit[at] = first + block % n
        shard = self.shard[unit]
        out = np.flatnonzero(~known)
        shard[out] = _dealt(v[out], self.n_shards)
        if self.spread:
            out = np.flatnonzero(v == RARE)
            shard[out] = (block + np.arange(out.size)) % self.n_shards
        return shard

    def hot(self, v: np.ndarray) -> np.ndarray:
        return (v < self.parts.size) & (self.parts[np.where(v < self.parts.size, v, BEGIN)] > 1)

    def shards_of(self, v: int) -> set[int]:
        units = list(range(self.first[v], self.first[v] + self.parts[v]))
        for pair, (first, n) in self.pairs.items():
            if pair & ((1 << BITS) - 1) == v:
                units += range(first, first + n)
        return set(self.shard[units].tolist())


def _dealt(numbers: np.ndarray, parts) -> np.ndarray:
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.asarray(parts).astype(np.uint64)).astype(np.int64)


def context_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One number for any word and a middle word of the head; -1 for other middle words."""
    return np.where(v < 1 << BITS, (u.astype(np.int64) << BITS) | v, -1)


def hot_rows(plan: Plan, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    if plan.pairs:
        key = context_key(u, v)
        hot = np.fromiter(plan.pairs, np.int64)
        some = np.flatnonzero(np.isin(key, hot))
        for pair, (first, n) in plan.pairs.items():
            yield some[key[some] == pair], first, n


def make_plan(
    counts: np.ndarray, shard_tokens: int, pairs: dict[int, int] | None = None, rest: float | None = None
) -> Plan:
    """Cut what is larger than a shard into halves of one; put the largest units where least lies.

    ``rest`` counts the tokens of numbered words outside the head, if there can be any.
    """
    half = max(1, shard_tokens // 2)
    parts = np.where(counts > shard_tokens, np.ceil(counts / half), 1).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(np.int32)
    sizes = np.repeat(counts / parts, parts)
    hot = {}
    for pair, n in sorted((pairs or {}).items()):
        hot[pair] = (sizes.size, math.ceil(n / half))
        sizes = np.append(sizes, np.full(hot[pair][1], n / hot[pair][1]))
    n_shards = max(1, math.ceil((counts.sum() + (rest or 0)) / shard_tokens))
    loads = [(0.0, i) for i in range(n_shards)]
    shard = np.zeros(sizes.size, np.int32)
    for unit in np.argsort(-sizes, kind="stable"):
        load, i = heapq.heappop(loads)
        shard[unit] = i
        heapq.heappush(loads, (load + sizes[unit], i))
    return Plan(parts, first, shard, hot, n_shards, rest is not None)


def token_blocks(docs: DataFrame, learn: Column, doc_id: str, text: str) -> DataFrame:
    """Texts as blocks of word numbers with the block's own vocabulary, written once.

    Words are runs without ASCII white space, A-Z lower-cased; null texts have none. A block
    number is made of the writing task's number and a count, and fixed once it is written.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, learns, sizes, parts, number, count = [], [], [], [], None, itertools.count()

        def block() -> pa.RecordBatch:
            numbers = np.concatenate(parts)
            values = [
                pa.array([(TaskContext.get().partitionId() << 32) + next(count)], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([learns], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int32())), pa.array([list(number)], pa.list_(pa.binary())),
                pa.array([_pack(numbers)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(values, ["block", "doc_id", "learn", "n_words", "vocabulary", "numbers"])

        for batch in batches:
            for i, learns_, data in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                batch.column(2).cast(pa.binary()).to_pylist(), strict=True,
            ):
                if not ids:
                    number = defaultdict(itertools.count().__next__)
                    total = 0
                words = (data or b"").lower().split()
                ids.append(i)
                learns.append(learns_)
                sizes.append(len(words))
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                total += len(words)
                if total >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                    yield block()
                    ids, learns, sizes, parts = [], [], [], []
        if ids:
            yield block()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long"), learn.alias("learn"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(scan, (
        "block long, doc_id array<bigint>, learn array<boolean>, n_words array<int>, "
        "vocabulary array<binary>, numbers binary"
    )), "lm-blocks")


@dataclass
class Block:
    """One row of the numbered blocks: number and training count of each word of its vocabulary."""

    number: int
    doc_ids: pa.Array
    learn: np.ndarray
    n_words: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Iterator[Block]:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            yield cls(
                column["block"][i].as_py(), column["doc_id"][i].values,
                column["learn"][i].values.to_numpy(zero_copy_only=False).astype(bool),
                column["n_words"][i].values.to_numpy(), *_unpack_longs(column["words"][i].as_py()),
                _unpack(column["numbers"][i].as_py(), np.int32)[0],
            )

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_words.size), self.n_words)

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of all texts and their ends, with the two words before each, by document.

        Last comes the count of each word outside the head, which no other task knows.
        """
        ends = np.cumsum(self.n_words.astype(np.int64) + 3)
        row = np.full(int(ends[-1]) if ends.size else 0, BEGIN, np.int64)
        row[ends - 1] = END
        count = np.zeros(row.size, np.int64)
        document = np.repeat(np.arange(ends.size), self.n_words + 3)
        inner = np.ones(row.size, bool)
        begins = ends - self.n_words - 3
        inner[begins] = inner[begins + 1] = inner[ends - 1] = False
        row[inner] = self.words[self.numbers]
        count[inner] = np.where(self.words >> BITS > 0, self.counts, 0)[self.numbers]
        at = np.flatnonzero(np.where(inner, True, row == END))
        return row[at - 2], row[at - 1], row[at], document[at], count[at]


def word_counts(blocks: DataFrame) -> DataFrame:
    """``(word, n, part, row)`` over all texts to learn from; the empty word counts their ends.

    ``part`` is the writing task and ``row`` the place there, fixed once they are written.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for learn, sizes, vocabulary, data in zip(*batch.columns, strict=True):
                learn = learn.values.to_numpy(zero_copy_only=False).astype(bool)
                vocabulary = vocabulary.values
                used = _unpack(data.as_py(), np.int32)[0][np.repeat(learn, sizes.values.to_numpy())]
                n = np.bincount(used, minlength=len(vocabulary))
                some = np.flatnonzero(n)
                words = pa.concat_arrays([vocabulary.take(pa.array(some)).cast(pa.binary()), pa.array([b""], pa.binary())])
                yield pa.RecordBatch.from_arrays(
                    [words, pa.array(np.append(n[some], int(learn.sum())))], ["word", "n"])

    rows = blocks.select("learn", "n_words", "vocabulary", "numbers").mapInArrow(count, "word binary, n long")
    return stored(rows.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0").select(
        "word", "n", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
    ), "lm-words")


def numbered(blocks: DataFrame, words: DataFrame, head) -> DataFrame:
    """The blocks with number and training count of each word in place of the words, written once.

    What the head does not hold is looked up by a join, once for each block; a word never learnt
    from finds nothing and keeps the number of all those.
    """
    sizes = {r["part"]: r["count"] for r in words.groupBy("part").count().collect()}
    offset = np.zeros(max(sizes, default=0) + 1, np.int64)
    at = 1 << BITS
    for part in sorted(sizes):
        offset[part] = at
        at += sizes[part]
    if at >> WORD_BITS:
        raise ValueError(f"more than 2^{WORD_BITS} distinct words")
    offsets = blocks.sparkSession.sparkContext.broadcast(offset)

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary in zip(*batch.columns, strict=True):
                place = np.flatnonzero(head.value.classes(vocabulary.values) == RARE).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    vocabulary.values.take(pa.array(place)).cast(pa.binary()),
                    pa.array(np.full(place.size, block.as_py())), pa.array(place),
                ], ["word", "block", "place"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            block, place, part, row, n = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(block, kind="stable")
            word = np.full(block.size, RARE) if head.value.cut else offsets.value[part] + row
            pieces = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
            return pa.RecordBatch.from_arrays([
                pa.array([int(block[i[0]]) for i in pieces], pa.int64()),
                pa.array([_pack_longs(place[i], word[i], n[i]) for i in pieces], pa.binary()),
            ], ["block", "data"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
            if len(held) >= 4096:  # about a million words
                yield out(held)
                held = []
        if held:
            yield out(held)

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [head.value.classes(v.values) for v in batch.column(4)]
            known = [_pack_longs(c, np.where(c >= FIRST, head.value.counts[c], 0).astype(np.int64)) for c in classes]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(known, pa.binary()), batch.column(5)],
                ["block", "doc_id", "learn", "n_words", "words", "numbers"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = []
            for known, parts in zip(batch.column(4), batch.column(6), strict=True):
                word, n = _unpack_longs(known.as_py())
                for data in parts.as_py() or []:
                    place, word_, n_ = _unpack_longs(data)
                    word[place], n[place] = word_, n_
                every.append(_pack_longs(word, n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(every, pa.binary()), batch.column(5)], batch.schema.names[:6])

    kind = "block long, doc_id array<bigint>, learn array<boolean>, n_words array<int>, words binary, numbers binary"
    asked = blocks.select("block", "vocabulary").mapInArrow(outside, "word binary, block long, place int")
    found = asked.join(words, "word").select("block", "place", "part", "row", "n").mapInArrow(packed, "block long, data binary")
    found = found.groupBy("block").agg(F.collect_list("data").alias("found"))
    whole = blocks.select("block", "doc_id", "learn", "n_words", "vocabulary", "numbers").mapInArrow(classified, kind)
    return stored(whole.join(found, "block", "left").mapInArrow(filled, kind), "lm-numbered")


def read_head(words: DataFrame, head_words: int, cut: bool, hot: int) -> Head:
    """The most frequent words: a bounded number of at most 64 bytes each.

    Their least count is the smallest step of a logarithmic scale that not too many words reach, so
    only the head itself comes to the driver. Unless words are ``cut``, longer ones with more than
    ``hot`` tokens come too: few in any corpus, and they have to be dealt to several shards.
    """
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    frequent = words.where((F.length("word") <= HEAD_BYTES) & (F.length("word") > 0))
    step = F.floor(F.log2("n") * GRAINS).cast("int")
    least, room = None, head_words
    for r in frequent.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few thousand
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    rows = frequent.where(step >= least).collect() if least is not None else []
    if not cut:
        rows += words.where((F.length("word") > HEAD_BYTES) & (F.col("n") > hot)).collect()
    rows.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    counts = np.zeros(len(rows) + FIRST)
    counts[FIRST:] = [r["n"] for r in rows]
    ends = words.where(F.length("word") == 0).agg(F.sum("n")).head()[0]
    counts[END] = ends or 0
    return Head(pa.array([bytes(r["word"]) for r in rows], pa.binary()), counts, int(tokens), int(distinct), cut)


PARTIAL = "block long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
NAMES = [part.split()[0] for part in PARTIAL.split(", ")]


def _partial(n: int, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    types = {part.split()[0]: kinds[part.split()[1]] for part in PARTIAL.split(", ")}
    arrays = [
        pa.array(columns[name], types[name]) if name in columns else pa.nulls(n, types[name]) for name in NAMES
    ]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def word_sums(blocks: DataFrame, head) -> DataFrame:
    """What the single words and the end add to each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = head.value
        end = model.counts[END]
        for batch in batches:
            for b in Block.read(batch):
                n, document = b.n_words.size, b.documents()
                logs = np.log10(b.counts + BASE)
                apart = np.where(b.words == RARE, logs - math.log10(model.rare_mass), 0.0)
                yield _partial(
                    n, block=np.full(n, b.number), place=np.arange(n, dtype=np.int32), doc_id=b.doc_ids,
                    held_out=~b.learn, n_tokens=b.n_words.astype(np.int64) + 1,
                    n_known=np.bincount(document, (b.counts > 0)[b.numbers], n).astype(np.int64) + int(end > 0),
                    base=np.bincount(document, (logs - math.log10(model.whole))[b.numbers], n)
                    + math.log10((end + BASE) / model.whole),
                    score=np.bincount(document, apart[b.numbers], n),
                )

    return blocks.mapInArrow(scan, PARTIAL)


def _grouped_counts(blocks: DataFrame, keys, name: str) -> DataFrame:
    """``(key, n, everywhere, count)``: of keys that ``keys(u, v, w)`` picks, in training and in all texts.

    ``count`` is that of the word ``w`` alone, if it is outside the head.
    """

    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, learnt, every, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        values, first, back = np.unique(key, return_index=True, return_inverse=True)
        return values, *(np.bincount(back, x, values.size).astype(np.int64) for x in (learnt, every)), count[first]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "everywhere", "count"]
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for b in Block.read(batch):
                u, v, w, document, count = b.triples()
                at, key = keys(u, v, w)
                held.append(added([(key, b.learn[document[at]], np.ones(at.size), count[at])]))
                if sum(x[0].size for x in held) > 1 << 20:
                    held = [added(held)]
                if held[0][0].size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held.pop(0))], names)
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, added(held))], names)

    rows = blocks.mapInArrow(scan, "key long, n long, everywhere long, count long")
    return stored(rows.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere"), F.max("count").alias("count")), name)


PIECE = "shard int, kind int, block long, data binary"
_MASK = (1 << BITS) - 1
REQUEST, PAIRS, TRIPLES = 2, 0, 1  # counts come before the requests of a shard


def requests(blocks: DataFrame, plan) -> DataFrame:
    """The triples of each block, one row for each shard they go to."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in Block.read(batch):
                u, v, w, document, count = b.triples()
                shard = plan.value.shards(u, v, b.number)
                kind = np.uint16 if shard.size and shard.max() < 1 << 16 else np.int32
                order = np.argsort(shard.astype(kind), kind="stable")
                shard = shard[order]
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), shard.size]
                # Two bits of the place say nothing else than whether the document is learnt from.
                place = ((document << 1) | b.learn[document])[order]
                u, v, w, count = u[order], v[order], w[order], count[order]
                pieces = [
                    (int(shard[i]), _pack_longs(u[i:j], v[i:j], w[i:j], count[i:j], place[i:j]))
                    for i, j in zip(cuts, cuts[1:], strict=False) if j > i
                ]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _ in pieces], pa.int32()), pa.array([REQUEST] * n, pa.int32()),
                    pa.array([b.number] * n, pa.int64()), pa.array([d for _, d in pieces], pa.binary()),
                ], ["shard", "kind", "block", "data"])

    return blocks.mapInArrow(scan, PIECE)


def copied_counts(counts: DataFrame, plan, kind: int, wanted: np.ndarray | None = None) -> DataFrame:
    """Counts of hot contexts, already summed up, for every shard that has a part of them.

    A key is a word beside its hot middle word, or beside the place of its hot pair in ``wanted``.
    """

    def packed(keys: np.ndarray, n: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        out = []
        context = keys & _MASK if kind == PAIRS else keys >> WORD_BITS
        order = np.argsort(context, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(context[order])) + 1):
            c, key = int(context[at[0]]), keys[at]
            if kind == PAIRS:
                shards, u, v, w = plan.value.shards_of(c), 0, c, key >> BITS
            else:
                pair = int(wanted[c])
                first, parts = plan.value.pairs[pair]
                shards = set(plan.value.shard[first : first + parts].tolist())
                u, v, w = pair >> BITS, pair & _MASK, key & ((1 << WORD_BITS) - 1)
            data = _pack_longs(np.full(at.size, u), np.full(at.size, v), w, count[at], n[at])
            out += [(s, data) for s in shards]
        return pa.RecordBatch.from_arrays([
            pa.array([s for s, _ in out], pa.int32()), pa.array([kind] * len(out), pa.int32()),
            pa.array([-1] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary()),
        ], ["shard", "kind", "block", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            held.append([c[columns[1] > 0] for c in columns])
            if len(held) >= 4096:  # about a million counts
                if sum(len(x[0]) for x in held):
                    yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if sum(len(x[0]) for x in held):
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    return counts.select("key", "n", "count").mapInArrow(scan, PIECE)


def shard_scores(pieces: DataFrame, head, plan, discount: float) -> DataFrame:
    """Build each shard's trie from the texts to learn from and answer all its requests.

    The words of a shard are numbered anew from 0, so that two of them fit one key; a triple's key
    is made of the number of its context and its last word.
    """

    def answer(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        asked = [(block, _unpack_longs(data)) for kind, block, data in rows if kind == REQUEST]
        if not asked:
            return
        given = {
            k: [np.concatenate(x) for x in zip(*[_unpack_longs(data) for kind, _, data in rows if kind == k], strict=True)]
            or [np.zeros(0, np.int64)] * 5 for k in (PAIRS, TRIPLES)
        }
        u, v, w, count, place = (np.concatenate([x[i] for _, x in asked]) for i in range(5))
        learn = place & 1
        for at, _, _ in hot_rows(plan.value, u, v):
            learn[at] = 0  # counted beforehand
        u, v, w, count, learn = (np.concatenate([x, y]) for x, y in zip((u, v, w, count, learn), given[TRIPLES], strict=True))
        _, pair_v, pair_w, pair_count, pair_n = given[PAIRS]

        coded = pc.dictionary_encode(pa.array(np.concatenate([u, v, w, pair_v, pair_w])))
        words, local = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        ends = np.cumsum([u.size, v.size, w.size, pair_v.size])
        u, v, w, pair_v, pair_w = np.split(local, ends)
        size = words.size
        n = np.zeros(size)
        n[w], n[pair_w] = count, pair_count
        model: Head = head.value
        unigram = (n + BASE) / model.whole
        own = np.flatnonzero(words < 1 << BITS)
        unigram[own] = model.unigram()[words[own]]

        contexts, context = np.unique(v * size + u, return_inverse=True)
        distinct, back = np.unique(context * size + w, return_inverse=True)
        weight = np.bincount(back, learn, distinct.size)
        context, w = distinct // size, distinct % size
        v, u = contexts[context] // size, contexts[context] % size
        some = np.flatnonzero(weight > 0)
        pairs, place_of = np.unique(np.concatenate([(v * size + w)[some], pair_v * size + pair_w]), return_inverse=True)
        # The pairs of a hot middle word are given.
        counted = np.concatenate([np.where(plan.value.hot(words[v[some]]), 0, weight[some]), pair_n])
        trie = Trie(
            u[some], v[some], w[some], weight[some], pairs // size, pairs % size,
            np.bincount(place_of, counted, pairs.size), place_of[: some.size], unigram, discount)
        logs = trie.log10(u, v, w)[back]
        at = 0
        for block, (*_, where) in asked:
            first = np.flatnonzero(np.diff(where >> 1, prepend=-1))
            sums = np.add.reduceat(logs[at : at + where.size], first)
            at += where.size
            data = _pack((where[first] >> 1).astype(np.int32), sums.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([data], pa.binary())], ["block", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shard = [], None
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard and rows:
                    yield from answer(rows)
                    rows = []
                shard = s
                rows.append(row)
        if rows:
            yield from answer(rows)

    dealt = pieces.repartitionById(plan.value.n_shards, "shard").sortWithinPartitions("shard", "kind", "block")
    return dealt.mapInArrow(scan, "block long, data binary")


def merged(answers: DataFrame) -> DataFrame:
    """Add up, block by block, what the shards have answered."""

    def add(block: int, parts: list[bytes]) -> pa.RecordBatch:
        pairs = [_unpack(data, np.int32, np.float32) for data in parts]
        place, sums = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        total = np.bincount(place, sums)
        places = np.flatnonzero(np.bincount(place))
        return _partial(
            places.size, block=np.full(places.size, block), place=places.astype(np.int32), score=total[places])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, open_ = [], None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != open_ and parts:
                    yield add(open_, parts)
                    parts = []
                open_ = block
                parts.append(data)
        if parts:
            yield add(open_, parts)

    return answers.repartition("block").sortWithinPartitions("block").mapInArrow(scan, PARTIAL)


def score_documents(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
    head_words: int | None = None, shard_tokens: int = 1_500_000, discount: float = 0.75,
) -> DataFrame:
    """Score every whole text by a model learnt from the rows for which ``learn`` holds.

    Columns: ``doc_id``, ``held_out`` (not learnt from), ``n_tokens`` (words and the end),
    ``n_known`` (of those, seen in training), ``train_tokens``, ``base_score`` (sum of log10 of
    the smoothed word frequencies) and ``score`` (log10 of the text's probability under
    the model). ``shard_tokens`` bounds what a task holds, whatever the size of the corpus.

    Every word learnt from has its place in the model. With ``head_words`` (at most 131,069) only
    that many of the most frequent, of at most 64 bytes, have; the others share one class and are
    told apart within it by their frequency alone.

    Null and blank texts consist of their end. Rows may repeat and are scored each; a null id
    stays null. Where ``learn`` is null a row is not learnt from. Empty tables give empty tables, and
    without anything to learn from all words share the base distribution. Other columns are
    ignored.
    """
    cut = head_words is not None
    if cut and not 0 < head_words <= HEAD_WORDS:
        raise ValueError(f"head_words must be between 1 and {HEAD_WORDS}")
    context = docs.sparkSession.sparkContext
    texts = token_blocks(docs, F.coalesce(learn, F.lit(False)), doc_id, text)
    words = word_counts(texts)
    head = context.broadcast(read_head(words, head_words if cut else HEAD_WORDS, cut, shard_tokens // 2))
    model: Head = head.value
    blocks = numbered(texts, words, head)

    counts = model.counts.copy()
    rest = max(0.0, model.tokens - counts.sum())
    if cut:
        counts[RARE], rest = rest, None
    counts[BEGIN] = counts[END]  # each text begins once
    counts[END] = 0  # never in the middle
    plan = make_plan(counts, shard_tokens, rest=rest)
    pieces = []
    if (plan.parts > 1).any():
        hot = plan

        def hot_pairs(u, v, w):
            at = np.flatnonzero(hot.hot(v))
            return at, context_key(w[at], v[at])

        pairs = _grouped_counts(blocks, hot_pairs, "lm-hot-pairs")
        # At most two rows for each shard: a pair counts here from half a shard's tokens on.
        large = {}
        for r in pairs.where(F.col("everywhere") > shard_tokens // 2).select("key", "everywhere").collect():
            if hot.hot(np.array([r["key"] >> BITS]))[0]:
                large[(r["key"] & _MASK) << BITS | r["key"] >> BITS] = r["everywhere"]
        plan = make_plan(counts, shard_tokens, large, rest)
        shared = context.broadcast(plan)
        pieces.append(copied_counts(pairs, shared, PAIRS))
        if large:
            wanted = np.sort(np.fromiter(large, np.int64))

            def hot_triples(u, v, w):
                pair = context_key(u, v)
                at = np.flatnonzero(np.isin(pair, wanted))
                return at, np.searchsorted(wanted, pair[at]) << WORD_BITS | w[at]

            pieces.append(copied_counts(_grouped_counts(blocks, hot_triples, "lm-hot-triples"), shared, TRIPLES, wanted))
    else:
        shared = context.broadcast(plan)
    every = requests(blocks, shared)
    for piece in pieces:
        every = every.unionByName(piece)
    sums = (
        word_sums(blocks, head).unionByName(merged(shard_scores(every, head, shared, discount)))
        .groupBy("block", "place").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
        )
    )
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
