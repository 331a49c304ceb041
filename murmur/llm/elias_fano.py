"""Elias-Fano sequences and the n-gram trie built from them, for arrays of queries at a time."""

from __future__ import annotations

import tempfile

import numpy as np

# _IN_BYTE[b, k]: place of the k-th set bit (from 0) in the byte b.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _places = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, : len(_places)] = _places
LEVELS = 256  # of a quantised logarithm
STEP = 1 << 17  # queries answered from one decoded window of a level


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of the k-th set bits; ``before`` counts the set bits ahead of each word."""
    at = np.searchsorted(before, k, "right") - 1
    octets = words[at].view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.uint8)
    left = (k - before[at]).astype(np.uint8)
    octet = (ends <= left[:, None]).sum(axis=1)
    rows = np.arange(k.size)
    ahead = np.where(octet > 0, ends[rows, np.maximum(octet, 1) - 1], 0)
    return at * 64 + octet * 8 + _IN_BYTE[octets[rows, octet], left - ahead]


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.frombuffer(packed.tobytes() + bytes(-packed.size % 8), np.uint64)


class EliasFano:
    """A non-decreasing sequence of integers in about ``2 + log2(largest / length)`` bits each.

    The lower bits of each value are packed side by side. The upper bits are a bit vector: value
    ``i`` with upper part ``h`` sets bit ``i + h``. Counts of bits ahead of each 64-bit word
    make selection a search in a small directory.
    """

    def __init__(self, values: np.ndarray, image: list[np.ndarray]):
        values = np.asarray(values, np.int64)
        self.size = values.size
        top = int(values[-1]) + 1 if self.size else 1
        self.shift = max(0, int(top // max(1, self.size)).bit_length() - 1)
        self.buckets = (top >> self.shift) + 1
        upper = (values >> self.shift) + np.arange(self.size)
        bits = np.zeros(self.size + self.buckets, np.uint8)
        bits[upper] = 1
        self.low = self._packed(values & ((1 << self.shift) - 1))
        self.high = _words(bits)
        image += [self.low, self.high]

    def _packed(self, low: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size * self.shift // 64 + 2, np.uint64)
        if self.shift and self.size:
            at = np.arange(self.size, dtype=np.int64) * self.shift
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = low.astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            # Values do not overlap, so adding up those that start in a word puts them side by side.
            out[word[first]] += np.add.reduceat(value << bit, first)
            over = np.flatnonzero(bit + np.uint64(self.shift) > 64)
            out[word[over] + 1] += value[over] >> (np.uint64(64) - bit[over])
        return out

    def mapped(self, take) -> None:
        """Read the bit vectors from the memory-mapped image from now on."""
        self.low, self.high = take(), take()
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(i.size, np.int64)
        at = i * self.shift
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> bit
        over = np.flatnonzero(bit + np.uint64(self.shift) > 64)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - bit[over])
        return (value & np.uint64((1 << self.shift) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        if not i.size:
            return np.zeros(0, np.int64)
        return ((_select(self.high, self.ones, i) - i) << self.shift) | self._low(i)

    def window(self, first: int, end: int) -> np.ndarray:
        """The values at the places from ``first`` up to ``end``, decoded in one go."""
        if first >= end:
            return np.zeros(0, np.int64)
        a, b = _select(self.high, self.ones, np.array([first, end - 1])).tolist()
        bits = np.unpackbits(self.high[a >> 6 : (b >> 6) + 1].view(np.uint8), bitorder="little")
        places = np.flatnonzero(bits[a & 63 : b - (a >> 6 << 6) + 1]) + a
        i = np.arange(first, end)
        return ((places - i) << self.shift) | self._low(i)


class Quantised:
    """Logarithms in one byte each: 256 evenly spaced values between the least and the largest."""

    def __init__(self, logs: np.ndarray, image: list[np.ndarray]):
        self.least = float(logs.min()) if logs.size else 0.0
        self.step = max(1e-12, (float(logs.max()) - self.least) / (LEVELS - 1)) if logs.size else 1.0
        self.codes = np.rint((logs - self.least) / self.step).astype(np.uint8)
        image.append(self.codes)

    def mapped(self, take) -> None:
        self.codes = take()

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.least + self.step * self.codes[i]


class Ranges:
    """Sorted successors of a row of contexts, and the search in the range of one of them.

    ``start`` are the monotone pointers to the ranges. The values of a range are small numbers
    relative to their context; to make the whole level non-decreasing, each range is lifted by
    what the ranges before it ended with (``lift``).
    """

    def __init__(self, start: np.ndarray, values: np.ndarray, image: list[np.ndarray]):
        sizes = np.diff(start)
        last = np.where(sizes > 0, values[np.maximum(start[1:], 1) - 1] + 1, 0) if values.size else np.zeros(sizes.size, np.int64)
        lift = np.concatenate([[0], np.cumsum(last)])
        self.start, self.lift = EliasFano(start, image), EliasFano(lift, image)
        self.values = EliasFano(values + np.repeat(lift[:-1], sizes), image)

    def mapped(self, take) -> None:
        for part in (self.start, self.lift, self.values):
            part.mapped(take)

    def find(self, context: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Successor search in the ranges of ascending contexts.

        Gives the place of the value in the level, whether it is there, and where its range
        starts. The level stays packed; a window of it, the ranges of some queries, is decoded.
        """
        place, found, begin = np.empty(value.size, np.int64), np.empty(value.size, bool), np.empty(value.size, np.int64)
        for i in range(0, value.size, STEP):
            part = slice(i, i + STEP)
            first, last = int(context[i]), int(context[part][-1])
            start, lift = self.start.window(first, last + 2), self.lift.window(first, last + 2)
            values = self.values.window(int(start[0]), int(start[-1]))
            row = context[part] - first
            wanted = lift[row] + value[part]
            at = np.searchsorted(values, wanted)
            inside = (at < values.size) & (wanted < lift[row + 1])
            if values.size:
                inside &= values[np.minimum(at, values.size - 1)] == wanted
            place[part], found[part], begin[part] = at + start[0], inside, start[row]
        return place, found, begin


class Trie:
    """Smoothed three-word model over integer words, for the middle words of one shard.

    Level one holds the middle words ``v``; level two, for each, its successors ``w`` with the
    probability of ``w`` after ``v``, and the words ``u`` seen before it; level three, for each
    context ``(u, v)``, its successors as places among the successors of ``v`` with their
    probability after ``u v``. All logarithms are quantised; what a context leaves to shorter ones
    is kept beside it. The levels lie in one image, mapped from a file that
    belongs to the task alone and is gone with it, like a spill.
    """

    def __init__(self, u, v, w, count, pair_v, pair_w, pair_count, place, unigram, discount: float):
        """``count`` of distinct (v, u, w) in this order, ``pair_count`` of distinct (v, w).

        ``place`` says which of the pairs each triple ends with.
        """
        image: list[np.ndarray] = []
        self.unigram = unigram
        roots, first = np.unique(pair_v, return_index=True)
        start = np.append(first, pair_v.size)
        total = np.add.reduceat(pair_count, first) if roots.size else np.zeros(0)
        left = discount * np.diff(start) / total
        root_of = np.repeat(np.arange(roots.size), np.diff(start))
        p2 = (pair_count - discount) / total[root_of] + left[root_of] * unigram[pair_w]
        self.roots = EliasFano(roots, image)
        self.pairs = Ranges(start, pair_w, image)
        self.p2, self.left2 = Quantised(np.log10(p2), image), Quantised(np.log10(left), image)

        new = np.ones(v.size, bool)
        new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
        first3 = np.flatnonzero(new)
        start3 = np.append(first3, v.size)
        total3 = np.add.reduceat(count, first3) if v.size else np.zeros(0)
        left3 = discount * np.diff(start3) / total3
        context_of = np.repeat(np.arange(first3.size), np.diff(start3))
        root_of_context = np.searchsorted(roots, v[first3])
        p3 = (count - discount) / total3[context_of] + left3[context_of] * p2[place]
        self.contexts = Ranges(np.searchsorted(root_of_context, np.arange(roots.size + 1)), u[first3], image)
        self.triples = Ranges(start3, place - start[root_of_context[context_of]], image)
        self.p3, self.left3 = Quantised(np.log10(p3), image), Quantised(np.log10(left3), image)
        self._map(image)

    def _map(self, image: list[np.ndarray]) -> None:
        with tempfile.TemporaryFile() as file:
            places, at = [], 0
            for part in image:
                file.write(data := part.tobytes())
                file.write(bytes(pad := -len(data) % 8))
                places.append((at, part.dtype, part.size))
                at += len(data) + pad
            self.bytes = at
            file.write(bytes(8))
            file.flush()
            levels = np.memmap(file, np.uint8, "r")
        parts = iter(places)

        def take() -> np.ndarray:
            begin, kind, size = next(parts)
            return levels[begin : begin + size * kind.itemsize].view(kind)

        for level in (self.roots, self.pairs, self.p2, self.left2, self.contexts, self.triples, self.p3, self.left3):
            level.mapped(take)

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Logarithms of the probability of each ``w`` after ``u v``; sorted by ``v``, then ``u``."""
        logs = np.log10(self.unigram[w])
        if not v.size:
            return logs
        roots = self.roots.window(0, self.roots.size)
        root = np.searchsorted(roots, v)
        ask = np.flatnonzero((root < roots.size) & (roots[np.minimum(root, roots.size - 1)] == v)) if roots.size else []
        if not len(ask):
            return logs
        root, u, w = root[ask], u[ask], w[ask]
        at, found, start = self.pairs.find(root, w)
        out = np.where(found, 0.0, self.left2[root] + logs[ask])
        out[found] = self.p2[at[found]]
        new = np.ones(u.size, bool)
        new[1:] = (root[1:] != root[:-1]) | (u[1:] != u[:-1])
        context, seen, _ = self.contexts.find(root[new], u[new])
        which = np.cumsum(new) - 1
        context, seen = context[which], seen[which]
        out[seen] += self.left3[context[seen]]
        both = np.flatnonzero(found & seen)
        if both.size:
            place, hit, _ = self.triples.find(context[both], at[both] - start[both])
            out[both[hit]] = self.p3[place[hit]]
        logs[ask] = out
        return logs
