"""Token counts: greedy longest-match word pieces counted by a linear automaton."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches

MAX_BYTES = 64 << 20  # of a vocabulary that is broadcast
MEMO_WORDS, MEMO_BYTES = 300_000, 64


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible character.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, take the
    characters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file in JSON; a leading space marks a word's start."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {token["content"] for token in data.get("added_tokens", [])}
    alphabet = byte_alphabet()
    pieces = [bytes(alphabet[c] for c in piece) for piece in data["model"]["vocab"] if piece not in special]
    if sum(map(len, pieces)) > MAX_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    return pieces


class Automaton:
    """A trie of pieces with failure links and the number of pieces each of them pops.

    A node stands for what has been read and not yet been given away. Where its text cannot be
    continued, the longest pieces at its front are popped: ``pops`` says how many, ``fail``
    which node stands for the rest. Both are known beforehand, so a word of n bytes takes at
    most 2n steps, and no piece is ever built. ``fail`` is -1 where the front is
    no piece: then the word as a whole is unknown and counts as one piece.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][byte]
            final[node] |= node != 0
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in self.next[node].items():
                queue.append(child)
                if final[child]:
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at != -1 and byte not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at] if at else -1
                if at != -1:
                    self.fail[child], self.pops[child] = self.next[at][byte], popped
        self.fail[0] = -1

    def count(self, word: bytes) -> int:
        """How many pieces greedy longest match cuts the word into; 1 if it cannot be cut."""
        following, fail, pops = self.next, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (child := following[node].get(byte)) is None:
                if fail[node] == -1:
                    return 1
                total += pops[node]
                node = fail[node]
            node = child
        while node:
            if fail[node] == -1:
                return 1
            total += pops[node]
            node = fail[node]
        return total


class Counts(dict):
    """Counts of words, remembered up to a bound."""

    def __init__(self, automaton: Automaton, lead: bytes):
        self.automaton, self.lead = automaton, lead

    def __missing__(self, word: bytes) -> int:
        value = self.automaton.count(self.lead + word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def count_tokens(
    docs: DataFrame, pieces: list[bytes], lead: bytes = b" ", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_bytes, longest)`` for every whole text.

    Words are runs without ASCII white space. Each is cut, with ``lead`` before it (as word
    starts are marked in the vocabulary), by greedy longest match over its bytes. ``longest`` is
    the largest number of pieces in a word. Null and blank texts have none; ids may be null and
    rows repeat; empty tables give empty tables; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))  # bounded by read_pieces

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shared.value, lead)
        for batch in batches:
            out = np.zeros((4, batch.num_rows), np.int64)
            for i, data in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = (data or b"").split()
                each = list(map(counts.__getitem__, words))
                out[:, i] = len(words), sum(each), len(data or b""), max(each, default=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_tokens", "n_bytes", "longest"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, n_tokens long, n_bytes long, longest long")
