"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs without white space, long ones cut at marks. The field tags each as the begin of a
secret, its inside or outside, from the token's shape, its neighbours' words and shapes and features
of the whole text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches

# The kinds in their order, their patterns and the least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "crf"]
LEAST = {"assign": 8, "access": 16, "hex": 32}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

OUT, BEGIN, INSIDE = 0, 1, 2
TOKEN = re.compile(r"\S+")
BITS = 14
MEMO_TOKENS, TOKEN_CHARS = 200_000, 64
_CUT = re.compile(  # up to the next mark between fields, else after the last mark within one, else anywhere
    r"[^D]{1,N}(?![^D])|[^D]{0,M}[=:/.+_-]|[^D]{1,N}|[D]{1,N}"
    .replace("D", r"&?;,|(){}<>\[\]").replace("N", str(TOKEN_CHARS)).replace("M", str(TOKEN_CHARS - 1)))


def base_spans(text: str, tokens: list[str] | None = None) -> list[tuple[int, int, str]]:
    """What the fixed patterns find, as (start, end, kind), ordered by start, then kind.

    Searches for parts that every match has come first; only texts with one are matched.
    ``tokens`` are the text's, if they are at hand.
    """
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if max(map(len, text.split() if tokens is None else tokens), default=0) >= LEAST["hex"]:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def cut(words: list[str]) -> list[str]:
    """The words, those over 64 characters in pieces of at most as many, so none of them is unseen."""
    if max(map(len, words), default=0) <= TOKEN_CHARS:
        return words
    return [p for word in words for p in ([word] if len(word) <= TOKEN_CHARS else _CUT.findall(word))]


class _Classes(dict):
    """Character classes: digit, upper and lower letter, some marks, all else."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = (
            "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else c if c in "=:'\"_-/+." else "x")
        return out


_CLASSES = _Classes()
_NAME = re.compile("pass|secret|token|key|akia|pwd|auth")


def look(token: str) -> tuple[str, str, str]:
    """All that features are made of: character classes, the last mark, a telling name.

    Few looks occur, however many different words there are.
    """
    # Most tokens are words of ASCII letters, whose class needs no look at each.
    if token.isascii() and token.isalpha() and (token.islower() or token[1:].islower()):
        classes = "l" * len(token) if token.islower() else "u" + "l" * (len(token) - 1)
    else:
        classes = token.translate(_CLASSES)
    low = token.lower()
    name = re.sub(r"[^a-z_]", "", low)[:20] if _NAME.search(low) else ""
    last = token[-1]
    return classes, "a" if last.isalnum() else last, name


def shape(classes: str) -> str:
    """Runs of the same class as one, cut to twelve."""
    return re.sub(r"(.)\1+", r"\1", classes)[:12]


def mixture(classes: str) -> str:
    """How letters and digits mix, and how long the token is."""
    switches = sum((a == "d") != (b == "d") for a, b in zip(classes, classes[1:], strict=False))
    return f"{min(classes.count('d'), 6)}|{min(classes.count('u'), 6)}|{min(switches, 6)}|{min(len(classes) // 4, 8)}"


def _slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % (1 << BITS)


_PAIR = struct.Struct("<QQ")


def word_ids(token: str) -> tuple[int, int]:
    """The word itself, as a feature of the token after it and of the one before it.

    Digests of 63 bits above the slots of all other features; marks around the word are left out.
    """
    word = token.lower().strip("\"'`=:,;.()[]{}<>*").encode("utf-8", "surrogatepass")
    after, before = _PAIR.unpack(hashlib.blake2b(word, digest_size=16).digest())
    return after >> 1 | 1 << BITS, before >> 1 | 1 << BITS


def token_features(classes: str, tail: str, name: str) -> list[list[str]]:
    """Features of a token for itself, for the one after it and for the one before it."""
    short = shape(classes)
    own = ["shape=" + short, "mix=" + mixture(classes), "long=" + str(min(len(classes) // 8, 6)), "name=" + name]
    after = ["before:name=" + name, "before:tail=" + tail, "before:shape=" + short[:3]]
    return [own, after, ["after:shape=" + short[:3]]]


def file_features(text: str) -> list[str]:
    """Features of the whole text: how many digits, assignments and quotes there are."""
    n = max(1, len(text))
    marks = sum(map(text.count, "={};"))
    return [
        f"file:marks={min(5, marks * 2000 // n)}", f"file:assigns={min(3, text.count('='))}",
        f"file:quotes={min(3, text.count(chr(34)))}",
    ]


class Rows(dict):
    """Rows of a table of three times three sums of weights: by token, and by its look.

    ``words`` gives each token the two rows of weights of the word itself, as one number.
    """

    def __init__(self, model: Model):
        self.weights = model.weights
        self.known = {int(x): (1 << BITS) + i for i, x in enumerate(model.words)}
        self.unknown = (len(self.weights) - 1) * (len(self.weights) + 1)
        self.words: dict[str, int] = {}
        self.table = np.zeros((1024, 3, 3), np.float64)
        self.looks: dict[tuple, int] = {}

    def __missing__(self, token: str) -> int:
        key = look(token)
        row = self.looks.get(key)
        if row is None:
            row = self.looks[key] = len(self.looks)
            if row >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for part, names in enumerate(token_features(*key)):
                self.table[row, part] = self.weights[[_slot(x) for x in names]].sum(axis=0)
        after, before = word_ids(token)
        # Most words are not near the sample's: they share one number.
        if after in self.known or before in self.known:
            none = len(self.weights) - 1
            self.words[token] = self.known.get(after, none) * len(self.weights) + self.known.get(before, none)
        else:
            self.words[token] = self.unknown
        self[token] = row
        return row

    def renew(self) -> None:
        """Between texts: forget all once there is too much to remember."""
        if len(self) > MEMO_TOKENS or len(self.looks) > MEMO_TOKENS:
            self.clear()
            self.looks.clear()
            self.words.clear()


@dataclass(frozen=True)
class Model:
    """Weights by feature and tag, transitions between tags, and those at the begin.

    Rows of weights are the slots of hashed features, then ``words``, then zeros for all other words.
    """

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    words: np.ndarray

    def emissions(self, tokens: list[str], text: str, rows: Rows) -> np.ndarray:
        at = np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))
        out = rows.table[at, 0]
        out[1:] += rows.table[at[:-1], 1]
        out[:-1] += rows.table[at[1:], 2]
        after, before = np.divmod(
            np.fromiter(map(rows.words.__getitem__, tokens), np.int64, len(tokens)), len(self.weights))
        out[1:] += self.weights[after[:-1]]
        out[:-1] += self.weights[before[1:]]
        return out + self.weights[[_slot(x) for x in file_features(text)]].sum(axis=0)


def viterbi(emissions: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags of one sequence."""
    n = len(emissions)
    back = np.zeros((n, 3), np.int8)
    score = first + emissions[0]
    for i in range(1, n):
        ways = score[:, None] + moves
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emissions[i]
    tags = np.zeros(n, np.int8)
    tags[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        tags[i - 1] = back[i, tags[i]]
    return tags


def decode(emissions: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags, without a step for each token.

    A tag can win at most ``bound`` through the transitions on its two sides. Where outside
    leads the other tags by more, it is in every best sequence, so the stretches between such
    tokens can be decoded on their own.
    """
    n = len(emissions)
    tags = np.zeros(n, np.int8)
    if not n:
        return tags
    start = first.max() - first[OUT]
    bound = 2 * (moves.max() - moves.min()) + max(0.0, start)
    open_ = np.flatnonzero(emissions[:, OUT] - emissions[:, 1:].max(axis=1) <= bound)
    if not open_.size:
        return tags
    cuts = np.flatnonzero(np.diff(open_) > 1) + 1
    for run in np.split(open_, cuts):
        a, b = int(run[0]), int(run[-1]) + 1
        before = first if a == 0 else moves[OUT]
        part = emissions[a:b].copy()
        if b < n:
            part[-1] += moves[:, OUT]
        tags[a:b] = viterbi(part, moves, before)
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[tuple[list[list[int]], np.ndarray]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4) -> Model:
    """Maximise the conditional likelihood by AdaGrad; gradients come from forward-backward.

    A sequence is the feature slots and word digests of each token and its tags. Without sequences all
    is outside.
    """
    every = np.unique(np.fromiter((x for slots_, _ in sequences for one in slots_ for x in one), np.int64))
    words = every[every >= 1 << BITS]
    w, m, f = np.zeros(((1 << BITS) + words.size + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    gw, gm, gf = np.full(w.shape, 1e-6), np.full(m.shape, 1e-6), np.full(f.shape, 1e-6)
    if not sequences:
        f[OUT] = m[:, OUT] = 50.0
        return Model(w, m, f, words)
    # Single words learn slower: one that stands by chance beside one secret must not explain it.
    rates = np.where(np.arange(len(w)) < 1 << BITS, rate, rate / 8)[:, None]
    eye = np.eye(3)
    for _ in range(epochs):
        for slots_, tags in sequences:
            n = len(tags)
            flat = np.concatenate([np.asarray(s, np.int64) for s in slots_])
            flat = np.where(flat < 1 << BITS, flat, (1 << BITS) + np.searchsorted(words, flat))
            owner = np.repeat(np.arange(n), [len(s) for s in slots_])
            e = np.zeros((n, 3))
            np.add.at(e, owner, w[flat])
            alpha, beta = np.zeros((n, 3)), np.zeros((n, 3))
            alpha[0] = f + e[0]
            for i in range(1, n):
                alpha[i] = _log_sum(alpha[i - 1][:, None] + m, 0) + e[i]
            for i in range(n - 2, -1, -1):
                beta[i] = _log_sum(m + (e[i + 1] + beta[i + 1])[None, :], 1)
            z = _log_sum(alpha[-1], 0)
            node = np.exp(alpha + beta - z)
            d = node - eye[tags]
            dm = np.zeros((3, 3))
            if n > 1:
                edge = np.exp(alpha[:-1, :, None] + m + (e[1:] + beta[1:])[:, None, :] - z)
                dm = edge.sum(axis=0)
                np.subtract.at(dm, (tags[:-1], tags[1:]), 1.0)
            used, place = np.unique(flat, return_inverse=True)
            dw = np.zeros((used.size, 3))
            np.add.at(dw, place, d[owner])
            dw += l2 * w[used]
            gw[used] += dw * dw
            w[used] -= rates[used] * dw / np.sqrt(gw[used])
            gm += dm * dm
            m -= rate * dm / np.sqrt(gm)
            df = d[0]
            gf += df * df
            f -= rate * df / np.sqrt(gf)
    return Model(w, m, f, words)


def places(text: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Where each of a text's tokens starts and ends."""
    out, at = [], 0
    for token in tokens:
        at = text.index(token, at)
        out.append((at, at + len(token)))
        at += len(token)
    return out


def tagged(text: str, window: int = 12) -> Iterator[tuple[list[list[int]], np.ndarray]]:
    """Stretches of tokens with tags: around what the patterns find, the longest others, the middle."""
    words = cut(TOKEN.findall(text))
    if not words:
        return
    tokens = places(text, words)
    own = [_slot(x) for x in file_features(text)]
    tags = np.zeros(len(tokens), np.int64)
    for start, end, _ in base_spans(text):
        inner = [i for i, (a, b) in enumerate(tokens) if a < end and b > start]
        for i in inner:
            tags[i] = INSIDE if tags[i] == INSIDE or i > inner[0] else BEGIN
    hits = np.flatnonzero(tags)
    others = sorted(np.flatnonzero(tags == OUT).tolist(), key=lambda i: -len(words[i]))[:2]
    middles = [*hits[:: max(1, len(hits) // 4)][:4].tolist(), *others, len(tokens) // 2]
    for middle in middles:
        a, b = max(0, middle - window), min(len(tokens), middle + window)
        slots_ = []
        for i in range(a, b):
            names = token_features(*look(words[i]))[0]
            names = names + (token_features(*look(words[i - 1]))[1] if i else [])
            names = names + (token_features(*look(words[i + 1]))[2] if i + 1 < len(words) else [])
            near = ([word_ids(words[i - 1])[0]] if i else []) + ([word_ids(words[i + 1])[1]] if i + 1 < len(words) else [])
            slots_.append([_slot(x) for x in names] + near + own)
        yield slots_, tags[a:b]


def train(
    docs: DataFrame, learn: Column | None = None, max_rows: int = 150, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """Fit on at most ``max_rows`` documents with a keyword or key prefix and as many of any kind.

    Matches of the patterns are the labels; the field learns what surrounds and shapes a
    secret, and what does not. The sample consists of the documents with the smallest hashes of
    id and text, and of at most seven stretches of 24 tokens from each: only those come to
    the driver. Null texts are not learnt from.
    """
    marks = F.col(text).rlike("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]") | F.col(text).contains("AKIA")
    rows = docs.where(F.col(text).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    order = F.xxhash64(F.col(doc_id), F.col(text))

    def bound(some: DataFrame) -> int | None:
        return some.select(order.alias("o")).orderBy("o").limit(max_rows).agg(F.max("o")).head()[0]

    every, marked = bound(rows), bound(rows.where(marks))
    if every is None:
        return fit([])
    chosen = order <= every
    if marked is not None:
        chosen |= (order <= marked) & marks

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                {"order": order, "slots": slots_, "tags": tags.tolist()}
                for order, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for slots_, tags in tagged(data)
            ]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("order", pa.int64()), ("slots", pa.list_(pa.list_(pa.int64()))), ("tags", pa.list_(pa.int32()))]))

    bounded_batches(docs.sparkSession)
    taken = rows.where(chosen).select(order.alias("order"), F.col(text).cast("string").alias("text")).distinct()
    sample = taken.mapInArrow(extract, "order long, slots array<array<bigint>>, tags array<int>").collect()
    sample.sort(key=lambda r: (r["order"], r["slots"], r["tags"]))
    return fit([(r["slots"], np.array(r["tags"])) for r in sample])


def beside(text: str, span: tuple[int, int, str], base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """The parts of a span between the base ones, without the white space around them."""
    start, end, kind = span
    for a, b, _ in [*(s for s in base if s[0] < end and s[1] > start), (end, end, "")]:
        part = text[start : max(start, a)]
        if any(map(str.isalnum, part)):
            at = start + len(part) - len(part.lstrip())
            yield at, at + len(part.strip()), kind
        start = max(start, b)


def added_spans(
    text: str, tokens: list[str], model: Model, rows: Rows, base: list[tuple[int, int, str]]
) -> list[tuple[int, int, str]]:
    """Spans the field finds beside the base ones: what of them is outside, if it has a letter or digit."""
    if not tokens:
        return []
    rows.renew()
    tags = decode(model.emissions(tokens, text, rows), model.moves, model.first)
    if not tags.any():
        return []
    out: list[tuple[int, int, str]] = []
    previous = OUT
    for (start, end), tag in zip(places(text, tokens), tags.tolist(), strict=True):
        if tag == BEGIN or (tag == INSIDE and previous == OUT):
            out.append((start, end, "crf"))
        elif tag == INSIDE:
            out[-1] = (out[-1][0], end, "crf")
        previous = tag
    return [rest for s in out for rest in beside(text, s, base)]


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for every whole text; a span is ``(kind, start, end)`` in code points.

    Spans are ordered by start, then by kind: assign, access, hex, crf. Null and blank texts have
    none. Ids may be null and rows repeat; empty tables give empty tables; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^14 rows of weights and those of words near the sample's

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = shared.value
        rows = Rows(model_)
        for batch in batches:
            found = []
            for data in batch.column(1).to_pylist():
                text_ = data or ""
                tokens = text_.split()
                base = base_spans(text_, tokens)
                every = base + added_spans(text_, cut(tokens), model_, rows, base)
                every.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in every])
            spans = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")
