"""SentencePiece encoding and decoding with merge-type models, checked against the library."""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches

SPACE = "▁"  # how a model writes a space
MAX_BYTES = 64 << 20  # of a model that is broadcast
MEMO_TEXTS, MEMO_CHARS = 2_000_000, 64  # some 400 MB in a worker
FEW, NEVER = 32, float("inf")
# Fixed values of the model format: field numbers and the numbers of piece types.
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2  # the model type that merges pairs of symbols


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of the fields of a message: whole numbers, else the raw bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class Memo(dict):
    """Results of a function for short texts, remembered up to a bound.

    The function also says whether a result is worth it: what is put together from remembered
    parts would only take the room of others.
    """

    def __init__(self, function: Callable[[str], tuple[bytes, bool]]):
        self.function = function

    def __missing__(self, text: str) -> bytes:
        result, whole = self.function(text)
        if whole and len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_TEXTS:
                self.clear()
            self[text] = result
        return result


class Model:
    """A vocabulary of scored pieces and the rules a text is prepared by.

    Models of other types, with normalisation rules, user-defined or unused symbols are refused
    with a ValueError: their results would not be those of merging alone.
    """

    def __init__(self, proto: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.costs: dict[str, float] = {}
        trainer, normalizer = {}, {}
        for field, value in _fields(proto):
            if field == PIECES:
                item = dict(_fields(value))
                piece, kind = item[1].decode(), item.get(3, NORMAL)
                if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                    raise ValueError(f"piece {piece!r} is user-defined or unused")
                if kind == NORMAL:
                    self.costs[piece] = -struct.unpack("<f", item[2])[0] if 2 in item else 0.0
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
            elif field == DENORMALIZER and dict(_fields(value)).get(2):
                raise ValueError("the model has rules for decoded texts")
        if trainer.get(3) != MERGES:
            raise ValueError("the model does not merge pairs of symbols")
        if trainer.get(24) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model changes texts before it splits them")
        self.prefix = bool(normalizer.get(3, 1))
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        written = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_ids = [written[f"<0x{b:02X}>"] for b in range(256)] if trainer.get(35) else None
        self.bytes = {i: bytes([int(p[3:5], 16)]) for p, i in written.items()}
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.marks = "".join({c for p in self.pairs for c in p if not c.isalnum() and c != SPACE})
        self.chunks = re.compile(self._pattern(), re.DOTALL).findall
        self.control = np.array(self.kinds) == CONTROL
        # Words behind one space and other stretches, the latter written with SPACE.
        self.words, self.inner = Memo(self.word), Memo(self.merged)
        self.single = self.prefix and not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def _surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return self.bytes[i]
        text = {CONTROL: "", UNKNOWN: self.unknown_text}.get(kind, self.pieces[i].replace(SPACE, " "))
        return text.encode()

    def _pattern(self) -> str:
        """Cuts a text where no merge can reach over: no piece holds both neighbours there."""
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return ".+"
        inner = set("".join(long)) - {SPACE}
        if not inner:
            return f"{SPACE}+|[^{SPACE}]"
        every = re.escape("".join(sorted(inner)))
        return f"{SPACE}*[{every}]+|{SPACE}+|[^{every}{SPACE}]"

    def merge(self, chunk: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece: best score first, then leftmost."""
        return self._merge_few(chunk) if len(chunk) <= FEW else self._merge_many(chunk)

    def _merge_few(self, chunk: str) -> list[str]:
        """The agenda is the costs of the pairs in their places; few enough to look through."""
        symbols, cost = list(chunk), self.costs.get
        agenda = [cost(a + b, NEVER) for a, b in zip(symbols, chunk[1:], strict=False)]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            symbols[i] = pair = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(pair + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + pair, NEVER)
        return symbols

    def _merge_many(self, chunk: str) -> list[str]:
        """The agenda is a heap of pairs by cost and place."""
        symbols: list[str | None] = list(chunk)
        n, costs = len(symbols), self.costs
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [
            (cost, i, i + 1, pair) for i in range(n - 1)
            if (cost := costs.get(pair := chunk[i : i + 2])) is not None
        ]
        heapify(agenda)
        while agenda:
            _, left, right, pair = heappop(agenda)
            a, b = symbols[left], symbols[right]
            # An entry is out of date once one of its symbols has grown or gone.
            if a is None or b is None or len(a) + len(b) != len(pair):
                continue
            symbols[left], symbols[right] = pair, None
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                joined = pair + symbols[following]
                if (cost := costs.get(joined)) is not None:
                    heappush(agenda, (cost, left, following, joined))
            if (first := before[left]) >= 0:
                joined = symbols[first] + pair
                if (cost := costs.get(joined)) is not None:
                    heappush(agenda, (cost, first, left, joined))
        return [s for s in symbols if s is not None]

    def merged(self, chunk: str) -> tuple[bytes, bool]:
        """The packed ids of a stretch that no merge reaches out of."""
        symbols = self.merge(chunk)
        ids = list(map(self.ids.get, symbols))
        if None in ids:
            ids = [x for s, known in zip(symbols, ids, strict=True) for x in ([known] if known is not None else self._spelt(s))]
        return struct.pack(f"<{len(ids)}I", *ids), True

    def word(self, word: str) -> tuple[bytes, bool]:
        """The packed ids of a word behind one space."""
        stem = word.rstrip(self.marks)
        if 0 < len(stem) < len(word) and word[len(stem) - 1 : len(stem) + 1] not in self.pairs:
            # No merge reaches from the stem to the marks behind it.
            return self.words[stem] + self.inner[word[len(stem) :]], False
        first, *rest = self.chunks(SPACE + word)
        if not rest:
            return self.merged(first)
        return self.words[first[1:]] + b"".join(map(self.inner.__getitem__, rest)), False

    def _spelt(self, symbol: str) -> list[int]:
        """The ids of a symbol without a piece."""
        return [self.unknown] if self.byte_ids is None else [self.byte_ids[b] for b in symbol.encode()]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, between those of begin and end."""
        parts: Iterable[bytes] = []
        if text and self.single and "  " not in text and SPACE not in text and text[0] != " ":
            parts = map(self.words.__getitem__, text.split(" "))
        elif text:
            written = text.replace(" ", SPACE)
            parts = map(self.inner.__getitem__, self.chunks(SPACE + written if self.prefix else written))
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        ids = np.frombuffer(b"".join([begin, *parts, end]), "<u4")
        if self.byte_ids is None:  # unknown characters side by side are one unknown piece
            again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            ids = ids[np.append(True, ~again)]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; a byte that belongs to no character becomes U+FFFD."""
        hidden = self.control[ids]
        shown = ids[~hidden].tolist()
        # The first piece that shows gives away the space put before the text.
        cut = self.prefix and bool(shown) and self.kinds[shown[0]] == NORMAL and self.pieces[shown[0]].startswith(SPACE)
        if hidden[1:-1].any():  # bytes form no character across a control piece
            text = self._decode_slowly(ids.tolist())
        else:
            try:
                text = b"".join(map(self.surface.__getitem__, shown)).decode()
            except UnicodeDecodeError:
                text = self._decode_slowly(shown)
        return text[1:] if cut else text

    def _decode_slowly(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for x in [*ids, None]:
            if x is not None and self.kinds[x] == BYTE:
                run += self.bytes[x]
                continue
            while run:
                size = next((s for s in (1, 2, 3, 4) if _is_character(run[:s])), 0)
                out.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            if x is not None:
                out.append(self.surface[x].decode())
        return "".join(out)


def _is_character(data: bytearray) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def read_model(path: str) -> bytes:
    """The model file's bytes; at most MAX_BYTES, as they are broadcast."""
    with open(path, "rb") as file:
        proto = file.read(MAX_BYTES + 1)
    if len(proto) > MAX_BYTES:
        raise ValueError("the model is too large to broadcast")
    Model(proto)  # refuses here, not in a task
    return proto


@lru_cache(maxsize=2)
def loaded(proto: bytes, library: bool) -> tuple[Model, object]:
    """One per Python worker, so its memo serves all its tasks."""
    if not library:
        return Model(proto), None
    import sentencepiece

    return Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)


def first_difference(library, texts: list[str], ids: list[np.ndarray], decoded: list[str]) -> int | None:
    """The first text that the library encodes or decodes otherwise."""
    expected = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    back = library.decode(expected, num_threads=1)
    rows = enumerate(zip(ids, expected, decoded, back, strict=True))
    return next((i for i, (a, b, c, d) in rows if c != d or a.tolist() != b), None)


def round_trip(
    docs: DataFrame, proto: bytes, check: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every whole text.

    ``ids`` holds the ids of the model in ``proto``, with begin and end, as packed little-endian
    unsigned 32-bit numbers; ``decoded`` is the text that these ids stand for. A text is cut where no piece of the vocabulary could reach over the
    cut; in each part adjacent symbols are merged by an agenda ordered by score and place.
    With ``check`` each Arrow batch is also encoded and decoded by the sentencepiece library,
    and a difference in any row ends the job with a ValueError.

    A null text counts as empty, which has only begin and end. Any characters may occur, those
    without a piece become byte pieces or the unknown piece. Texts may be of any length; ids may be null and
    keep their type; rows may repeat; an empty table gives an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(proto)  # bounded by read_model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, library = loaded(shared.value, check)
        gc.disable()  # nothing here is cyclic, and the collector would walk the memo again and again
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [model.encode(t) for t in texts]
            decoded = [model.decode(x) for x in ids]
            if library is not None and (i := first_difference(library, texts, ids, decoded)) is not None:
                raise ValueError(f"{doc_id} {batch.column(0)[i]}: not what the library gives")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.size for x in ids], pa.int64()),
                 pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"])
        gc.enable()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary, decoded string")
