"""SentencePiece encoding and decoding against the library, merging against a plain loop."""

import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece

from murmur.llm import pieces
from murmur.llm.queries import QUERIES, TOKENIZERS, table

SF = "/root/testdata/sf0.001"
PROTO = pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
MODEL = pieces.Model(PROTO)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
CHARACTERS = "  ▁▁aAbe.,'\n\t\0é執ñ€😀​�\xa0<s></s><0x41>the ing"


def random_text(rng, most=40):
    def character():
        if rng.random() < 0.8:
            return rng.choice(CHARACTERS)
        return chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x400, 0x500), rng.randrange(0x4E00, 0x9000)]))

    return "".join(character() for _ in range(rng.randrange(most)))


def test_any_text_is_encoded_as_by_the_library():
    rng = random.Random(1)
    for _ in range(5000):
        text = random_text(rng)
        ids = MODEL.encode(text)
        assert ids.tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True), text
        assert MODEL.decode(ids) == LIBRARY.decode(ids.tolist()) == text.replace("▁", " ")


def test_any_ids_are_decoded_as_by_the_library():
    rng = random.Random(2)
    kinds = [lambda: rng.randrange(3), lambda: rng.randrange(3, 259), lambda: rng.randrange(131, 250),
             lambda: rng.randrange(259, 32000), lambda: rng.choice([259, 260, 29871])]
    for _ in range(20000):
        ids = [rng.choice(kinds)() for _ in range(rng.randrange(9))]
        assert MODEL.decode(np.array(ids, "<u4")) == LIBRARY.decode(ids), ids


def test_agenda_merges_the_best_pair_first():
    rng = random.Random(3)
    for _ in range(300):
        chunk = random_text(rng, 60).replace(" ", "▁")
        symbols = list(chunk)
        while True:
            pairs = [(MODEL.costs[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in MODEL.costs]
            if not pairs:
                break
            i = min(pairs)[1]
            symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
        assert MODEL.merge(chunk) == MODEL._merge_few(chunk) == MODEL._merge_many(chunk) == symbols


def test_long_texts_without_a_cut():
    for text in ("ab" * 100_000, "x" * 100_000, "▁" * 50_000, "漢" * 50_000, " " * 30_001):
        assert MODEL.encode(text).tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)


def _field(number, value):
    if isinstance(value, int):
        return bytes([*_varint(number << 3), *_varint(value)])
    return bytes([*_varint(number << 3 | 2), *_varint(len(value))]) + value


def _varint(n):
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return [*out, n]


def own_model(*pieces_, trainer=(), normalizer=((3, 1), (4, 0), (5, 1))):
    items = b"".join(
        _field(1, _field(1, p.encode()) + b"\x15" + struct.pack("<f", score) + _field(3, kind)) for p, score, kind in pieces_)
    rules = {3: 2, **dict(trainer)}
    return items + _field(2, b"".join(_field(k, v) for k, v in rules.items())) + _field(3, b"".join(_field(k, v) for k, v in normalizer))


BASE = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -5, 1), ("a", -6, 1), ("b", -7, 1)]


def test_other_vocabularies(spark):
    # No byte pieces, a tie of scores, a piece with a space inside, no space before the text.
    for extra, normalizer in (
        ([("ab", -1, 1), ("ba", -1, 1), ("▁a", -2, 1)], ((3, 1), (4, 0), (5, 1))),
        ([("a▁", -1, 1), ("a▁b", -2, 1), ("bb", -3, 1)], ((3, 0), (4, 0), (5, 1))),
        ([(".", -8, 1), ("a.", -1, 1), (".a", -2, 1), ("..", -3, 1)], ((3, 1), (4, 0), (5, 1))),
        ([(".", -8, 1), (".a", -1, 1), ("..", -2, 1), ("▁.", -3, 1), ("ab", -4, 1)], ((3, 1), (4, 0), (5, 1))),
    ):
        proto = own_model(*BASE, *extra, normalizer=normalizer)
        model, library = pieces.Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
        rng = random.Random(4)
        for _ in range(500):
            text = "".join(rng.choice("aabb..  é") for _ in range(rng.randrange(12)))
            ids = model.encode(text)
            assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
            assert model.decode(ids) == library.decode(ids.tolist()), text


@pytest.mark.parametrize("proto", [
    own_model(*BASE, ("x", 0, 4)), own_model(*BASE, ("x", 0, 5)), own_model(*BASE, trainer=((3, 1),)),
    own_model(*BASE, normalizer=((3, 1), (4, 1), (5, 1))), own_model(*BASE, normalizer=((2, b"x"), (4, 0))),
])
def test_models_with_other_rules_are_refused(proto):
    with pytest.raises(ValueError):
        pieces.Model(proto)


def test_edge_cases(spark):
    rows = [(1, None, 0), (None, "", 0), (2, " a", 5), (2, " a", 5), (3, "\0é漢", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    for check in (True, False):
        got = pieces.round_trip(docs, PROTO, check).collect()
        assert [(r["doc_id"], r["decoded"]) for r in got] == [(r[0], r[1] or "") for r in rows]
        assert [bytes(r["ids"]) for r in got[:2]] == [struct.pack("<2I", 1, 2)] * 2
        assert [r["n_tokens"] for r in got] == [len(r["ids"]) // 4 for r in got]
    assert pieces.round_trip(docs.limit(0), PROTO).collect() == []


def test_the_first_difference_from_the_library_is_found():
    texts = ["the", "one", "the one"]
    ids = [MODEL.encode(t) for t in texts]
    assert pieces.first_difference(LIBRARY, texts, ids, texts) is None
    assert pieces.first_difference(LIBRARY, texts, [ids[0], ids[0], ids[2]], texts) == 1
    assert pieces.first_difference(LIBRARY, texts, ids, ["the", "one", "the  one"]) == 2
    assert pieces.first_difference(LIBRARY, [], [], []) is None


def test_registered_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_sentencepiece"].run(spark, SF).collect()}
    expected = {}
    for r in table(spark, SF, "documents").collect():
        ids = LIBRARY.encode(r["text"] or "", add_bos=True, add_eos=True)
        packed, back = struct.pack(f"<{len(ids)}I", *ids), LIBRARY.decode(ids).encode()
        expected[r["doc_id"]] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
    assert got == expected
