"""Decontamination, secrets, URLs, toxicity and token counts against plain versions."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from murmur.llm import decontaminate, secrets, token_counts, toxicity, urls
from murmur.llm.queries import URL_RULES

DOCS = "doc_id long, text string, hash long, items string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


# --- decontamination ---------------------------------------------------------------------------

def slow_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_report(text, items, size):
    words = slow_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        w = slow_words(item_text)
        for window in [w[i : i + size] for i in range(max(1, len(w) - size + 1))] if w else []:
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.fixture
def contaminated():
    rng = random.Random(1)
    name = lambda: rng.choice(["Ärger", "be", "cat", "D0g", "eel", "éclair"])
    items = [(i, " ".join(name() for _ in range(rng.randrange(1, 9)))) for i in range(8)]
    items += [(20, None), (21, "--"), (22, items[0][1]), (23, "Rare-words, only here: one two three four")]
    rows = [(i, ", ".join(name() for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "x " + "rare WORDS only here one two; three four " * 3), (None, "rare words only here one two")]
    rows += [rows[3], (3, "another text"), (104, "rare words only here one " * 400)]
    return rows, items


@pytest.mark.parametrize(("size", "broadcast"), [(4, True), (4, False), (1, True), (10, True)])
def test_hits_against_brute_force(spark, monkeypatch, contaminated, size, broadcast):
    rows, items = contaminated
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs_of(spark, rows), bench, size).select("doc_id", "n_words", "n_hit", "items").collect()
    want = [(i, *slow_report(t, items, size)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_documents_and_spans_are_removed(spark, contaminated):
    rows, items = contaminated
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.remove_documents(docs, bench, 4).select("doc_id", "text").collect()
    clean = [r for r in rows if not slow_report(r[1], items, 4)[1]]
    assert sorted(map(tuple, kept), key=repr) == sorted(clean, key=repr) and 3 < len(clean) < len(rows)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench, 4).where("doc_id >= 100").collect()}
    assert cut[102] == "x" and cut[100] is None and cut[101] == ""


@pytest.mark.parametrize("small", [True, False])
def test_windows_across_the_blocks_of_a_long_text(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    block, text = decontaminate.BLOCK, [f"w{i}" for i in range(5 * decontaminate.BLOCK + 3)]
    starts = [0, block - 9, block - 1, block, 2 * block - 5, 3 * block + 1, len(text) - 10]
    items = [(i, " ".join(text[s : s + 10])) for i, s in enumerate(starts)] + [(90, f"w{block - 1} w{block}"), (91, "w3 w5")]
    rows = [(1, " ".join(text)), (2, " ".join(text[: block + 1])), (3, ""), (4, None)]
    got = decontaminate.report(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 10)
    got = {r["doc_id"]: r for r in got.collect()}
    spans = sorted({(s, s + 10) for s in starts} | {(block - 1, block + 1)})
    assert [tuple(s) for s in got[1]["spans"]] == spans
    assert got[1]["n_words"] == len(text) and got[1]["n_hit"] == len({p for a, b in spans for p in range(a, b)})
    assert [tuple(s) for s in got[2]["spans"]] == [(0, 10), (block - 9, block + 1), (block - 1, block + 1)]
    assert got[3]["n_words"] == got[4]["n_words"] == 0 and not got[3]["spans"]


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(none, bench).collect() == []
    row = decontaminate.report(docs_of(spark, [(1, "a b")]), bench).first()
    assert tuple(row)[:3] == (1, 2, 0)
    assert decontaminate.remove_documents(docs_of(spark, [(1, "a b")]), bench).count() == 1


# --- secrets -----------------------------------------------------------------------------------

SECRET_TEXTS = [
    (None, []), ("", []), ("no secret here", []), ("password=abc", []), ("PassWord: abcdefgh", ["assign:0:18"]),
    ("my api_key='0123456789' and apikey = x1234567", ["assign:3:22", "assign:28:45"]),
    ("é token=12345678", ["assign:2:16"]), ("ſecret=12345678", []), ("AKIA123456789012 AKIA12", ["access:0:16"]),
    ("0" * 31 + " " + "a" * 32, ["hex:32:64"]), ("x" + "f" * 40 + "g", ["hex:1:41"]),
    ("token=" + "0" * 32, ["assign:0:38", "hex:6:38"]), ("secret=short token=123456789", ["assign:13:28"]),
    ("AKIA" + "0" * 40, ["access:0:44", "hex:4:44"]),
]


@pytest.mark.parametrize(("text", "spans"), SECRET_TEXTS)
def test_patterns(text, spans):
    assert [f"{k}:{a}:{b}" for a, b, k in secrets.base_spans(text or "")] == spans


def test_forward_backward_learns_and_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        e, moves, first = rng.normal(size=(n, 3)) * 4, rng.normal(size=(3, 3)), rng.normal(size=3)
        e[:, 0] += rng.choice([0, 12], size=n)
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)

        def value(p, e=e, moves=moves, first=first):
            return first[p[0]] + e[range(len(p)), p].sum() + moves[p[:-1], p[1:]].sum()

        best = max(value(p) for p in paths)
        assert value(secrets.viterbi(e, moves, first)) == pytest.approx(best)
        assert value(secrets.decode(e, moves, first)) == pytest.approx(best)
    assert secrets.decode(np.zeros((0, 3)), np.zeros((3, 3)), np.zeros(3)).size == 0


def secret_docs(n=80):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(40)]
        if i % 2:
            words[20] = rng.choice(["password=", "token="]) + "".join(rng.choice("0123456789abcdef") for _ in range(18))
        rows.append((i, " ".join(words)))
    return rows


def test_field_adds_spans_and_keeps_base_ones(spark):
    rows = secret_docs()
    model = secrets.train(docs_of(spark, rows), max_rows=60)
    unseen = [(500, "ab cd credential=7d602ad27cf5550de1c ef gh"), (501, "ab cd ef gh"), (502, None), (None, rows[1][1]), *rows]
    got = secrets.scan(docs_of(spark, unseen), model).collect()
    by_id = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got}
    assert by_id[500] == [("crf", 6, 36)]
    assert by_id[501] == by_id[502] == [] and len(got) == len(unseen)
    for i, text in rows:
        base = [(k, a, b) for a, b, k in secrets.base_spans(text)]
        assert [s for s in by_id[i] if s[0] != "crf"] == base and by_id[i] == base
    assert by_id[None] == by_id[1]


def test_secrets_behind_the_64th_character_are_seen(spark):
    model = secrets.train(docs_of(spark, secret_docs()), max_rows=60)
    secret = "credential=7d602ad27cf5550de1c"
    long = ["abcdefgh/" * 9 + "&", "{abcd:ef," + "gh:abcdefgh," * 8, "abcdefgh" * 9 + "?"]
    rows = [(i, f"ab cd {x}{secret} ef gh") for i, x in enumerate(long)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs_of(spark, rows), model).collect()}
    for i, text in rows:
        at = text.index(secret)
        assert ("crf", at, at + len(secret)) in [(s["kind"], s["start"], s["end"]) for s in got[i]]


@pytest.mark.parametrize("word", ["a" * 64, "a" * 65, "&" * 200, "a=b&" * 50, "a/" * 300 + "b" * 200, "é" * 100 + "?x"])
def test_long_tokens_are_cut_without_losing_characters(word):
    pieces = secrets.cut(["ab", word])
    assert "".join(pieces) == "ab" + word and max(map(len, pieces)) <= 64
    assert (len(pieces) == 2) == (len(word) <= 64)


def test_words_beside_a_secret_are_features():
    rng = random.Random(5)
    hidden = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(60)]
    sequences, words = [], ["bearer", "banana"]
    for i, x in enumerate(hidden):  # only the word before tells a secret from others of its look
        tokens = ["of", words[i % 2], x, "to"]
        names = [secrets.token_features(*secrets.look(t)) for t in tokens]
        slots = [[secrets._slot(f) for f in n[0]] for n in names]
        for k in range(4):
            slots[k] += [secrets.word_ids(tokens[k - 1])[0]] * (k > 0) + ([secrets.word_ids(tokens[k + 1])[1]] if k < 3 else [])
        sequences.append((slots, np.array([0, 0, 1 - i % 2, 0])))
    model = secrets.fit(sequences)
    for word, spans in (("Bearer", [(10, 16, "crf")]), ("banana", []), ("unseen", None)):
        text = f"of {word} badcef to"
        tokens = text.split()
        found = secrets.added_spans(text, tokens, model, secrets.Rows(model), [])
        assert spans is None or found == spans


@pytest.mark.parametrize(("text", "span", "base", "rest"), [
    ('password="correcthorse!battery#staple"', (0, 38), [(0, 22)], [(22, 38)]),
    ("token=0123456789,", (0, 17), [(0, 16)], []), ("a1 b2", (0, 5), [(0, 2)], [(3, 5)]),
    ("x1:AAAA:y1:BBBB:z1", (0, 18), [(3, 7), (4, 6), (11, 15)], [(0, 3), (7, 11), (15, 18)]),
    ("ab cd", (0, 5), [], [(0, 5)]), ("ab cd", (0, 2), [(3, 5)], [(0, 2)]),
])
def test_added_spans_keep_what_lies_beside_base_spans(text, span, base, rest):
    got = secrets.beside(text, (*span, "crf"), [(*b, "assign") for b in base])
    assert [s[:2] for s in got] == rest


def test_nothing_to_learn_secrets_from(spark):
    empty = spark.createDataFrame([], DOCS)
    model = secrets.train(empty)
    assert secrets.scan(empty, model).collect() == []
    assert secrets.scan(docs_of(spark, [(1, "a b AKIA0123456789AB")]), model).first()["spans"][0]["kind"] == "access"


# --- URLs --------------------------------------------------------------------------------------

PAGES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"), ("https://example.net/en/1?q#f", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://EXAMPLE.net/EN/1", "example.net", "/EN/1", "net/", "block"), ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("http://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, "allow"), ("http://a.net?x=/", "a.net", "", None, "allow"), ("http://a.net#/y", "a.net", "", None, "allow"),
    ("no scheme/net/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("x://://net/", ":", "//net/", None, "allow"), ("http://net/", "net", "/", "net/", "block"), ("http://É.net/é", "É.net", "/é", "net/", "block"),
    ("http://" + "a." * 300 + "net/" + "p" * 3000, "a." * 300 + "net", "/" + "p" * 3000, "net/", "block"),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    rows = [(i, p[0], "rule") for i, p in enumerate(PAGES)] + [(0, PAGES[0][0], "again"), (None, PAGES[1][0], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = sorted(map(tuple, urls.judge(pages, urls.rules_table(spark, URL_RULES)).collect()), key=repr)
    want = [(i, *p[1:]) for i, p in enumerate(PAGES)] + [(0, *PAGES[0][1:]), (None, *PAGES[1][1:])]
    assert got == sorted(want, key=repr)


def test_rule_precedence_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/d/e")], "page_id long, url string")
    rules = [("c", "/d/e", "block"), ("b.c", "/d", "allow"), ("b.c", "/d", "block"), (None, "/d/e", "allow")]
    assert urls.judge(pages, urls.rules_table(spark, rules)).first()["verdict"] == "block"
    none = urls.judge(pages, urls.rules_table(spark, rules).limit(0), default="review").first()
    assert (none["rule"], none["verdict"]) == (None, "review")
    assert urls.judge(pages.limit(0), urls.rules_table(spark, rules)).collect() == []


# --- toxicity ----------------------------------------------------------------------------------

def toxic_rows(n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["tree", "river", "stone", "cloud", "bird"]) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot,", "MORON", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic, 0.5))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = toxic_rows()
    truth = {i: t for i, t, _ in labels}
    docs = docs_of(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 0.1), (9999, None, 0.2)], "doc_id long, toxic int, score double")
    model = toxicity.train(docs, table, F.crc32(F.col("_id").cast("string")) % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(unseen) > 80
    assert sum((got[i] >= 0.5) == truth[i] for i in unseen) / len(unseen) > 0.97
    assert model.index.size < 2000
    kept = {r["doc_id"] for r in toxicity.reject(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    edge = [(1, None), (2, ""), (None, "idiot"), (1, None), (4, "tree1 " * 30_000 + "idiot")]
    scores = [r["score"] for r in toxicity.score(docs_of(spark, edge), model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(docs_of(spark, rows).limit(0), model).collect() == []


def test_no_labels(spark):
    model = toxicity.train(docs_of(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs_of(spark, [(1, "a")]), model).first()["score"] == 0.5


def test_features_are_words_pairs_and_skips():
    memo = toxicity.WordHashes()
    assert toxicity.features(None, memo).size == toxicity.features(b" ,;", memo).size == 0
    assert toxicity.features(b"One", memo).tolist() == toxicity.features(b"one!", memo).tolist()
    assert toxicity.features(b"a b c", memo).size == 3 + 2 + 1


def slow_features(text, bits=toxicity.BITS):
    """Features by plain numbers: each word, pair and pair with a word skipped, mixed in 64 bits."""
    kept = "".join(c.lower() if c.isascii() and c.isupper() else c if c.isalnum() or ord(c) > 127 else " " for c in text)
    h = [xxhash.xxh32_intdigest(w.encode()) for w in kept.split(" ") if w]
    every = [x * 0x165667B1 for x in h]
    every += [a * 0x9E3779B1 + b * 0x85EBCA77 + 1 for a, b in zip(h, h[1:], strict=False)]
    every += [a * 0xC2B2AE3D + b * 0x27D4EB2F + 2 for a, b in zip(h, h[2:], strict=False)]
    return sorted({(x % 2**64 ^ x % 2**64 >> 29) % 2**bits for x in every})


def slow_fit(rows, alpha=2.0, beta=1.0, l1=4.0, l2=0.1, epochs=3):
    """The same learning rule with one dictionary entry for each coordinate."""
    z, n = {}, {}

    def weight(i):
        hold = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0.0)) <= hold:
            return 0.0
        return -(z[i] - math.copysign(hold, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for active, label in rows:
            w = {i: weight(i) for i in [*active, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i, old in w.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * old
                n[i] = before + g * g
    every = {i: weight(i) for i in z}
    return {i: w for i, w in every.items() if w or i == "bias"}


@pytest.mark.parametrize("text", ["", "a", "One two", "It's ÉTÉ, l'été - x1 Y2\tz\n3", "a b a b a b", "é😀 ß"])
def test_features_against_plain_numbers(text):
    assert toxicity.features(text.encode(), toxicity.WordHashes()).tolist() == slow_features(text)


def test_fit_against_dictionaries(spark):
    rows, labels = toxic_rows(200)
    truth = {i: t for i, t, _ in labels}
    order = spark.createDataFrame(rows, "_id long, text string").orderBy(F.xxhash64("_id"), "_id").collect()
    want = slow_fit([(slow_features(r["text"]), truth[r["_id"]]) for r in order])
    model = toxicity.train(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, score double"))
    assert model.bias == pytest.approx(want.pop("bias"))
    got = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    assert len(want) > 5 and got == pytest.approx(want, rel=1e-5)


def test_the_fitting_task_reads_a_stream():
    """Rows are taken one at a time, so a sample of any size is learnt from without being held."""
    rows = [(np.array([i % 7, 7 + i % 5], np.int32), int(i % 7 == 3)) for i in range(400)]
    alive, most = [0], [0]

    class Row(tuple):
        def __new__(cls, *values):
            alive[0] += 1
            most[0] = max(most[0], alive[0])
            return super().__new__(cls, values)

        def __del__(self):
            alive[0] -= 1

    streamed = toxicity.fit((Row(*r) for _ in range(toxicity.EPOCHS) for r in rows), bits=8, epochs=1)
    whole = toxicity.fit(rows, bits=8)
    assert most[0] <= 2
    assert streamed.index.tolist() == whole.index.tolist() and streamed.weight.tolist() == whole.weight.tolist()
    assert streamed.bias == whole.bias


def test_scored_tables_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (None, None, "y")], "doc_id long, text string, _scored string")
    model = toxicity.fit([])
    got = toxicity.score(docs, model, keep=["_scored"]).collect()
    assert sorted((r["_scored"], r["score"]) for r in got) == [("x", 0.5), ("y", 0.5)]
    assert toxicity.reject(docs, model, threshold=0.6).count() == 2
    assert toxicity.reject(docs.limit(0), model).columns == docs.columns


# --- token counts ------------------------------------------------------------------------------

def slow_count(word, pieces):
    total = 0
    while word:
        n = next((n for n in range(len(word), 0, -1) if word[:n] in pieces), None)
        if n is None:
            return 1
        word, total = word[n:], total + 1
    return total


def test_automaton_is_greedy_longest_match():
    rng = random.Random(6)
    for _ in range(60):
        pieces = {bytes(rng.choices(b"abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        machine = token_counts.Automaton(pieces)
        for _ in range(60):
            word = bytes(rng.choices(b"abc", k=rng.randrange(0, 14)))
            assert machine.count(word) == slow_count(word, pieces), (pieces, word)


def test_token_counts_with_a_public_vocabulary(spark):
    pieces = token_counts.read_pieces("/opt/tokenizers/byte_bpe_50k.json")
    known = set(pieces)
    assert len(known) > 50_000 and all(bytes([b]) in known for b in range(256))
    rows = [(1, "Hello wörld  日本\tunbelievable"), (2, None), (3, " \n"), (None, "a"), (1, "a"), (5, "x" * 20_000), (6, "q1 " * 5000)]
    got = [tuple(r)[:4] for r in token_counts.count_tokens(docs_of(spark, rows), pieces).collect()]
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        want.append((i, len(words), sum(slow_count(b" " + w, known) for w in words) if len(words) < 5000
                     else 5000 * slow_count(b" q1", known), len((text or "").encode())))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(docs_of(spark, rows).limit(0), pieces).collect() == []


def test_classes_of_plain_words_and_numbers_of_unknown_ones():
    """Short ways give what the long ones do; words far from the sample share one number."""
    for token in ["abc", "Abc", "ABC", "aBc", "A", "a", "é", "Éa", "straße", "a1", "x=y", "Token:", "ǅa", "ªb", "aª"]:
        assert secrets.look(token)[0] == token.translate(secrets._CLASSES)
    after, before = secrets.word_ids("near,")
    model = secrets.Model(np.zeros(((1 << secrets.BITS) + 2, 3)), np.zeros((3, 3)), np.zeros(3), np.array([after]))
    rows = secrets.Rows(model)
    for token in ("far", "off.", "near"):
        rows[token]
    none, known = len(model.weights) - 1, 1 << secrets.BITS
    assert rows.words["far"] is rows.words["off."] and rows.words["far"] == none * len(model.weights) + none
    assert rows.words["near"] == known * len(model.weights) + none
