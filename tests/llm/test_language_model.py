"""Elias-Fano sequences, the trie and the scores against plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import lm
from murmur.llm.elias_fano import EliasFano, Quantised, Ranges, Trie


def mapped(*levels, image):
    parts = iter(image)
    for level in levels:
        level.mapped(lambda: next(parts))
    return levels


@pytest.mark.parametrize("values", [
    [], [0], [5], [0, 0, 0], [0, 1, 2, 3], [7, 7, 900, 900, 901, 10**12], list(range(0, 100_000, 37)),
    sorted(random.Random(1).choices(range(10**6), k=3000)),
])
def test_sequences_give_back_their_values(values):
    image = []
    (level,) = mapped(EliasFano(np.array(values, np.int64), image), image=image)
    assert level.access(np.arange(len(values))).tolist() == values
    for first, end in ((0, len(values)), (1, 3), (2, 2), (len(values) // 2, len(values))):
        end = min(end, len(values))
        assert level.window(first, end).tolist() == values[first:end]


def test_sequences_are_compact():
    image = []
    values = np.sort(np.random.default_rng(0).integers(0, 10**9, 100_000))
    EliasFano(values, image)
    bits = 8 * sum(x.nbytes for x in image) / values.size
    assert bits < 3 + math.log2(10**9 / values.size)


def test_successor_search_stays_in_its_context():
    rng = random.Random(2)
    ranges = [sorted(rng.sample(range(50), rng.randrange(0, 9))) for _ in range(200)]
    start = np.cumsum([0, *map(len, ranges)])
    image = []
    (level,) = mapped(Ranges(start, np.array([x for r in ranges for x in r]), image), image=image)
    asked = sorted((rng.randrange(200), rng.randrange(60)) for _ in range(2000))
    place, found, begin = level.find(*(np.array(x) for x in zip(*asked, strict=True)))
    for (context, value), p, f, b in zip(asked, place, found, begin, strict=True):
        assert f == (value in ranges[context]) and b == start[context]
        assert not f or p == start[context] + ranges[context].index(value)


def test_quantised_logarithms_are_near():
    image = []
    logs = np.random.default_rng(0).uniform(-9, 0, 1000)
    (level,) = mapped(Quantised(logs, image), image=image)
    assert image[0].dtype == np.uint8
    assert np.abs(level[np.arange(1000)] - logs).max() <= 9 / 255 / 2 + 1e-9


def slow_model(counts, unigram, discount):
    """Interpolated absolute discounting over three words, from a counter of (u, v, w)."""
    pairs, after1, after2 = Counter(), defaultdict(Counter), defaultdict(Counter)
    for (u, v, w), n in counts.items():
        pairs[v, w] += n
        after1[v][w] += n
        after2[u, v][w] += n

    def level(seen, w, lower):
        total = sum(seen.values())
        return max(seen[w] - discount, 0) / total + discount * len(seen) / total * lower if total else lower

    return lambda u, v, w: level(after2[u, v], w, level(after1[v], w, unigram[w]))


def test_trie_agrees_with_dictionaries():
    rng = random.Random(4)
    counts = Counter(tuple(rng.choices(range(3, 15), k=3)) for _ in range(900))
    unigram = np.full(20, 0.05)
    rows = sorted((v, u, w, n) for (u, v, w), n in counts.items())
    v, u, w, n = (np.array(x) for x in zip(*rows, strict=True))
    key, place = np.unique(v * 100 + w, return_inverse=True)
    trie = Trie(u, v, w, n.astype(float), key // 100, key % 100, np.bincount(place, n), place, unigram, 0.75)
    asked = sorted((v, u, w) for v in range(2, 17) for u in range(2, 17) for w in range(2, 17))
    qv, qu, qw = (np.array(x) for x in zip(*asked, strict=True))
    want = slow_model(counts, unigram, 0.75)
    got = trie.log10(qu, qv, qw)
    error = [abs(g - math.log10(want(a, b, c))) for (b, a, c), g in zip(asked, got, strict=True)]
    assert max(error) < 0.03
    assert abs(sum(10 ** trie.log10(np.full(12, 5), np.full(12, 6), np.arange(3, 15)))
               + 8 * 10 ** trie.log10(np.array([5]), np.array([6]), np.array([19]))[0] - 1) < 0.05


def texts(n=120, seed=3):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(60)] + ["x" * 80]
    return [
        (i, " ".join(rng.choices(names, weights=[1 / (j + 1) for j in range(61)], k=rng.randrange(1, 60))) + f" Only{i % 40}")
        for i in range(n)
    ]


def slow_scores(rows, learn, head_words, discount=0.75):
    tokens = {i: [t.lower() for t in (text or "").split()] for i, text in enumerate(t for _, t in rows)}
    c = Counter(t for i, ts in tokens.items() if learn[i] for t in [*ts, None])
    n, v = sum(c.values()), len(c)
    whole = n + 0.1 * (v + 1)
    usable = [t for t in c if t is not None and len(t) <= 64]
    frequent = sorted(usable, key=lambda t: (-c[t], t))
    steps = [math.floor(math.log2(c[t]) * lm.GRAINS) for t in frequent]
    cut = next((s for s in sorted(set(steps)) if sum(x >= s for x in steps) <= head_words), None)
    head = {t: k + 3 for k, t in enumerate(t for t, s in zip(frequent, steps, strict=True) if cut is not None and s >= cut)}
    rare = n - sum(c[t] for t in head) - c[None]
    rare_mass = rare + 0.1 * (v - len(head) - (c[None] > 0) + 1)
    unigram = defaultdict(float, {k: (c[t] + 0.1) / whole for t, k in head.items()} | {1: (c[None] + 0.1) / whole, 2: rare_mass / whole})
    triples = {i: [] for i in tokens}
    for i, ts in tokens.items():
        row = [0, 0, *(head.get(t, 2) for t in ts), 1]
        triples[i] = list(zip(row, row[1:], row[2:], strict=False))
    model = slow_model(Counter(t for i in tokens if learn[i] for t in triples[i]), unigram, discount)
    for i, ts in tokens.items():
        base = sum(math.log10((c[t] + 0.1) / whole) for t in [*ts, None])
        score = sum(math.log10(model(*t)) for t in triples[i])
        score += sum(math.log10((c[t] + 0.1) / rare_mass) for t in ts if t not in head)
        yield rows[i][0], not learn[i], len(ts) + 1, sum(c[t] > 0 for t in [*ts, None]), n, base, score


@pytest.mark.parametrize(("head_words", "shard_tokens"), [(lm.HEAD_WORDS, 10**6), (20, 10**6), (20, 200), (1, 60)])
def test_scores_against_dictionaries(spark, monkeypatch, head_words, shard_tokens):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    rows = [*texts(), (500, None), (501, "  "), (None, "w1 w2"), (7, "w1 w1 w1"), (502, "w1 w0 " * 200), (503, "Ärger w1")]
    learn = [i is None or i % 4 != 0 for i, _ in rows]
    docs = spark.createDataFrame([(*r, x) for r, x in zip(rows, learn, strict=True)], "doc_id long, text string, learn boolean")
    found = lm.score_documents(docs, F.col("learn"), head_words=head_words, shard_tokens=shard_tokens)
    got = sorted(map(tuple, found.collect()), key=lambda r: repr(r[:4]))
    # Python's split also cuts at the no-break space, which is not white space here.
    plain = [(i, None if t is None else t.replace(" ", "_").replace("Ä", "ä")) for i, t in rows]
    want = sorted(slow_scores(plain, learn, head_words), key=lambda r: repr(r[:4]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=0.03 * w[2])


def slow_whole_scores(rows, learn, discount=0.75):
    """As above, but every word learnt from is one of the model's, and all others are one unseen word."""
    tokens = [[t.lower() for t in (text or "").split()] for _, text in rows]
    c = Counter(t for ts, x in zip(tokens, learn, strict=True) if x for t in [*ts, None])
    n, whole = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    triples = [[*zip(["", "", *ts], ["", *ts], [*ts, None], strict=False)] for ts in tokens]
    seen = [[tuple(t if t is None or t == "" or t in c else "?" for t in x) for x in row] for row in triples]
    unigram = defaultdict(lambda: 0.1 / whole, {t: (k + 0.1) / whole for t, k in c.items()})
    model = slow_model(Counter(t for row, x in zip(seen, learn, strict=True) if x for t in row), unigram, discount)
    for (i, _), x, ts, row in zip(rows, learn, tokens, seen, strict=True):
        base = sum(math.log10((c[t] + 0.1) / whole) for t in [*ts, None])
        score = sum(math.log10(model(*t)) for t in row)
        yield i, not x, len(ts) + 1, sum(c[t] > 0 for t in [*ts, None]), n, base, score


@pytest.mark.parametrize(("looked_up", "shard_tokens"), [(lm.HEAD_WORDS, 10**6), (20, 10**6), (20, 200), (1, 60)])
def test_every_word_learnt_from_has_its_place_in_the_model(spark, monkeypatch, looked_up, shard_tokens):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(lm, "HEAD_WORDS", looked_up)
    rows = [*texts(), (502, "w1 w0 " * 200), (504, "new0 new1 new0 w1 new1"), (508, "y" * 70 + " w1 " + "y" * 70)]
    learn = [i % 4 != 0 for i, _ in rows]
    docs = spark.createDataFrame([(*r, x) for r, x in zip(rows, learn, strict=True)], "doc_id long, text string, learn boolean")
    found = lm.score_documents(docs, F.col("learn"), shard_tokens=shard_tokens)
    got = sorted(map(tuple, found.collect()))
    for g, w in zip(got, sorted(slow_whole_scores(rows, learn)), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=0.03 * w[2])


def test_a_known_phrase_of_words_outside_the_head_beats_a_new_one(spark):
    a, b, c, d = (x * 70 for x in "abcd")  # too long for the head
    rows = [(i, f"{a} {b} {c} {d}") for i in range(40)] + [(100, f"{a} {b} {c} {d}"), (101, f"{c} {a} {d} {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, F.col("doc_id") < 100).collect()}
    assert got[100] > got[101] + 1


def test_model_beats_word_frequencies_on_held_out_texts(spark):
    rng = random.Random(8)
    follow = {w: [f"w{(w * 7 + k) % 40}" for k in range(3)] for w in range(40)}
    rows = []
    for i in range(200):
        text = ["w0"]
        for _ in range(80):
            text.append(rng.choice(follow[int(text[-1][1:])]))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm.score_documents(docs, F.col("doc_id") % 5 != 0).where("held_out").collect()
    assert len(found) == 40
    assert sum(r["score"] for r in found) > 0.6 * sum(r["base_score"] for r in found)
    assert all(r["score"] < 0 for r in found)


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, lm.score_documents(rows, F.lit(None).cast("boolean")).collect()))
    assert [r[:5] for r in got] == [(1, True, 3, 0, 0), (2, True, 1, 0, 0)]
    assert all(math.isfinite(r[6]) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(empty, F.lit(True)).collect() == []


def test_extra_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 3.0, 4)], "doc_id long, text string, score double, block int")
    assert lm.score_documents(docs, F.lit(True)).count() == 1


def test_plan_cuts_hot_words_and_pairs():
    counts = np.zeros(20)
    counts[[0, 4, 5]] = 100, 1000, 30
    plan = lm.make_plan(counts, 100, {(4 << lm.BITS) | 4: 500})
    assert plan.parts[4] == 20 and plan.parts[5] == 1
    u, v = np.full(64, 4), np.full(64, 4)
    assert {int(plan.shards(u, v, block)[0]) for block in range(10)} == set(
        plan.shard[plan.pairs[(4 << lm.BITS) | 4][0] :].tolist())
    loads = np.bincount(plan.shard[: plan.first[5] + 1])
    assert loads.max() <= loads.mean() * 3
