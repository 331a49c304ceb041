"""Periodic runs against a scan of all lags, and the registered query against its definition."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from murmur.llm import periods
from murmur.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, runs string, n_words string"


def all_runs(words, least=12):
    """Every lag and start on its own; the smallest period is sought by trying all."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, 2 * q):
                run = words[start : start + length]
                if not any(all(run[k] == run[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((start, length, q))
            i += i == start or i + q < n
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_text(rng):
    n, letters = rng.randrange(160), rng.choice([1, 2, 3, 5, 30])
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(5)):
        if n > 4:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 2))
            for i in range(a + p, min(n, a + rng.randrange(2, 9) * p + rng.randrange(p))):
                words[i] = words[i - p]
    return (words * 3)[:300] if rng.random() < 0.2 else words


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_a_scan_of_all_lags(seed):
    rng = random.Random(seed)
    some = 0
    for _ in range(300):
        words, least = random_text(rng), rng.choice([12, 12, 4, 7, 30])
        expected = all_runs(words, least)
        some += len(expected)
        assert periods.find_runs(np.array(words, np.int64), least) == expected, (words, least)
    assert some > 300


def test_very_long_repetitive_texts_take_no_quadratic_time():
    fibonacci, longer = [0], [0, 1]
    while len(longer) < 60_000:
        fibonacci, longer = longer, longer + fibonacci
    cases = {
        "one word": ([1] * 100_000, 1), "many periods": (list(range(500)) * 200, 1),
        "rows of one word": (([1] * 100 + [2]) * 500, 501), "two words at random": (np.random.default_rng(0).integers(0, 2, 60_000), None),
        "nested": (longer, None),
    }
    for name, (words, n) in cases.items():
        start = time.perf_counter()
        found = periods.find_runs(np.array(words, np.int64))
        assert time.perf_counter() - start < 20, name
        assert n is None or len(found) == n, name


def test_edge_cases(spark):
    rows = [(1, None, "x", "y"), (2, "", "", ""), (None, " \t ", "", ""), (3, "a " * 12, "", ""), (3, "a " * 12, "", ""),
            (4, "a " * 11, "", ""), (5, "x\x0by " * 6 + "é", "", ""), (6, "b " + "a b c\xa0 d\n" * 3 + "a", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = periods.periodic_runs(docs).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [r["n_words"] for r in got] == [0, 0, 0, 12, 12, 11, 13, 14]
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[], [], [], [(0, 12, 1)], [(0, 12, 1)], [], [(0, 12, 2)], [(1, 13, 4)]]
    assert [r["collapsed"] for r in got] == ["", "", "", "a", "a", " ".join("a" * 11), "x y é", "b a b c\xa0 d"]
    assert periods.periodic_runs(docs.limit(0)).collect() == []
    assert periods.periodic_runs(docs.selectExpr("cast(doc_id as string) doc_id", "text")).dtypes[0] == ("doc_id", "string")


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_registered_query(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"].run(spark, SF).collect()}
    assert got.keys() == texts.keys()
    short = {i for i, t in texts.items() if len((t or "").split()) < 2500}  # the scan of all lags is quadratic
    assert len(short) > 0.9 * len(texts)
    assert {i: got[i] for i in short} == {i: expected_row(i, texts[i]) for i in short}
    assert sum(r[0] > 0 for r in got.values()) >= 10
