"""SimHash and embedding near-duplicates against brute force on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash

from murmur.llm import embeddings, simhash
from murmur.llm.common import components, dealt_pairs, forest

DOCS = "doc_id long, text string"


def joined(n, links):
    """Smallest node reachable from each, by repeated passes."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= (label[a], label[b]) != (least, least)
            label[a] = label[b] = least
    return label


def words(rng, n):
    return [rng.choice(["ant", "bee", "cat", "dog", "eel", "fox", "gnu", "hen"]) + str(rng.randrange(40)) for _ in range(n)]


def slow_fingerprint(text, shingle):
    tokens = [t for t in (text or "").translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ") if t]
    tokens = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in tokens]
    if not tokens:
        return 0
    pieces = [" ".join(tokens[i : i + shingle]) for i in range(max(1, len(tokens) - shingle + 1))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in pieces]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "One", "one two", "One TWO three", "É a b c", "a b a b a b a b", "x " * 3000,
])
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    data = None if text is None else text.encode()
    assert simhash.fingerprint(data, 3) == slow_fingerprint(text, 3)


def test_spark_hashes_shingles_alike(spark):
    assert spark.sql("select xxhash64('a b c') h").head()["h"] % 2**64 == simhash.fingerprint(b"a b c", 3)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_tiles_find_every_link(radius, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(120):
        fp = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randrange(1, 6)):
            fp ^= 1 << bit
        fps.append(fp)
    fps = sorted(set(fps))
    links = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= radius]
    label = simhash.tile_labels(np.array(fps, np.uint64), radius)
    want = joined(len(fps), links)
    groups = {}
    for i, x in enumerate(label.tolist()):
        groups.setdefault(x, set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


@pytest.mark.parametrize("bucket_rows", [1024, 4])
def test_near_links_connect_what_brute_force_connects(spark, bucket_rows):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    centre = fps[0]
    for _ in range(60):  # a hot group: many that share most of their bits
        fps.append(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    prints = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(prints, 3, bucket_rows)).collect()}
    links = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = joined(len(fps), links)
    got = [roots.get(f, f) for f in signed]
    for a, b in itertools.combinations(range(len(fps)), 2):
        assert (got[a] == got[b]) == (want[a] == want[b])


@pytest.mark.parametrize(("radius", "blocks"), [(3, 4), (3, 5), (3, 6), (2, 5), (1, 4)])
def test_blocks_and_choices_of_them_find_every_link(spark, radius, blocks):
    """So many rows for a bucket of one that a bucket is told by bits of two blocks or more."""
    rng = np.random.default_rng(radius * 10 + blocks)
    fps = rng.integers(0, 2**64, 5000, np.uint64)
    for i in range(1, 1000):  # near ones, some just outside of the radius
        flips = rng.choice(64, int(rng.integers(1, radius + 3)), replace=False)
        fps[i] = fps[rng.integers(0, i)] ^ np.uint64(sum(1 << int(b) for b in flips))
    fps = np.unique(fps)
    near = [np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1 for i in range(fps.size)]
    want = joined(fps.size, [(i, int(j)) for i, js in enumerate(near) for j in js])
    assert sum(map(len, near)) > 300
    signed = fps.view(np.int64).tolist()
    prints = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.near_links(prints, radius, 1, blocks)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    got = [roots.get(f, f) for f in signed]
    first = {}
    assert len({first.setdefault(w, g) for w, g in zip(want, got, strict=True)}) == len(set(got)) == len(set(want))
    assert all(first[w] == g for w, g in zip(want, got, strict=True))


def test_blocks_grow_with_the_rows():
    counts = [simhash.block_count(n, 3) for n in (0, 10**6, 6 * 10**7, 10**9, 10**10, 10**12)]
    assert counts[:3] == [4, 4, 4] and counts == sorted(counts) and counts[-1] == 6
    assert simhash.block_count(0, 0) == 1 and simhash.block_count(10**6, 63) == 64
    for n in (10**9, 10**11):  # comparisons of a row stay within some buckets of it
        blocks = simhash.block_count(n, 3)
        assert math.comb(blocks, 3) * max(1024, n / 2 ** (64 // blocks * (blocks - 3))) <= 20 * 1024


def test_documents_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(30):
        text = words(rng, rng.randrange(1, 200))
        rows.append((100 - i, " ".join(text)))
        if i % 3 == 0:
            text[len(text) // 2] = "changed"
            rows.append((200 + i, " ".join(text)))
    rows += [(7, None), (5, ""), (6, "  "), (300, rows[0][1]), (None, rows[0][1]), (300, rows[0][1])]
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    got = sorted(map(tuple, found.collect()), key=repr)
    fps = [slow_fingerprint(t, 3) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    label = joined(len(rows), links)
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    want = [(i, f"{fp:016x}", least.get(x)) for (i, _), fp, x in zip(rows, fps, label, strict=True)]
    assert got == sorted(want, key=repr)
    assert (7, "0" * 16, 5) in got


def test_one_of_each_group_is_kept_with_its_columns(spark):
    text = " ".join(map(str, range(80)))
    rows = [(3, text, "a"), (1, text, "b"), (1, text, "b"), (2, "quite another text", "c"), (None, text, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr)
    assert kept == sorted([rows[1], rows[3], rows[4]], key=repr)


def test_one_id_with_texts_of_several_groups(spark):
    first, second, third = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [
        (1, first, "a"), (1, second, "b"), (2, second, "c"), (2, third, "d"), (3, first, "e"), (1, first, "f"),
        (4, third, "g"),
    ]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        kept = sorted(map(tuple, simhash.keep_one(docs).collect()))
        assert [(i, t) for i, t, _ in kept] == [(1, first), (1, second), (2, third)]
        assert order is rows or kept == before
        before = kept


def test_simhash_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []


def test_forest_and_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(50), rng.randrange(50)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)]
    want = joined(161, links)
    a, b = (np.array(x) for x in zip(*links, strict=True))
    assert forest(161, a, b).tolist() == want
    table = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(table).collect()}
    assert {k: got.get(k, k) for k in range(161)} == dict(enumerate(want))


def test_hot_cells_are_cut_without_losing_rows(spark):
    rows = spark.range(100).selectExpr("id", "if(id < 90, 0, id) cell")
    dealt = dealt_pairs(rows, ["cell"], rows["id"], 20, 10).collect()
    assert len(dealt) == 100
    assert {r["_chunks"] for r in dealt if r["cell"] == 0} == {9}
    assert {(r["_chunks"], r["_chunk"]) for r in dealt if r["cell"]} == {(1, 0)}


def vectors(seed=1, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    rows = []
    for i in range(160):
        v = centres[rng.integers(25)] + rng.normal(scale=rng.choice([0.02, 0.2]), size=dim)
        rows.append((1000 - i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(30)]  # copies
    rows += [(3000 + i, [1.0 + 0.001 * i] + [0.5] * (dim - 1), 1) for i in range(40)]  # a dense group
    nan, inf = float("nan"), float("inf")
    rows += [
        (1, None, 1), (2, [], 1), (3, [0.0] * dim, 1), (4, [nan] * dim, 1), (5, [inf] + [1.0] * (dim - 1), 1),
        (6, [None] + [1.0] * (dim - 1), 1), (7, rows[0][1], None), (None, rows[0][1], rows[0][2]),
        (8, [1.0, 1.0], 1), (9, [2.0, 2.0], 1), (10, [1e30] * dim, 0), (11, [1e-30] * dim, 0),
    ]
    return rows


def slow_links(rows, cosine):
    usable = [
        i for i, (k, v, c) in enumerate(rows)
        if k is not None and c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links = []
    for i, j in itertools.combinations(usable, 2):
        if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            a, b = a / abs(a).max(), b / abs(b).max()
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links.append((i, j))
    return links


@pytest.mark.parametrize("cell_rows", [2048, 30])
def test_embeddings_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell_rows)
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("x", "kept")
    got = {r["vec_id"]: tuple(r) for r in embeddings.near_duplicates(table).collect()}
    links = slow_links(rows, 0.98)
    label = joined(len(rows), links)
    degree = [sum(i in link for link in links) for i in range(len(rows))]
    least = {}
    for (k, _, _), x in zip(rows, label, strict=True):
        if k is not None:
            least[x] = min(least.get(x, k), k)
    assert len(links) > 300 and len(got) == len(rows)
    for (k, _, _), x, n in zip(rows, label, degree, strict=True):
        assert got[k] == ((k, n, least[x], k == least[x]) if k is not None else (None, 0, None, True))


def test_each_link_is_seen_in_the_home_cells_of_both_ends():
    rows = embeddings.unit(np.random.default_rng(3).normal(size=(400, 4)))
    centres = embeddings.spherical_kmeans(rows, 12)
    home, guest, cell = embeddings.cells_of(rows, centres, 0.98)
    present = set(zip(range(400), home.tolist(), strict=True)) | set(zip(guest.tolist(), cell.tolist(), strict=True))
    for a, b in zip(*np.nonzero(rows @ rows.T >= 0.98), strict=True):
        assert (b, home[a]) in present
    assert len(present) < 400 * 12 / 2


def test_registered_query_on_a_label_large_enough_for_cells(spark, monkeypatch, tmp_path):
    from murmur.llm.queries import QUERIES

    cells, fit = [], embeddings.spherical_kmeans
    monkeypatch.setattr(embeddings, "spherical_kmeans", lambda x, k: cells.append(k) or fit(x, k))
    rng = np.random.default_rng(6)
    v = rng.normal(size=(5000, 16)).astype(np.float32)
    v[4000:] = v[:1000] + rng.normal(scale=0.05, size=(1000, 16)).astype(np.float32)
    rows = [(i, x, 1) for i, x in enumerate(v.tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op8_embedding_dedup"].run(spark, str(tmp_path)).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert cells == [2] and want.sum() > 1000
    assert got == dict(enumerate(want.tolist()))


def test_embeddings_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).collect() == []
