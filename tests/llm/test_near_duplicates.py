"""The n-gram Jaccard join and the vector comparison against all pairs."""

import math
import random

import numpy as np
import pytest

from pagewright.llm.common import components
from pagewright.llm.embedding_dedup import linked_pairs, near_duplicates
from pagewright.llm import ngram_jaccard
from pagewright.llm.ngram_jaccard import CountRTree, count_vector, distinct_prints, group_keys, jaccard_components, most_difference, spanning_links
from pagewright.llm.shingles import shingle_sets, word_hashes


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[k:] for k in range(size)), strict=False))


def brute(rows, links):
    """Smallest id reachable; links is a symmetric test on places."""
    low = [r for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if links(i, j):
                parent[root(i)] = root(j)
    best = {}
    for i, r in enumerate(low):
        best[root(i)] = min(best.get(root(i), r), r)
    return [best[root(i)] for i in range(len(rows))]


def near_copies(rng, n_base=12, copies=9, words=60):
    rows = []
    for _ in range(n_base):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 7, 20, words, 3 * words]))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 12)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
            rows.append(" ".join(text))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [f"{passage} {' '.join(f'u{i}_{k}' for k in range(rng.randrange(1, 9)))}" for i in range(12)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_components_equal_all_pairs(spark, size, percent):
    rng = random.Random(size)
    texts = near_copies(rng) + [None, "", "  \t", "One", "one", "A b", "a  B", "a b c d", "a b c d"]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, n long")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, size=size, percent=percent).collect()}
    sets = [shingles(t, size) for t in texts]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(sets[i]) and 100 * both >= percent * len(sets[i] | sets[j])

    expected = brute(list(range(len(texts))), linked)
    assert found == {i: (len(sets[i]), expected[i]) for i in range(len(texts))}


def test_tiles_of_a_hot_key_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 5)
    rng = random.Random(8)
    texts = near_copies(rng, 6, 30, 40)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t, 4) for t in texts]
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    assert found == dict(enumerate(brute(list(range(len(texts))), linked)))


def test_links_of_a_large_group_stay_fewer_than_its_rows(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(2000):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    given = []
    whole = ngram_jaccard.components
    monkeypatch.setattr(ngram_jaccard, "components", lambda edges: (given.append(edges.count()), whole(edges))[1])
    found = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0} and len(found) == 2000
    assert sum(given) <= 2 * len(texts)


def test_large_tiles_under_keys_are_searched_again(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "spanning_links", lambda *_: [])  # nothing is contracted at hubs
    rng = random.Random(10)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(160):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t, 4) for t in texts]
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    assert found == dict(enumerate(brute(list(range(len(texts))), near)))


def test_spanning_links_reach_what_all_links_reach():
    rng = np.random.Generator(np.random.PCG64(11))
    for m in (2, 3, 9, 120):
        bases = rng.integers(0, 2**64, (1 + m // 20, 80), dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(bases[k % len(bases)])[: 80 - d], rng.integers(0, 2**64, d, dtype=np.uint64)])) for k, d in enumerate(rng.integers(0, 14, m))]
        comps = [int(c) for c in rng.integers(0, 2 * m, m)]
        for sides in ([0] * m, [-1 if k % 3 else 1 for k in range(m)]):
            def linked(i, j):
                common = len(np.intersect1d(sets[i], sets[j]))
                meet = sides[i] != sides[j] or sides[i] == 0
                return comps[i] == comps[j] or (meet and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common))

            links = spanning_links(sets, comps, sides, 85)
            assert len(links) < m and all(linked(i, j) for i, j in links)
            spans = lambda i, j: comps[i] == comps[j] or (i, j) in links or (j, i) in links
            assert brute(list(range(m)), spans) == brute(list(range(m)), linked)


def test_texts_without_an_id_bridge_others(spark):
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join([*(f"x{k}" for k in range(n)), *base[n:]]) for n in (0, 4, 8)]
    rows = [(1, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (None, " ".join(base[50:])), (None, " ".join(base[50:]) + " y")]
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 0), (0, 0), (0, 1), (0, 1), (1, 1), (3, 1)]


def test_equal_64_bit_prints_stay_apart(spark):
    rows = [(1, 7, 5), (2, 7, 5), (3, 7, 6), (4, 8, 1)]
    found = {r["id"]: r["fp"] for r in distinct_prints(spark.createDataFrame(rows, "id long, fp long, more long")).collect()}
    assert found[1] == found[2] == 7 and found[4] == 8 and found[3] not in (7, 8)


def test_long_texts_hash_by_parts_as_at_once(monkeypatch):
    from pagewright.llm import shingles as module

    text = (" ".join(f"word{k % 977}" for k in range(3000)) + " " + "y" * 9000 + "  tail " + "z" * 5000).encode()
    data, ends = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    at_once = word_hashes(data, ends, head=5)
    monkeypatch.setattr(module, "SLICE_BYTES", 1000)
    for x, y in zip(at_once, word_hashes(data, ends, head=5), strict=True):
        assert x.tolist() == y.tolist()
    import pyarrow as pa

    assert len(next(shingle_sets(pa.array([text]), 4))) == len(set(shingles(text.decode(), 4)))


def test_empty_table_null_and_repeated_ids(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, None)]
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)]


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{m}{k}" for k in range(60)) for m in "abc")
    near = lambda t: t.replace("30", "x")
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (4, near(c)), (4, near(c)), (5, c + " end")]
    found = sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 4)]


def test_keys_of_linked_sets_meet():
    rng = np.random.Generator(np.random.PCG64(4))
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for percent in (80, 85):
            room = most_difference(len(a), len(a), percent)
            drop = int(rng.integers(0, room // 2 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, max(0, room - 2 * drop), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert np.intersect1d(group_keys(a, percent), group_keys(b, percent)).size


def test_tree_keeps_every_linked_pair():
    rng = np.random.Generator(np.random.PCG64(5))
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 200 - d], rng.integers(0, 2**64, d, dtype=np.uint64)])) for d in rng.integers(0, 40, 150)]
    vectors = np.stack([np.frombuffer(count_vector(s).tobytes(), "u1") for s in sets])
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[k] for k in order], sizes[order]
    tree = CountRTree(vectors[order], sizes, fanout=8)
    everything = np.ones(len(sets), bool)
    pairs = {(x, int(y)) for x in range(len(sets)) for y in tree.reach(x, 85, everything)}
    for x in range(len(sets)):
        for y in range(len(sets)):
            common = len(np.intersect1d(sets[x], sets[y]))
            if 100 * common >= 85 * (len(sets[x]) + len(sets[y]) - common):
                assert (x, y) in pairs


def test_components_of_chains_rings_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(31)} | {300: 300, 301: 300, 302: 300}


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


def test_vectors_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(160):
        base = [rng.gauss(0, 1) for _ in range(24)] if k % 5 == 0 else [x + rng.gauss(0, 0.2) for x in base]
        rows.append((k, [float(x) for x in base], k % 3))
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(5)]
    odd = [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, rows[0][1], None), (304, [None] * 24, 1), (305, [float("inf")] * 24, 0), (306, [1.0], 0), (307, [], 0)]
    df = spark.createDataFrame([(*r, "a") for r in rows + odd], "vec_id long, embedding array<double>, label int, copies string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, tile_bytes=16 * 24 * 8).collect()}
    linked = lambda i, j: rows[i][2] == rows[j][2] and cosine(rows[i][1], rows[j][1]) >= 0.93
    low = brute([r[0] for r in rows], linked)
    for i, r in enumerate(rows):
        links = sum(linked(i, j) for j in range(len(rows)) if j != i)
        assert found[r[0]] == (links, low[i], low[i] == r[0])
    assert all(found[r[0]] == (0, r[0], True) for r in odd)


@pytest.mark.parametrize("tile_bytes", [1 << 24, 40 * 8 * 8, 7 * 8 * 8])
def test_grids_of_several_axes_lose_nothing(spark, tile_bytes):
    rng = np.random.Generator(np.random.PCG64(13))
    bases = rng.normal(size=(14, 8))
    x = bases[rng.integers(0, 14, 300)] + rng.normal(size=(300, 8)) * 0.35
    rows = [(k, [float(c) for c in v], k % 2) for k, v in enumerate(x)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile_bytes=tile_bytes).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300)[None, :] % 2)
    low = brute(list(range(300)), lambda i, j: near[i, j])
    assert found == {k: (int(near[k].sum()) - 1, low[k]) for k in range(300)}


def test_null_and_repeated_vector_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a, 1), (None, b, 1), (None, b, 1), (7, b, 1), (7, c, 1), (None, [0.0, 1.0, 0.0], 1), (9, None, 1), (None, None, None)]
    found = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    assert found == sorted([(5, 3, 5, True), (None, 3, 5, False), (None, 3, 5, False), (7, 3, 5, False), (7, 0, 7, True), (None, 0, None, True), (9, 0, 9, True), (None, 0, None, True)], key=repr)


def test_partial_products_drop_nothing():
    rng = np.random.Generator(np.random.PCG64(6))
    a, b = rng.normal(size=(90, 50)), rng.normal(size=(80, 50))
    b[:40] = a[:40] + rng.normal(size=(40, 50)) * 0.3
    axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    i, j = linked_pairs(a, b, axes, 0.93)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    expected = {(int(x), int(y)) for x, y in zip(*np.nonzero(unit(a) @ unit(b).T >= 0.93), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected and expected


def test_no_vectors(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
