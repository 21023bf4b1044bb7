import re

import numpy as np
import pytest
import xxhash

from regionloom.llm import components as C
from regionloom.llm import embeddings, simhash


def joined(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", " \n", "One", "A b C", "É É x y z w q", "the quick brown fox jumps over the lazy dog " * 20):
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_print(t)


def test_links_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = set(bits.tolist())
    for b in bits[:20].tolist():
        for k in range(30):
            x = b
            for f in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << f if f < 63 else -(1 << 63)
            fps.add(x)
    fps |= {0, -1, -(1 << 63)}
    fps = sorted(fps)
    a = np.array(fps, np.int64).view(np.uint64)
    x, y = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4)
    want = joined(fps, [(fps[i], fps[j]) for i, j in zip(x, y, strict=True) if i < j])
    # with cells of 2 rows and more dealt in parts, and with none
    for heavy, sample in ((1, 1), (10**9, 128)):
        monkeypatch.setattr(simhash.deal, "__defaults__", (heavy, sample))
        links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), heavy=heavy)
        got = {r.node: r.root for r in C.components(links).collect()}
        assert all(got.get(f, f) == want[f] for f in fps)


def test_simhash_cases(spark):
    rows = [(None, None, "x"), (1, "a b c", "y"), (1, "a b c", "y"), (1, "q r s t u v", "y"), (0, "q R s t u v", "y"), (2, "", "z"), (None, "zz yy xx", "p"), (None, "zz yy xx", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fp = lambda t: f"{plain_print(t):016x}"
    assert got == {(None, fp("")): 2, (2, fp("")): 2, (1, fp("a b c")): 1, (1, fp("q r s t u v")): 0, (0, fp("q r s t u v")): 0, (None, fp("zz yy xx")): None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("0", "q R s t u v"), ("1", "a b c"), ("2", ""), ("None", "zz yy xx")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs, 5)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    want = joined({x for p in pairs for x in p}, pairs)
    got = {r.node: r.root for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("dim", [64, 10, 3])
def test_vectors_against_all_pairs(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(60, dim))
    x = np.concatenate([base] + [base[:20] + rng.normal(size=(20, dim)) * s for s in (0.01, 0.05, 0.1, 0.14) for _ in range(3)])
    x = np.concatenate([x, x[:10], x[:5] * 3]).astype(np.float32)
    labels = [int(i % 2) if i % 17 else None for i in range(len(x))]
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    link = (d @ d.T >= 0.98) & np.array([[a is not None and a == b for b in labels] for a in labels])
    np.fill_diagonal(link, False)
    want = joined(range(len(x)), [(int(i), int(j)) for i, j in zip(*np.nonzero(link), strict=True) if i < j])
    assert link.sum() > 0
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), want[i], want[i] == i)


def test_heavy_cells_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = (np.ones((120, 16)) + rng.normal(size=(120, 16)) * 0.1).astype(np.float32)
    classes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "class long, embedding array<float>, label int")
    d = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d @ d.T >= 0.98), strict=True) if i < j}
    assert want
    for heavy, sample in ((7, 1), (10**9, 128)):
        monkeypatch.setattr(embeddings.deal, "__defaults__", (heavy, sample))
        got = embeddings.verified(embeddings.candidates(classes, heavy=heavy), classes).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_dense_cells_count_each_pair_once(spark, monkeypatch):
    """The same rows whether cells send pairs or members, whole or in parts; copies and several labels among them."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((150, 20)) + rng.normal(size=(150, 20)) * s for s in (0.05, 0.12)] + [rng.normal(size=(40, 20))])
    x = np.concatenate([x, x[:30], x[:5]]).astype(np.float32)
    labels = [i % 2 for i in range(len(x))]
    d = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    link = (d @ d.T >= 0.98) & np.equal.outer(labels, labels)
    np.fill_diagonal(link, False)
    want = joined(range(len(x)), [(int(i), int(j)) for i, j in zip(*np.nonzero(link), strict=True) if i < j])
    vectors = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "_SMALLEST", 0)
    assert link.sum() > 8 * len(x)
    for dense, heavy, sample in ((float("inf"), 10**9, 128), (0.0, 10**9, 128), (0.5, 40, 1)):
        monkeypatch.setattr(embeddings.deal, "__defaults__", (heavy, sample))
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors, heavy=heavy, dense=dense).collect()}
        assert got == {i: (int(link[i].sum()), want[i]) for i in range(len(x))}


def test_vector_cases(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 0.0], None), (6, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (8, [1.0], 1), (None, [1.0, 0.0], 1), (9, [], 1), (10, [float("inf"), 1.0], 1), (6, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert len(got) == len(rows)
    assert [g for g in got if g[1]] == [((False, 6), 3, 6, True), ((False, 6), 3, 6, True), ((False, 7), 3, 6, False), ((True, 0), 3, 6, False)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
