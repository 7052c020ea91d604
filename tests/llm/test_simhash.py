"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from strandworks.llm import simhash
from strandworks.llm.simhash import digest, simhash_groups, tree_links


def brute_print(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def texts(n=260):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["É", "THE", "a"]
    out = [None, "", " \n", "one", "One two", "one two three", "ONE two three four"]
    while len(out) < n:
        base = r.choices(vocab, k=r.choice([5, 40, 400]))
        for _ in range(r.choice([1, 1, 1, 6, 30])):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(r.choice([" ", "\n"]).join(w))
    return out


def test_against_brute_force(spark):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    prints = [brute_print(t) for _, t in rows]
    root = brute_components(prints)
    least = {}
    for (d, _), c in zip(rows, root):
        least[c] = min(least.get(c, d), d)
    got = sorted(map(tuple, digest(simhash_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()))
    assert got == sorted((d, f"{p:016x}", least[c]) for (d, _), p, c in zip(rows, prints, root))


@pytest.mark.parametrize(("leaf", "tile"), [(8, 1 << 14), (8, 40), (1 << 14, 64)])
def test_trees_and_tiles(spark, monkeypatch, leaf, tile):
    """Vantage-point shards of a few points, shards cut in blocks, and both."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "TILE", tile)
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 6, dtype=np.uint64)
    points = set(base.tolist())
    for b in base.tolist():
        p = b
        for _ in range(150):
            for bit in r.integers(0, 64, r.integers(1, 8)).tolist():
                p ^= 1 << bit
            points.add(p)
            p = p if r.random() < 0.7 else b
    points = sorted(points)
    want = brute_components(points)

    def groups(links):
        root = {p: p for p in points}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            assert bin(a ^ b).count("1") <= 4
            root[find(a)] = find(b)
        by = {}
        for p in points:
            by.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, by.values()))

    by = {}
    for p, c in zip(points, want):
        by.setdefault(c, set()).add(p)
    want = sorted(map(sorted, by.values()))
    arr = np.array(points, np.uint64)
    links = tree_links(arr.view(np.int64))
    assert groups([(points[i], points[j]) for i, j in links]) == want and len(links) == len(points) - len(want)
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    mask = (1 << 64) - 1
    assert groups([(a & mask, b & mask) for a, b in simhash.fingerprint_links(df).collect()]) == want


def test_the_tree_decides_and_every_close_pair_meets(spark):
    """At production limits: many shards, and each pair within the radius is in one of them."""
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 30_000, dtype=np.uint64)
    near = base[:4000].copy()
    for _ in range(4):
        near ^= np.uint64(1) << r.integers(0, 64, len(near), dtype=np.uint64)
    points = np.unique(np.concatenate((base, near)))
    df = spark.createDataFrame(pd.DataFrame({"fp": points.view(np.int64)}))
    trees = simhash.vantage_points(df, int(len(points) / simhash.LEAF).bit_length())
    met = np.zeros(4000, bool)
    for mask, tree in zip(simhash.subspaces(), trees):
        assert len(tree[0]) == 5
        at, leaf = simhash.tree_shards(base[:4000], mask, tree)
        at2, leaf2 = simhash.tree_shards(near, mask, tree)
        met[np.array(sorted(set(zip(at.tolist(), leaf.tolist())) & set(zip(at2.tolist(), leaf2.tolist()))), int).reshape(-1, 2)[:, 0]] = True
        _, every = simhash.tree_shards(points, mask, tree)
        assert len(np.unique(every)) == 32 and np.bincount(every).max() < len(points) / 4 and len(every) < 3 * len(points)
    assert met.all()
    close = {(int(min(a, b)), int(max(a, b))) for a, b in zip(base[:4000].view(np.int64), near.view(np.int64)) if a != b}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in simhash.fingerprint_links(df.repartition(4)).collect():
        assert bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in close)


def test_edges(spark):
    schema = "doc_id long, text string, fp long, node int, root int, a int, m int"
    assert simhash_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "x y", 1, 2, 3, 4, 5), (1, "x y", 1, 2, 3, 4, 5), (None, "x y", 0, 0, 0, 0, 0), (7, None, 0, 0, 0, 0, 0), (9, "", None, None, None, None, None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (7, 7), (9, 7)]
