"""Periodic runs against trying every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strandworks.llm import periodic as P


def brute(words, least=12):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    runs = sorted((s, n, p) for (s, n), p in found.items())
    return sorted(runs, key=lambda r: (r[0], r[2]))


def text(rng, n, kinds, periodic):
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n and periodic:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    docs = [text(rng, rng.choice([0, 1, 5, 12, 13, 40, 150]), rng.choice([1, 2, 3, 40]), rng.random() < 0.5) for _ in range(60)]
    numbers = {w: k for k, w in enumerate(sorted({w for d in docs for w in d}))}
    offs = np.cumsum([0, *map(len, docs)])
    t, s, n, p = P.find_runs(np.array([numbers[w] for d in docs for w in d], np.int64), offs)
    assert [[x[1:] for x in zip(t.tolist(), s.tolist(), n.tolist(), p.tolist()) if x[0] == d] for d in range(len(docs))] == [brute(d) for d in docs]


def test_extensions_equal_word_by_word():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (30, 1), (60, 2), (200, 3)):
        x = rng.integers(0, kinds, n)
        e = P.Extensions(x, np.zeros(n, np.int64))
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        if pairs:
            i, j = np.array(pairs).T
            want = [next((k for k in range(n) if max(a, b) + k >= n or x[a + k] != x[b + k]), n) for a, b in pairs]
            assert P.Extensions.common(e, i, j).tolist() == want


def test_small_blocks_of_points(monkeypatch):
    monkeypatch.setattr(P, "POINTS", 7)
    words = np.array([0, 1] * 20 + [2] * 15, np.int64)
    t, s, n, p = P.find_runs(words, np.array([0, len(words)]))
    assert list(zip(s.tolist(), n.tolist(), p.tolist())) == brute(words.tolist())


def expected(rows):
    out = []
    for doc, raw in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", raw or "")
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        gone = {i for s, k, p in runs for i in range(s + p, s + k)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def digest(spark, rows, schema="doc_id long, text string, runs string"):
    docs = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = P.digest(P.periodic_runs(P.damaged(docs)))
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in got.collect()), key=str)


def test_query_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(d, rng.choice([" ", "\n", "\t \x0b"]).join(text(rng, rng.choice([3, 20, 120]), rng.choice([1, 3, 60]), rng.random() < 0.3))) for d in range(120)]
    rows += [(None, None), (None, "a " * 30), (5, ""), (5, " \n "), (6, None), (7, "é\u00a0 " * 14), (7, "é\u00a0 " * 14), (8, "\u2003".join("ab" * 9))]
    assert digest(spark, rows) == expected(rows)


def test_empty_table_and_very_long_text(spark):
    assert digest(spark, []) == []
    rng = random.Random(2)
    words = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    words[40_000:40_060] = ["x", "y", "z"] * 20
    words[100_000:140_000] = words[60_000:80_000] * 2
    got = P.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [40_000, 60, 3] in [list(r) for r in got.runs] and any(r.period == 20_000 and r.length >= 40_000 for r in got.runs)
    assert got.n_words == 150_000
