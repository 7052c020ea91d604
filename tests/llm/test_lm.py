"""Counts, base score and interpolated score against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandworks.llm import lm


def brute(rows):
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())), b"\n"]
    fold = lambda d: zlib.crc32(str(d).encode()) % 7
    toks = {d: split(t) for d, t in rows}
    train = [d for d in toks if fold(d) != 2]
    c = Counter(w for d in train for w in toks[d])
    pair = Counter(p for d in train for p in zip([b" ", *toks[d]], toks[d]))
    n, v = sum(c.values()), len(c)
    c[b" "] = len(train)
    hist = Counter()
    for d in train:
        if fold(d) != 3:
            continue
        own, own_pair = Counter(toks[d]), Counter(zip([b" ", *toks[d]], toks[d]))
        own[b" "] = 1
        for u, w in zip([b" ", *toks[d]], toks[d]):
            cu, cw, cp = c[u] - own[u], c[w] - own[w], pair[u, w] - own_pair[u, w]
            b = int(math.floor(math.log2(cu))) + 1 if cu > 0 else 0
            p2 = round(20 * math.log10(cp / cu)) if cp > 0 else -9999
            p1 = round(20 * math.log10(cw / max(n - len(toks[d]), 1))) if cw > 0 else -9999
            hist[b, p2, p1] += 1
    keys = np.array(list(hist), int).reshape(-1, 3)
    weights = lm.learn_weights(keys[:, 0], keys[:, 1], keys[:, 2], np.array(list(hist.values())), 1 / (v + 1))
    out = {}
    for d, ts in toks.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)
        score = 0.0
        for u, w in zip([b" ", *ts], ts):
            a, g, e = weights[int(math.floor(math.log2(c[u]))) + 1 if c[u] else 0]
            score += math.log10(a * pair[u, w] / max(c[u], 1) + g * c[w] / n + e / (v + 1))
        out[d] = (fold(d) == 2, len(ts), sum(c[w] > 0 for w in ts), n, base, score)
    return out, weights


@pytest.mark.parametrize("head", [0, 40, 1 << 17])
def test_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "BATCH_BYTES", 700)
    r = random.Random(4)
    vocab = ["the", "The", "of", "É", "x!"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(vocab, k=r.randrange(40)))) for i in range(120)] + [(500, None), (501, ""), (502, " \n"), (503, "never-seen words")]
    want, weights = brute(rows)
    got = {x[0]: tuple(x[1:]) for x in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4] and got[d][4:] == pytest.approx(want[d][4:], rel=1e-9), d
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()


def test_edges(spark):
    schema = "doc_id long, text string, fold string, batch int, part int, kind int"
    assert lm.lm_scores(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b", "x", 1, 2, 3), (5, "a b", "x", 1, 2, 3), (5, "a b", "x", 1, 2, 3)]
    got = lm.lm_scores(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 3 and all(r.n_tokens == 3 and math.isfinite(r.score) for r in got)
