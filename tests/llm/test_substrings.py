"""The two exact substring operators against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from strandworks.llm import repeats, suffix_sort
from strandworks.llm import suffix_array_dedup as suffix_array_dedup_module
from strandworks.llm.substring_dedup import SuffixAutomaton, digest as words_digest, substring_dedup
from strandworks.llm.suffix_array_dedup import digest as bytes_digest, suffix_array_dedup, without_repeats
from strandworks.llm.suffix_sort import suffix_buckets


def brute_words(rows, length):
    first, out = {}, {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(split):
        for s in range(len(split[d]) - length + 1):
            first.setdefault(tuple(split[d][s : s + length]), (d, s))
    for d, w in split.items():
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] != (d, s):
                gone.update(range(s, s + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, length):
    seen, out = {}, []
    for _, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone))) & gone))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["a", "be", "sea", "été", "x!", "The"] + [f"w{i}" for i in range(40)]
    passage = " ".join(r.choices(vocab, k=60))
    rows = []
    for d in range(60):
        words = r.choices(vocab, k=r.choice([0, 3, 19, 20, 25, 80, 200]))
        t = r.choice([" ", "\n", "  ", "\t"]).join(words)
        if d % 3 == 0:
            cut = r.randrange(20, len(passage))
            t += " " + passage[r.randrange(0, 20) : cut] + " " + t[:150]
        rows.append((d, t))
    rows += [(100 + i, rows[7 * i][1]) for i in range(5)] + [(200, None), (201, ""), (202, "z " * 300), (203, "  \x00 q")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [3, 2000])
def test_words(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(seed)
    got = words_digest(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_words(rows, 20) and len(got) == len(rows)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [3, 2000])
def test_bytes(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(seed) + [(300, "z " * 900)]
    got = bytes_digest(suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))).collect()
    assert sorted(map(tuple, got)) == brute_bytes(rows, 200)


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_array_dedup])
def test_edges(spark, dedup):
    schema = "doc_id long, text string, ranges int, start string, body int, n int"
    assert dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(1, text, 1, "a", 2, 3), (1, text, 1, "a", 2, 3), (None, text, 1, None, None, None), (2, text, 0, "", 0, 0), (3, None, 0, "", 0, 0)]
    got = sorted(((r.doc_id or -1), r.n_removed > 0) for r in dedup(spark.createDataFrame(rows, schema)).collect())
    # a null id is before all others: only its row keeps its words, and no row keeps its bytes
    assert got == [(-1, dedup is suffix_array_dedup), (1, True), (1, True), (2, True), (3, False)]


def test_rows_of_one_id_are_cut_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in ("one", "two", "three"))
    rows = [(0, a), (1, a), (1, c), (2, b), (None, b), (None, c + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_removed, r.n_words) for r in substring_dedup(docs).collect())
    assert got == sorted([(0, 0, 60), (1, 60, 60), (1, 60, 60), (2, 60, 60), (-1, 0, 60), (-1, 0, 61)])
    rows = [(1, a), (1, c), (2, a), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, bytes(r.kept).decode()) for r in suffix_array_dedup(docs).collect()}
    assert got == {(1, ""), (1, c), (2, ""), (None, b)}
    assert {(r.doc_id, r.text) for r in without_repeats(docs).collect()} == got
    got = {(r.doc_id, r.kept) for r in substring_dedup(docs).collect()}
    assert got == {(1, a), (1, c), (2, ""), (None, b)}


def test_the_querys_own_judge_spills_and_recurses():
    """One shard at production limits: pieces beyond the queue's budget and the base of the recursion."""
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdefgh", k=r.randrange(2, 8))) for _ in range(400)]
    shared = [" ".join(r.choices(vocab, k=60)) for _ in range(40)]
    bodies = []
    for i in range(2500):
        text = " ".join(r.choices(vocab, k=60))
        bodies.append((text[: r.randrange(150)] + r.choice(shared) + text)[:368].encode() if i % 5 == 0 else text.encode()[:368])
    bodies = list(dict.fromkeys(bodies))
    n = len(bodies)
    batch = pa.table({
        "shard": [7] * n, "h1": list(range(n)), "h2": [0] * n, "body": pa.array(bodies, pa.binary()), "doc_id": list(range(n)), "start": pa.array([0] * n, pa.int32()),
        "n": [1] * n, "size": pa.array([len(b) - 199 for b in bodies], pa.int32())}).combine_chunks().to_batches()
    spills, levels = suffix_sort.SpillQueue.spills, suffix_sort.induced[0]
    got = {i: set() for i in range(n)}
    for out in suffix_array_dedup_module._judge(200)(iter(batch)):
        for x in out.to_pylist():
            got[x["h1"]] |= set(range(x["from"], x["to"]))
    seen = {}
    for b in bodies:
        for s in range(len(b) - 199):
            seen[b[s : s + 200]] = seen.get(b[s : s + 200], 0) + 1
    assert got == {i: {s for s in range(len(b) - 199) if seen[b[s : s + 200]] > 1} for i, b in enumerate(bodies)} and any(got.values())
    assert suffix_sort.SpillQueue.spills > spills and suffix_sort.induced[0] > levels


def test_long_rows_are_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 300)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    parts = {}
    for unit, length, k in (("word", 20, 6), ("byte", 200, 32)):
        for limit in (300, 1 << 20):
            repeats.SLICE_BYTES = limit
            table = docs.toArrow()
            found = set()
            for batch in table.to_batches():
                data, offs = repeats.text_buffer(batch.column(1))
                for row, base, tokens, to in repeats.token_rows(data, offs, unit, length):
                    r, s, n, h = repeats.anchor_runs(tokens, to, k, length)
                    found |= {(int(row[a]), int(base[a] + b + q), int(e)) for a, b, m, e in zip(r, s, n, h) for q in range(m)}
            parts[unit, limit] = found
        assert parts[unit, 300] == parts[unit, 1 << 20]


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_suffix_array_spills_and_recurses(monkeypatch, block):
    monkeypatch.setattr(suffix_sort, "BLOCK", block)
    r = np.random.default_rng(1)

    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for i in range(60):
        unit = r.integers(1, r.integers(2, 5), r.integers(1, 50))
        text = np.append(unit if i % 3 else np.tile(unit[:5], 12), 0).astype(np.int32)
        order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        for base, budget in ((1 << 22, 1 << 22), (2, 3)):
            out = list(suffix_buckets(text, 100, base, budget))[::-1]
            assert np.concatenate([p for p, _ in out]).tolist() == order
            assert np.concatenate([x for _, x in out]).tolist() == [0] + [shared(text[a:], text[b:]) for a, b in zip(order, order[1:])]


def test_automaton_finds_first_ends():
    texts = ["abcabxabcd", "bcabxab", "xabcdabc"]
    a, at, joined = SuffixAutomaton(), 0, "".join(texts)
    for t in texts:
        a.insert(t, at)
        at += len(t)
    ends = np.cumsum([len(t) for t in texts])
    for t in texts + ["zzabxq"]:
        for i, e in enumerate(a.first_ends(t, 3)):
            want = next((j + 2 for j in range(len(joined) - 2) if joined[j : j + 3] == t[i : i + 3] and not any(j < b < j + 3 for b in ends)), -1)
            assert e == want
