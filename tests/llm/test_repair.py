"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re

import pytest

from strandworks.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, copies long"


def cheapest(rows):
    """(cost, audit, repaired turns) by best-first search over (row, state, edits so far)."""
    heap = [(0, "", 0, 0, ())]
    done = set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        role, to = ("assistant", 3) if state == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*out, (role, ""))))
        if i < len(rows):
            name, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, to, (*out, (role, text))))
                kept = {"s": 1 if state == 0 else None, "u": 2 if state in (0, 1, 3) else None, "a": 3 if state == 2 else None}.get(name[:1])
                if kept is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, kept, (*out, (name, text))))


def brute(turns):
    convs = {}
    for conv, turn, role, text, copies in turns:
        convs.setdefault(conv, []).extend([(turn is not None, turn or 0, " " if role is None else role, " " if text is None else text)] * copies)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, judged = set(), []
        for _, _, role, text in rows:
            ink = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        cost, audit, kept = cheapest(judged)
        dated = [t for known, t, _, _ in rows if known]
        firsts = [r[:1] for r, _, _ in judged]
        count = {f: sum(x[2] == f for x in judged) for f in ("blank", "duplicate", "truncated")}
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), kept)
    return out


def got(spark, turns):
    rows = R.repair(spark.createDataFrame(turns, SCHEMA)).collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def make(rng, n_conv, longest, roles=("user", "assistant", "system", None, "", "tool", "ux"), texts=("a.", "b", "", " \t", None, "c! ", "é?", "x\n")):
    out = []
    for c in range(n_conv):
        conv = None if c == 0 else c
        for t in range(rng.randint(1, longest)):
            out.append((conv, rng.choice([None, t, t, t + 3]), rng.choice(roles), rng.choice([*texts, f"t{rng.randrange(99)}."]), rng.choice([0, 1, 1, 1, 2, 3])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search(spark, seed):
    turns = make(random.Random(seed), 60, 9)
    assert got(spark, turns) == {k: v[:8] for k, v in brute(turns).items()}


def test_long_conversation_of_several_parts(spark):
    rng = random.Random(3)
    turns = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["hm.", f"t{t}", f"t{t}.", f"t{t}!"]), 1) for t in range(900)] + [(None, 1, "user", "a.", 1), (8, None, "user", "a.", 0)]
    want = brute(turns)
    assert R.sorted_turns(spark.createDataFrame(turns, SCHEMA)).where("conv_id = 7").select("part").distinct().count() > 1
    assert got(spark, turns) == {k: v[:8] for k, v in want.items()}
    fixed = R.repaired(spark.createDataFrame(turns, SCHEMA)).where("conv_id = 7").orderBy("part", "turn").collect()
    assert [(r.role, r.text) for r in fixed] == want[7][8]


def test_empty_and_dropped(spark):
    assert got(spark, []) == {}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(spark, [(1, 5, "user", "x", 0)]) == {1: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert got(spark, [(1, 5, None, None, 1)])[1][5:] == (4, "D", nothing)


def test_very_long_text_and_repeats(spark):
    long = "word " * 300_000 + "end."
    turns = [(1, 0, "user", long, 1), (1, 1, "assistant", long, 2), (1, 2, "user", long, 1)]
    assert got(spark, turns) == {k: v[:8] for k, v in brute(turns).items()}


def test_damage_and_other_columns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}. Yes!", "x") for c in range(40) for t in range(6)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").withColumnRenamed("part", "copies")
    import zlib

    want = []
    for c, t, role, text, _ in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        want.append((c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text, {0: 0, 3: 2}.get(fate, 1)))
    assert sorted(map(str, map(tuple, R.damaged(docs).collect()))) == sorted(map(str, want))
    assert {r.conv_id for r in R.repair(R.damaged(docs)).collect()} == {r[0] for r in rows}
