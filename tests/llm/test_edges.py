"""Very long texts, ties, repeated rows, null and repeated ids: cases that the operators' own tests leave out."""

import random

import pytest
from pyspark.sql import functions as F

from strandworks.llm import chat, lm, mixing, rules, simhash, topk
from tests.llm.test_lm import brute
from tests.llm.test_rows import brute_rules
from tests.llm.test_simhash import brute_print

R = random.Random(31)
VOCAB = [f"w{i}" for i in range(2000)] + ["été", "The", "x|y"]
LONG = " ".join(R.choices(VOCAB, k=120_000))


def test_chat_ties_repeats_and_long_text(spark):
    # equal turn numbers are ordered by role and text; a repeated row is a turn
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (2, 0, "assistant", "z"), (2, 0, "user", "a"), (3, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, "user", "q"), (5, 0, "user", LONG), (5, 1, "assistant", "ok")]
    got = {r.conv_id: r for r in chat.maximal_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert set(got) == {1, 3, 5}
    assert got[1].rendered == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in (("assistant", "z"), ("user", "a"), ("user", "b")))
    assert got[3].n_turns == 2 and LONG in got[5].rendered and got[5].n_turns == 2


def test_lm_long_text(spark):
    rows = [(i, " ".join(R.choices(VOCAB[:50], k=20))) for i in range(40)] + [(900, LONG)]
    want, _ = brute(rows)
    got = {x[0]: tuple(x[1:]) for x in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900][:4] == want[900][:4] and got[900][4:] == pytest.approx(want[900][4:], rel=1e-9)


def test_rules_long_text_null_and_repeated_ids(spark):
    rows = [(None, LONG, "en"), (1, "a b c", "en"), (1, "a b c", "en"), (1, "one two three four five six seven eight nine ten eleven", None), (None, None, "en")]
    got = sorted(((r.doc_id is None, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()), key=str)
    assert got == sorted(((d is None, *brute_rules(t)) for d, t, _ in rows), key=str)


def test_simhash_long_text_and_repeated_ids(spark):
    changed = LONG + " more words at the end"
    rows = [(5, LONG), (3, changed), (9, "short one"), (9, "short one"), (None, None)]
    got = simhash.digest(simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    by = {r.fingerprint: r for r in got}
    assert len(got) == len(rows) and {int(f, 16) for f in by} == {brute_print(t) for _, t in rows}
    near = bin(brute_print(LONG) ^ brute_print(changed)).count("1") <= 4
    assert near and {r.component_id for r in got if r.doc_id in (3, 5)} == {3}


def test_mixing_ties(spark):
    # rows that share id and text share their draws; order is by key, id and copy
    rows = [(7, "abc", "a")] * 4 + [(8, "abcd", "b")] * 3
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), total=60.0).collect()
    for doc, n in ((7, 4), (8, 3)):
        copies = [r.copy for r in out if r.doc_id == doc]
        assert all(copies.count(c) == n for c in set(copies))
    assert [r.mix_key for r in out] == sorted(r.mix_key for r in out)


def test_repeated_query_ids_with_other_vectors(spark):
    # of a repeated query id the least vector asks; every row of another id is a candidate
    rows = [(5, [3.0, 0.0]), (5, [0.0, 2.0]), (6, [1.0, 5.0]), (7, [4.0, 1.0]), (7, [4.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0)
    scale = 256 * 256
    assert sorted(tuple(r) for r in got.collect()) == [(5, 1, 6, 10 * scale), (5, 2, 7, 2 * scale), (5, 3, 7, 2 * scale)]
