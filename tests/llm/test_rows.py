"""Top-k, mixing, packing, rules, chat and classifier against brute force, and their edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.llm import chat, mixing, packing, quality, rules, topk

R = np.random.default_rng(9)


# --- top-k ------------------------------------------------------------------------


def brute_topk(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 2048])
def test_topk(spark, monkeypatch, chunk):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    centers = R.normal(size=(5, 40))
    rows = [(i, (centers[i % 5] + 0.3 * R.normal(size=40)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[10][1]) for i in range(9)] + [(300, None), (301, [None] * 40), (302, [math.nan] * 40), (303, [math.inf] * 40), (305, [0.0] * 40), (310, rows[1][1][:11]), (None, rows[1][1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 5, 5)


def test_topk_edges(spark):
    schema = "vec_id long, embedding array<float>, q int, block int, salt int, key int"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).count() == 0
    got = topk.top_k(spark.createDataFrame([(5, [1.0], 1, 2, 3, 4), (5, [1.0], 1, 2, 3, 4), (7, [2.0], 1, 1, 1, 1)], schema), F.col("vec_id") % 5 == 0).collect()
    assert [tuple(r) for r in got] == [(5, 1, 7, 256 * 512)]
    big = [(1, [1e12, 1.0]), (5, [1e12, 2.0])]
    assert topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0).first().score == 2**63 - 1


# --- mixing -----------------------------------------------------------------------


def test_mixing_reaches_its_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("none", 5.0)], "source string, weight double")
    out = mixing.mix(docs, weights, total=60000.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    goal = {"big": 6000 / 9, "small": 6000 * 3 / 9}
    for s, want in goal.items():  # the weight of an absent source is shared by the others
        assert abs(n[s] - want * 9 / 4) < 5 * math.sqrt(want * 9 / 4)
    rows = out.select("mix_key").toPandas().mix_key.tolist()
    assert rows == sorted(rows) and out.groupBy("doc_id", "copy").count().where("count > 1").isEmpty()


def test_poisson_inverts_the_distribution(spark):
    for mean in (0.3, 2.5, 8.0):
        us = [0.0, 0.1, 0.5, 0.9, 0.999]
        got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson(F.lit(mean), F.col("u"))).collect()]
        want = []
        for u in us:
            n, p, c = 0, math.exp(-mean), math.exp(-mean)
            while c <= u:
                n += 1
                p *= mean / n
                c += p
            want.append(n)
        assert got == want


def test_mixing_edges(spark):
    schema = "doc_id long, text string, source string, mean double, copy int, mix_key string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, 1.0, 1, "a"), (1, "", "a", 1.0, 1, "a"), (1, "", "a", 1.0, 1, "a"), (2, "x" * 50000, "b", 1.0, 1, "a")]
    out = mixing.mix(spark.createDataFrame(rows, schema), total=1e6)
    assert {r.source for r in out.collect()} == {None, "a", "b"} and out.where("doc_id = 1").count() % 2 == 0


# --- packing ----------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_files()[0])
    texts = ["Hello  world\n\nagain", "", None, "a b\t\tc  ", " <|endoftext|> x", "tab \n\nnbsp   wide", "don't we're \r\n 123,456!! été", "x " * 3000, "\x1c \x85 q", "日本語 text 🙂🙂", " lead"] * 3
    rows = list(enumerate(texts))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    ids, at = {}, []
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(ids.setdefault(r.doc_id, []))
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        at.append((r.sequence_id, r.offset, r.length))
    assert ids == {d: whole.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows}
    assert all(r.doc_tokens == len(ids[r.doc_id]) for r in got)
    place = 0
    for s, o, n in sorted(at):
        assert s * 1024 + o == place and o + n <= 1024 and n > 0
        place += n
    d = packing.digest(packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))).first()
    assert d.ids_crc32 == zlib.crc32(np.array(ids[3][:0] + whole.encode("a b", add_special_tokens=False).ids + [0], "<u4").tobytes())


def test_packing_edges(spark):
    schema = "doc_id long, text string, part int, base int, begin int, ids int"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a", 1, 2, 3, 4), (1, "a", 1, 2, 3, 4), (1, "a", 1, 2, 3, 4)]
    assert packing.pack(spark.createDataFrame(rows, schema)).count() == 3


# --- rules ------------------------------------------------------------------------


def brute_rules(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\x0b\x0c\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_rules(spark):
    vocab = ["the", "of", "été", "Straße", "x|y", "#a", "日本"] + [f"w{i}" for i in range(30)]
    texts = [None, "", " \n ", "a b c d e f g a b c d e", "same line\nsame line\n\nsame line\n", "x " * 40, "  nbsp word"]
    texts += [R.choice([" ", "\n"]).join(R.choice(vocab, R.integers(1, 90))) for _ in range(60)]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t), t
        assert not (r.base_failed and r.kept)


def test_rules_reject_a_foreign_histogram(spark):
    plain = [(i, " ".join(R.choice(["the", "of", "and", "house", "river", "tree", "walks", "slowly"], 80)), "en") for i in range(60)]
    odd = (99, " ".join(f"{i}|{i * 7}" for i in range(80)), "en")
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame([*plain, odd], "doc_id long, text string, lang string")).collect()}
    assert not got[99].kept and not got[99].base_failed and got[99].class_distance > max(got[i].class_distance for i in range(60))
    schema = "doc_id long, text string, lang string, words int, grams int, lines int, common int, ref_lang int"
    assert rules.quality_rules(spark.createDataFrame([], schema)).count() == 0


# --- chat -------------------------------------------------------------------------


def test_chat(spark):
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more")]
    convs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "no")], 6: [("user", None), (None, "x")], 7: [("system", "hi")], 8: a[1:]}
    rows = [(c, i, r, t, "x", 0) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "hi", "x", 0)]
    schema = "conv_id long, turn long, role string, text string, rendered string, i int"
    got = {r.conv_id: r for r in chat.maximal_chats(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    assert set(got) == {3, 5, 6, 7, 8} and got[3].n_turns == 3
    assert got[3].rendered == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a)
    assert chat.maximal_chats(spark.createDataFrame([], schema)).count() == 0


# --- classifier -------------------------------------------------------------------


def test_quality_classifier_separates_held_out_rows(spark):
    good = [" ".join(R.choice(["the", "river", "runs", "to", "sea", "and", "hills", "are", "green."], 60)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in R.choice(["buy", "now", "cheap", "deal", "win"], 60)) for _ in range(80)]
    texts = [*good, *bad]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(230)], "doc_id long, quality int")
    out = quality.classify(docs, labels).toPandas().set_index("doc_id")
    held = out[out.held_out & (out.index < 230)]
    assert all(held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.index]) and len(out) == 232
    assert ((held.score >= 0.5) == (held.index < 150)).mean() > 0.98 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()


def brute_features(text):
    """One text's vector, symbol by symbol."""
    b, x = (text or "").encode(), np.zeros(quality.DIMENSIONS, np.float32)
    pairs = Counter((a * 257 + c) * 2654435761 % 2**64 // 128 % 1024 for a, c in zip(b, b[1:]))
    hashes, _ = quality.words(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    bag = Counter(int(h) // 2**20 % 992 for h in hashes)
    for p, n in pairs.items():
        x[p] = math.log1p(n)
    for p, n in bag.items():
        x[1024 + p] = math.log1p(n)
    if len(hashes):
        weight = math.sqrt(float((x.astype(np.float64) ** 2).sum())) / 4
        again = len(hashes) - len(set(hashes.tolist()))
        follow = sum(a == c for a, c in zip(hashes.tolist(), hashes.tolist()[1:]))
        x[2016 + min(int(32 * again / len(hashes)) // 2, 15)] = weight
        x[2032 + min(int(64 * follow / len(hashes)) // 2, 15)] += weight
    return x


def test_quality_against_brute_force(spark):
    """Vectors, latent space, cosine and vote, one document and one exemplar at a time; repeated exemplars are ties."""
    vocab = [f"w{i}" for i in range(60)] + ["The", "été", "!!"]
    texts = [" ".join(R.choice(vocab, R.integers(1, 60))) for _ in range(90)] + [None, "", "a a a a"]
    texts += texts[:30] + [" ".join(R.choice(vocab, 30_000))]
    marks = {i: int(R.integers(0, 2)) for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.score for r in quality.classify(docs, spark.createDataFrame(list(marks.items()), "doc_id long, quality int")).collect()}
    known = [i for i in sorted(marks) if zlib.crc32(str(i).encode()) % 5]
    x = np.array([brute_features(texts[i]) for i in known]).astype(np.float16).astype(np.float32)
    y = [marks[i] for i in known]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    unit = x * idf
    unit /= np.maximum(np.sqrt((unit**2).sum(axis=1, keepdims=True)), 1e-9)
    _, vectors = np.linalg.eigh((unit.T @ unit).astype(np.float64))
    basis = vectors[:, ::-1][:, : quality.LATENT]
    stars = [v @ basis for v in unit.astype(np.float64)]
    for i, t in enumerate(texts):
        z = (brute_features(t).astype(np.float64) * idf) @ basis
        size = math.sqrt(float(z @ z))
        if size < 1e-6:
            empty = [m for s, m in zip(stars, y) if math.sqrt(float(s @ s)) < 1e-6]
            assert abs(out[i] - sum(empty or y) / len(empty or y)) < 1e-6
            continue
        cosine = [float(z @ s) / size / max(math.sqrt(float(s @ s)), 1e-9) for s in stars]
        order = sorted(range(len(known)), key=lambda j: (-round(cosine[j], 5), j))[: quality.NEIGHBOURS]
        edge = sorted((round(c, 5) for c in cosine), reverse=True)
        weight = [max(cosine[j], 0) ** 4 + 1e-9 for j in order]
        want = sum(w * y[j] for w, j in zip(weight, order)) / sum(weight)
        room = 2e-3 if edge[quality.NEIGHBOURS - 1] - edge[quality.NEIGHBOURS] > 2e-5 else 0.08  # single precision may swap two at the border
        assert abs(out[i] - want) < room, (i, out[i], want)


def test_labels_without_documents_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(quality, "EXEMPLARS", 40)
    docs = spark.createDataFrame([(i, f"w{i % 7} text of {i}") for i in range(60)] + [(3, f"other text {i}") for i in range(80)], "doc_id long, text string")
    orphans = spark.range(1000, 61_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    some = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    usable = [i for i in range(30) if i != 3 and zlib.crc32(str(i).encode()) % 5]
    plain = quality.fit(docs.where("doc_id <> 3"), some)
    model = quality.fit(docs.where("doc_id <> 3"), some.unionByName(orphans))
    assert len(plain["y"]) == len(model["y"]) == len(usable)
    # an id with more texts than there are places
    assert len(quality.fit(docs, some.unionByName(orphans))["y"]) == 40


def test_ties_go_to_the_smaller_exemplar():
    x = np.eye(4, dtype=np.float32)[[0] * 40]
    y = np.array([1.0] * 25 + [0.0] * 15)
    model = {"projection": np.eye(4, dtype=np.float32), "latent": x, "empty": np.zeros(40, bool), "y": y, "share": 0.5}
    assert quality.vote(model, x[:3]).tolist() == [1.0] * 3


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1, "x"), (1, "a b", 1, "x"), (1, "a b", 1, "x")], "doc_id long, text string, label int, vector string")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * 3
    assert quality.classify(docs.limit(0), none).count() == 0


def test_exemplars_are_not_decomposed_on_the_driver(spark, monkeypatch):
    import numpy as np

    from strandworks.llm import quality

    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} more{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    monkeypatch.setattr(np.linalg, "eigh", lambda x: 1 / 0)  # tasks have processes of their own
    model = quality.fit(docs, labels)
    assert model["latent"].shape == (len(model["y"]), quality.LATENT) and 30 < len(model["y"]) < 60
    assert quality.fit(docs.limit(0), labels)["share"] == 0.5
