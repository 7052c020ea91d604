"""Language identification: held-out accuracy, edge cases, a plain computation of the cosines."""

import numpy as np
from pyspark.sql import functions as F

from strandworks.llm import langid as L

SMALL = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 30 and (got["lang"] == got["lang_pred"]).mean() >= 0.95
    assert got["score"].between(0, 1).all()


def sample():
    words = {"aa": "bana kala mato", "bb": "xix yty zuz", "cc": "größe füße öde"}
    return [(i, " ".join((words[k] + " ").split() * (1 + i % 3)) + f" {i}", k) for i in range(90) for k in [list(words)[i % 3]]]


def test_edges(spark):
    rows = sample() + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 345 .,", None), (1003, "1 \u4e2d", None), (None, "bana kala", None), (1004, "xix yty", None), (1004, "xix yty", None), (1005, "kala " * 200_000, None)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, score string")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.lang_pred, r.score, r.rejected) for i in (1000, 1001, 1002) for r in by[i]] == [("und", 0.0, False)] * 3
    assert by[1003][0].lang_pred in ("aa", "bb", "cc")
    assert by[1003][0].rejected
    assert [r.lang_pred for r in by[1004]] == ["bb", "bb"] and by[None][0].lang_pred == "aa" and not by[None][0].held_out
    assert by[1005][0].lang_pred == "aa"
    right = {i: k for i, _, k in sample()}
    assert all(by[i][0].lang_pred == k for i, k in right.items())


def test_nothing_learnt_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    assert L.identify(spark.createDataFrame([], schema)).collect() == []
    got = L.identify(spark.createDataFrame([(1, "abc", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_blocks_of_languages_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, lang string")
    one = sorted(L.identify(docs).collect())
    monkeypatch.setattr(L, "BLOCK", 1)
    monkeypatch.setattr(L, "FEW", 2)
    two = sorted(L.identify(docs).collect())
    assert [(r.doc_id, r.lang_pred, r.rejected) for r in one] == [(r.doc_id, r.lang_pred, r.rejected) for r in two]
    assert np.allclose([r.score for r in one], [r.score for r in two])


def test_nearest_centroid_by_hand(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, lang string")
    model = L.fit(docs)
    cents = model["centroids"].toPandas()
    assert set(cents["lang"]) == {"aa", "bb", "cc"} and cents.groupby("lang").size().max() <= L.CENTROIDS
    vectors = np.stack([np.frombuffer(v, np.float32) for v in cents["centroid"]])
    for r in L.predict(docs, model).collect():
        raw = r.text.encode()
        x = L.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) * model["idf"].value
        cosine = (x / np.linalg.norm(x)) @ vectors.T
        assert r.lang_pred == cents["lang"][int(np.argmax(cosine))]


def test_features_do_not_cross_texts():
    a, b = "abcd".encode(), "efg hij".encode()
    both = L.features(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a), len(a) + len(b)]))
    assert (both[0] == L.features(np.frombuffer(a, np.uint8), np.array([0, len(a)]))[0]).all()
    assert not both[1].any()
    assert (both[2] == L.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]).all()
