"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Method: texts become tf-idf vectors over hashed byte pairs, words and repeat
marks; a singular value decomposition of the exemplars' vectors gives the latent
space.  At most ``EXEMPLARS`` labelled rows with a document (the least by hash of their id) are
exemplars: this documented bound fixes the size of what is broadcast, EXEMPLARS x
LATENT floats and the projection.  Every document is compared with every
exemplar by exact blocked cosine products, and its ``NEIGHBOURS`` nearest vote
for their labels, weighted by similarity; of equally near exemplars the smaller
ids vote.

Results in edge cases
  * null, empty and blank texts have a zero vector, similar to nothing: their
    score is the weighted share of good exemplars among the empty ones if any
    exemplar is empty, else the share of good exemplars.
  * labels that are null, of other values than 0 and 1, of unknown or null ids
    are not learnt from; an id with several labels contributes each once.
  * without any usable label every score is 0.5.
  * repeated rows and null ids are scored like other rows; other columns are
    ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_buffer, words
from .repeats import keyed

EXEMPLARS, LATENT, NEIGHBOURS = 4096, 64, 25
DIMENSIONS = 2048
FOLDS, THRESHOLD = 5, 0.3


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Dampened counts, one row of DIMENSIONS a text: byte pairs, words, repeated words, each in its own part."""
    n = len(offs) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    for i, j in slices(offs):
        part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        m = j - i
        row = np.repeat(np.arange(m), np.diff(po))
        pairs = part[:-1].astype(np.int64) * 257 + part[1:]
        same = row[:-1] == row[1:]
        pairs = (pairs * 2654435761 >> 7) % 1024
        count = np.bincount((row[:-1] * 1024 + pairs)[same], minlength=m * 1024).reshape(m, 1024)
        hashes, wo = words(part, po)
        wrow = np.repeat(np.arange(m), np.diff(wo))
        # the order of a row's equal words: the second and later ones are repeats
        order = np.lexsort((hashes, wrow))
        hs, rs = hashes[order], wrow[order]
        again = np.zeros(len(hs), bool)
        again[1:] = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
        bag = (hs >> np.uint64(20)).astype(np.int64) % 992
        word_count = np.bincount(rs * 992 + bag, minlength=m * 992).reshape(m, 992)
        total = np.maximum(np.diff(wo), 1)
        repeats = np.bincount(rs[again], minlength=m)
        follow = np.bincount(wrow[1:][(hashes[1:] == hashes[:-1]) & (wrow[1:] == wrow[:-1])], minlength=m) if len(hashes) else np.zeros(m)
        share = np.minimum((32 * repeats / total).astype(int) // 2, 15)
        near = np.minimum((64 * follow / total).astype(int) // 2, 15)
        x = out[i:j]
        x[:, :1024] = np.log1p(count)
        x[:, 1024:2016] = np.log1p(word_count)
        some = np.diff(wo) > 0
        weight = np.sqrt((x * x).sum(axis=1)) / 4
        x[np.arange(m), 2016 + share] = np.where(some, weight, 0)
        x[np.arange(m), 2032 + near] += np.where(some, weight, 0)
    return out


def _vectors(batches):
    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        x = features(data, offs).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "place", "vector"])


def _model(batches):
    """One row: the exemplars' latent space, from their vectors; no row without exemplars."""
    got = [batch for batch in batches if batch.num_rows]
    if not got:
        return
    ids, y, place = (np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for batch in got]) for c in range(3))
    x = np.concatenate([np.frombuffer(v.as_buffer(), np.float16) for batch in got for v in batch.column(3)]).reshape(-1, DIMENSIONS)
    del got
    order = np.lexsort((place, y, ids))  # the same model whatever the order of the rows
    x, y = x[order].astype(np.float32), y[order]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = (vectors[:, ::-1][:, :LATENT] * idf[:, None]).astype(np.float32)
    latent = x @ vectors[:, ::-1][:, :LATENT].astype(np.float32)
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    row = [projection.tobytes(), (latent / np.maximum(norm, 1e-9)).tobytes(), (norm[:, 0] < 1e-6).tobytes(), y.tobytes(), float(y.mean())]
    names = ["projection", "latent", "empty", "y", "share"]
    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: str = "quality", folds: int = FOLDS) -> dict:
    """Exemplars in latent space.  Only labels of ids whose crc32 is not a multiple of ``folds`` are used."""
    text_id = F.col("doc_id").cast("string")
    usable = (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0.0, 1.0) & (F.crc32(text_id.cast("binary")) % folds != 0)).distinct()
    )
    order = F.md5(F.concat(F.lit(seed), text_id))
    # only labels that have a document take a place, and an id with many texts takes no more places than there are
    found = keyed(docs, id_col, text_col).select("doc_id").join(usable, "doc_id").distinct()
    chosen = found.orderBy(order, "doc_id", "label").limit(EXEMPLARS)
    rows = keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "label", "text"])
    vectors = rows.select("doc_id", "text", "label", F.xxhash64("text").alias("place")).mapInArrow(_vectors, "doc_id long, label double, place long, vector binary")
    # one task on bounded input: the algebra's copies of a few hundred MB stay off the driver, which gets the model alone
    made = vectors.orderBy(order, "doc_id", "label", "place").limit(EXEMPLARS).mapInArrow(_model, "projection binary, latent binary, empty binary, y binary, share double").toArrow()
    if not made.num_rows:
        return {"share": 0.5, "y": np.zeros(0)}
    row = made.to_pylist()[0]
    projection, latent = (np.frombuffer(row[c], np.float32).reshape(-1, LATENT) for c in ("projection", "latent"))
    return {"projection": projection, "latent": latent, "empty": np.frombuffer(row["empty"], bool), "y": np.frombuffer(row["y"]), "share": row["share"]}


def vote(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows, a block at a time."""
    y = model["y"]
    if not len(y):
        return np.full(len(x), 0.5)
    empty = float(y[model["empty"]].mean()) if model["empty"].any() else model["share"]
    out = np.empty(len(x))
    k = min(NEIGHBOURS, len(y))
    for i in range(0, len(x), 512):
        z = x[i : i + 512] @ model["projection"]
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        cosine = (z / np.maximum(norm, 1e-9)) @ model["latent"].T
        # the k nearest; of those equally near to the last one, the first exemplars
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        nearer, level = cosine > last, cosine == last
        chosen = nearer | (level & (np.cumsum(level, axis=1) <= k - nearer.sum(axis=1, keepdims=True)))
        weight = np.where(chosen, np.maximum(cosine, 0).astype(np.float64) ** 4 + 1e-9, 0)
        score = (weight @ y) / weight.sum(axis=1)
        out[i : i + 512] = np.where(norm[:, 0] < 1e-6, empty, score)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and quality_score; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("quality_score") if "quality_score" in docs.columns else docs
    at = rest.columns.index(text_col)
    schema = f"{rest._jdf.schema().toDDL()}, quality_score double"

    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(at))
            parts = [vote(shared.value, features(data[offs[i] : offs[min(i + 1024, len(offs) - 1)]], offs[i : i + 1025] - offs[i])) for i in range(0, len(offs) - 1, 1024)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "quality_score"])

    return rest.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score(keyed(docs, "doc_id", "text"), fit(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
