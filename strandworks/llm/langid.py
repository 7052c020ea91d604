"""Language identification by the nearest of several centroids per language.

Method: a text becomes a normalised tf-idf vector of its letter pairs and
triples (bytes of the lower-cased text, everything else one space, hashed to
``DIMENSIONS`` places).  Document frequencies are counted over all learnt texts.
Of each language at most ``SAMPLE`` learnt texts (a documented bound; the least
by hash) are clustered by cosine into up to ``CENTROIDS`` groups, each with the
largest distance of its members; groups under ``LEAST_SHARE`` are dropped.  A text takes the language of the centroid of
the greatest cosine; if it is further away than ``SLACK`` times that centroid's
members, it is rejected.

Centroids meet the texts ``BLOCK`` languages at a time, each block broadcast on
its own (BLOCK x CENTROIDS x DIMENSIONS numbers), so any number of languages works.

Results in edge cases
  * null texts and texts without a letter are ``und`` with score 0, not rejected.
  * rejected texts keep the nearest language with their score, marked in ``rejected``.
  * ties go to the language that sorts first; without any learnt text all are ``und``.
  * null langs are not learnt from; a null id is learnt from and not held out.
  * repeated rows are rows like others; other columns are ignored whatever their
    names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, stage, text_buffer

DIMENSIONS, SAMPLE, CENTROIDS, ROUNDS = 4096, 500, 4, 8
#: Groups with a smaller share of their language's sample are dropped.
LEAST_SHARE = 0.1
SLACK, BLOCK, FOLDS, HELD = 1.25, 512, 4, 2
#: Languages whose sizes are sent to every task; those of more are joined by shuffle.
FEW = 10_000
#: The score is the share of the best language among all, cosines sharpened by this.
SHARP = 20.0
UNKNOWN = "und"
_PAIRS = 1024

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Dampened counts of letter pairs and triples, one row a text."""
    n = len(offs) - 1
    x = _FOLD[data].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offs))
    # a text's first letter follows a space, and spaces count once
    before = np.concatenate(([32], x[:-1]))
    before[offs[:-1][offs[:-1] < len(x)]] = 32
    stay = ~((x == 32) & (before == 32))
    x, row = x[stay], row[stay]
    a, b = x[:-1], x[1:]
    same = row[:-1] == row[1:]
    two = row[:-1] * DIMENSIONS + ((a * 256 + b) * 40503 >> 6) % _PAIRS
    three = row[:-2] * DIMENSIONS + _PAIRS + ((a[:-1] * 65536 + b[:-1] * 256 + x[2:]) * 2654435761 >> 15) % (DIMENSIONS - _PAIRS)
    keys = np.concatenate((two[same], three[same[:-1] & same[1:]])) if len(x) > 2 else two[same]
    return np.sqrt(np.bincount(keys, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32))


def _blocks(column: pa.Array):
    """Features of bounded runs of rows."""
    data, offs = text_buffer(column)
    for i, j in slices(offs):
        for k in range(i, j, 1024):
            m = min(k + 1024, j)
            yield k, m, features(data[offs[k] : offs[m]], offs[k : m + 1] - offs[k])


def _frequencies(batches):
    total = np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for _, _, x in _blocks(batch.column(0)):
            total += (x > 0).sum(axis=0)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "texts"])


def _normalised(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = x * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _clusters(idf: np.ndarray):
    """Spherical k-means of one language's sample, started at even steps away from its middle."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "text"])  # the same centroids whatever the order of the rows
        data, offs = text_buffer(pa.array(rows["text"], pa.string()))
        x = _normalised(features(data, offs), idf)
        middle = np.argsort(-(x @ x.sum(axis=0)), kind="stable")
        c = x[middle[np.arange(min(CENTROIDS, len(x))) * len(x) // CENTROIDS]]
        for _ in range(ROUNDS):
            near = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        # small groups are outliers, such as texts with a wrong language
        size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
        c = c[size >= max(LEAST_SHARE * len(x), 1)]
        cosine = x @ c.T
        near, best = np.argmax(cosine, axis=1), cosine.max(axis=1)
        reach = [float(1 - best[near == k].min()) if (near == k).any() else 0.0 for k in range(len(c))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "reach": reach})

    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> dict:
    """Weights of the places, and the centroids (language, vector, reach), written in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), docs[key_col].cast("string").alias("key"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.select("text").mapInArrow(_frequencies, "place long, texts long").groupBy("place").agg(F.sum("texts").alias("texts")).toPandas()  # DIMENSIONS rows
    sizes, _ = stage(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    total, few = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*") <= FEW).first()
    df = np.zeros(DIMENSIONS)
    df[counts["place"].to_numpy(np.int64)] = counts["texts"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    # about twice the sample by hash of id and text, then the least of it; both bounds hold for every language
    place = F.shiftrightunsigned(F.xxhash64("key", "text"), 1)
    # texts stay where they are, unless there are more languages than every task should know
    drawn = rows.join(F.broadcast(sizes) if few else sizes, "lang").withColumn("place", place).where(F.col("place") < 2.0 * SAMPLE / F.col("n") * 2.0**63).drop("n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    sample = drawn.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("lang", "text", "place")
    found, _ = stage(sample.groupBy("lang").applyInPandas(_clusters(idf), "lang string, centroid binary, reach double"), "centroids")
    langs = found.select("lang").distinct().orderBy("lang")
    return {"idf": spark.sparkContext.broadcast(idf), "centroids": found, "langs": langs}


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and rejected; columns of these names are replaced."""
    spark = docs.sparkSession
    new = ("lang_pred", "score", "rejected")
    rest = docs.drop(*[c for c in docs.columns if c in new])
    names = [r[0] for r in model["langs"].toLocalIterator()]
    at, idf = rest.columns.index(text_col), model["idf"]
    state = "best struct<lang:string,cosine:double,reach:double,total:double>"
    kind = pa.struct([("lang", pa.string()), ("cosine", pa.float64()), ("reach", pa.float64()), ("total", pa.float64())])
    ddl = rest._jdf.schema().toDDL()
    out = rest.withColumn("best", F.lit(None).cast("struct<lang:string,cosine:double,reach:double,total:double>"))
    for i in range(0, len(names), BLOCK):
        block = model["centroids"].where(F.col("lang").isin(names[i : i + BLOCK])).toPandas().sort_values(["lang", "centroid"])
        vectors = np.frombuffer(b"".join(block["centroid"]), np.float32).reshape(-1, DIMENSIONS)
        shared = spark.sparkContext.broadcast((vectors, block["lang"].to_numpy(), block["reach"].to_numpy()))

        def run(batches, shared=shared):
            vectors, langs, reach = shared.value
            first = np.flatnonzero(np.concatenate(([True], langs[1:] != langs[:-1])))
            for batch in batches:
                rows = []
                had = batch.column(batch.num_columns - 1).to_pylist()
                for k, m, x in _blocks(batch.column(at)):
                    cosine = _normalised(x, idf.value) @ vectors.T
                    by_lang = np.maximum.reduceat(cosine, first, axis=1)
                    near = np.argmax(cosine, axis=1)
                    share = np.exp(SHARP * (by_lang.astype(np.float64) - 1)).sum(axis=1)
                    for d, old in enumerate(had[k:m]):
                        c = float(cosine[d, near[d]])
                        old = old or {"lang": None, "cosine": -1.0, "reach": 0.0, "total": 0.0}
                        new = {"lang": langs[near[d]], "cosine": c, "reach": float(reach[near[d]])} if c > old["cosine"] else old
                        rows.append(new | {"total": old["total"] + float(share[d])})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], [*batch.schema.names[:-1], "best"])

        out = out.mapInArrow(run, f"{ddl}, {state}")
    lettered = F.coalesce(out[text_col].cast("string").rlike(r"\p{L}"), F.lit(False)) & F.col("best").isNotNull()
    share = F.exp(SHARP * (F.col("best.cosine") - 1)) / F.col("best.total")
    return out.withColumns({
        "lang_pred": F.when(lettered, F.col("best.lang")).otherwise(UNKNOWN),
        "score": F.when(lettered, F.least(F.lit(1.0), share)).otherwise(0.0),
        "rejected": lettered & (1 - F.col("best.cosine") > SLACK * F.col("best.reach")),
    }).drop("best")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learnt from the documents that are not held out."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    model = fit(rows.where(~held))
    return predict(rows.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
