"""Suffix-array dedup: remove every byte covered by a ``length``-byte string that occurs twice.

Method: each shard sorts its suffixes by external induced sorting
(:mod:`.suffix_sort`); neighbours whose common prefix reaches ``length`` start a
repeated string.  :mod:`.repeats` routes the text to shards.  A usual shard is
larger than the sorter's limits, so its tuples go through scratch files and its
S* suffixes through several levels of induction.

Results in edge cases
  * null text counts as empty; empty and short texts lose nothing.
  * both (all) occurrences of a repeated string go, the first included, also
    within one document; matches never cross documents.
  * rows that repeat a ``doc_id``, or have none, are judged like other rows, each by
    its own text: an equal row is another occurrence.
  * other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import idle, text_buffer
from .repeats import beside, covered, keyed, lone_pieces, repeated_windows, shards
from .suffix_sort import scratch, suffix_buckets

LENGTH, ANCHOR = 200, 32
#: Bytes of distinct pieces that one suffix array covers; a larger single shard is sorted whole, from disk.
SHARD_BYTES = 1 << 22


def shard_repeats(bodies: list[bytes], length: int, **limits) -> np.ndarray:
    """For the pieces laid end to end (one separator each): which positions start a repeated string."""
    text = scratch(sum(len(b) + 1 for b in bodies) + 1, np.int32)
    at = 0
    for i in range(0, len(bodies), 1000):
        part = bodies[i : i + 1000]
        end = at + sum(len(b) + 1 for b in part)
        text[at:end] = np.frombuffer(b"".join(x for b in part for x in (b, b"\0")), np.uint8).astype(np.int32) + 2
        text[at + np.cumsum([len(b) + 1 for b in part]) - 1] = 1
        at = end
    text[at] = 0
    hit = np.zeros(len(text), bool)
    for pos, lcp in suffix_buckets(text, length, **limits):
        i = np.flatnonzero(lcp >= length)
        hit[pos[i]] = True
        hit[pos[i - 1]] = True
    return hit[:-1]


def _judge(length: int):
    def run(batches):
        for table in shards(batches, SHARD_BYTES):
            size, n = table.column("size").to_numpy(), table.column("n").to_numpy()
            alone, group = lone_pieces(table.column("shard").to_numpy())
            # a lone piece has nothing to meet; where every piece has copies, every window repeats
            single = np.bincount(group, n == 1) > 0
            sort = np.flatnonzero(~alone & single[group])
            bodies = table.column("body").take(pa.array(sort)).to_pylist()
            hit = shard_repeats(bodies, length) if bodies else np.zeros(0, bool)
            ends = np.cumsum([len(b) + 1 for b in bodies])
            whole = np.flatnonzero(n > 1)
            piece, lo, hi = whole.tolist(), [0] * len(whole), size[whole].tolist()
            for p, b in zip(sort.tolist(), [0, *ends.tolist()]):
                if n[p] == 1:
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[b : b + size[p]], [False]))))
                    piece += [p] * (len(edge) // 2)
                    lo += edge[::2].tolist()
                    hi += edge[1::2].tolist()
            at = pa.array(piece, pa.int64())
            keys = [table.column(c).combine_chunks().take(at) for c in ("shard", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["shard", "h1", "h2", "from", "to"])
        idle()

    return run


def _place(rows: DataFrame) -> DataFrame:
    return rows.select("row", "doc_id", (F.col("start") + F.col("from")).alias("lo"), (F.col("start") + F.col("to")).alias("hi"))


def _ranges(docs: DataFrame, length: int) -> DataFrame:
    return repeated_windows(docs, "byte", length, min(ANCHOR, length), _judge(length), "from int, to int", _place)


def _cut(length: int):
    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            rows = []
            for i, ranges in enumerate(batch.column(2).to_pylist()):
                body = data[offs[i] : offs[i + 1]]
                gone = covered(len(body), ranges, length) if ranges else None
                kept = body.tobytes() if gone is None else body[~gone].tobytes()
                spans = [] if gone is None else np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).reshape(-1, 2).tolist()
                rows.append((len(body), len(body) - len(kept), spans, kept))
            n, gone, spans, kept = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([[{"from": a, "to": b} for a, b in s] for s in spans], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed byte ranges) and kept (the remaining bytes)."""
    docs = keyed(docs, id_col, text_col)
    ranges = _ranges(docs, length)
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept binary"
    return beside(docs, ranges).mapInArrow(_cut(length), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of their texts; a character cut in part goes whole."""
    ranges = _ranges(keyed(docs, id_col, text_col), length)
    at, names = docs.columns.index(text_col), list(docs.columns)

    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(at))
            texts = batch.column(at).to_pylist()
            for i, cuts in enumerate(batch.column(len(names)).to_pylist()):
                if cuts:
                    body = data[offs[i] : offs[i + 1]]
                    texts[i] = body[~covered(len(body), cuts, length)].tobytes().decode("utf-8", "ignore")
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return beside(docs, ranges, id_col, text_col).mapInArrow(run, docs.schema)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
