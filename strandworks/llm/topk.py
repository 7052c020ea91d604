"""Exact top-k inner products by columnar branch and bound.

Method: candidates are packed into chunks stored dimension by dimension.  The
scores of a block of queries against a chunk grow one block of dimensions at a
time; after each, the pairs whose score plus the largest product the remaining
mass allows (Cauchy-Schwarz on the norms of the rest) lies below the query's floor
are compacted away.  The floor is the k-th best score the query has met so far.

Queries and candidates meet in a grid: query blocks of a fixed size times groups
of chunks.  A cell is one task's work: its query block comes first, then the
chunks of its group one by one, and floors are carried from chunk to chunk.  With
few queries the grid has many groups and it is the query blocks that are repeated;
chunks are repeated once per ``QUERY_BLOCK`` queries only.

Results in edge cases
  * components become floor(scale * x), saturated to 64 bits; a vector that is
    null or holds a null, NaN or infinite component takes no part.
  * vectors of other lengths are padded with zeros; scores beyond 64 bits saturate.
  * a query's own row is every row with its id; rows that repeat an id are
    candidates each, and a repeated query id is one query with its least vector.
  * ties go to the smaller id; rows without id are no candidates and no queries;
    other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

TOP, SCALE, EVERY = 5, 256, 50
#: Queries of a block, candidates of a chunk, dimensions of a block, queries scored at once.
QUERY_BLOCK, CHUNK, DIMENSIONS, AT_ONCE = 8192, 2048, 16, 64
#: Cells of the grid to aim at while there are chunks for them, bytes of chunks a cell reads at most, and partitions at most.
CELLS, CELL_BYTES, PARTS = 128, 64 << 20, 10_000
_EXACT = float(2**53)
_PACKED = "place int, ids binary, columns binary"


def _pack(size, stride):
    """Chunks of at most ``size`` rows: a place, ids, and the components by dimension (int64, dimension-major, compressed)."""

    def run(batches):
        task, i, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors = part.column(1)
                width = np.diff(vectors.offsets.to_numpy())
                m = np.zeros((int(width.max(initial=0)), len(vectors)), np.int64)
                row = np.repeat(np.arange(len(vectors)), width)
                m[np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width), row] = vectors.flatten().to_numpy()
                ids = part.column(0).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([task + i * stride], pa.int32()), pa.array([ids.tobytes()]), pa.array([pack.compress(m.tobytes())])], ["place", "ids", "columns"])
                i += 1

    return run


class Best:
    """The k best candidates each query of a block has met so far; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        """vectors: (queries, dimensions) integers."""
        self.ids, self.vectors, self.k = ids, vectors, k
        self.top_ids, self.top = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.have = np.zeros(len(ids), np.int64)

    def floors(self) -> np.ndarray:
        """Score that a candidate must reach to be among the best."""
        return np.where(self.have == self.k, self.top[:, -1].astype(np.float64), -np.inf)

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of one more chunk: row of the query, id, score."""
        r, c = np.nonzero(np.arange(self.k) < self.have[:, None])
        row, ids, scores = np.concatenate((r, row)), np.concatenate((self.top_ids[r, c], ids)), np.concatenate((self.top[r, c], scores))
        order = np.lexsort((ids, ~scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        row, place = row[best], place[best]
        self.top_ids[row, place], self.top[row, place] = ids[best], scores[best]
        self.have = np.bincount(row, minlength=len(self.ids))

    def table(self) -> pa.RecordBatch:
        r, c = np.nonzero(np.arange(self.k) < self.have[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(self.top_ids[r, c]), pa.array(self.top[r, c])], ["query_id", "vec_id", "score"])


def search_chunk(best: Best, ids: np.ndarray, columns: np.ndarray) -> None:
    """Meet the candidates of one chunk; columns: (dimensions, candidates) integers."""
    d, k = max(best.vectors.shape[1], columns.shape[0]), best.k
    q, c = np.zeros((len(best.ids), d)), np.zeros((d, len(ids)))
    q[:, : best.vectors.shape[1]], c[: columns.shape[0]] = best.vectors, columns
    if not d or np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * d >= _EXACT:  # floats would round: exact Python integers, no bounds
        qi, ci = np.zeros((len(q), max(d, 1)), object), np.zeros((max(d, 1), len(ids)), object)
        qi[:, : best.vectors.shape[1]], ci[: columns.shape[0]] = best.vectors.astype(object), columns.astype(object)
        for i, own in enumerate(best.ids):
            keep = np.flatnonzero(ids != own)
            scores = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in qi[i].dot(ci[:, keep])], np.int64)
            best.add(np.full(len(keep), i), ids[keep], scores)
        return
    by_mass = np.argsort(-(c * c).sum(axis=1), kind="stable")  # heavy dimensions first
    q, c = q[:, by_mass], np.ascontiguousarray(c[by_mass])
    cuts = [*range(0, d, DIMENSIONS), d]
    c_rest = [np.sqrt((c[b:] ** 2).sum(axis=0)) for b in cuts[1:]]
    q_rest = [np.sqrt((q[:, b:] ** 2).sum(axis=1)) for b in cuts[1:]]
    floors, met = best.floors(), []

    def reach(score, rest):
        """The most a score can become, with room for rounding."""
        bound = score + rest
        return bound + 1e-12 * np.abs(bound) + 0.5

    for i in range(0, len(q), AT_ONCE):
        block, foreign = q[i : i + AT_ONCE], best.ids[i : i + AT_ONCE, None] != ids[None, :]
        part, floor = block[:, : cuts[1]] @ c[: cuts[1]], floors[i : i + AT_ONCE].copy()
        new = np.flatnonzero(np.isinf(floor))
        if len(new) and len(ids) > 4 * k:  # exact scores of a few promising candidates give the first floor
            seeds = np.argpartition(-part[new], 4 * k - 1, axis=1)[:, : 4 * k]
            exact = np.einsum("qd,dqm->qm", block[new], c[:, seeds])
            exact[~np.take_along_axis(foreign[new], seeds, axis=1)] = -np.inf
            floor[new] = np.sort(exact, axis=1)[:, -k]
        stay = foreign & (reach(part, q_rest[0][i : i + AT_ONCE, None] * c_rest[0]) >= floor[:, None])
        b = 1
        while b + 1 < len(cuts) and stay.mean() > 0.25:  # too many to gather: whole columns
            part += block[:, cuts[b] : cuts[b + 1]] @ c[cuts[b] : cuts[b + 1]]
            stay &= reach(part, q_rest[b][i : i + AT_ONCE, None] * c_rest[b]) >= floor[:, None]
            b += 1
        row, at = np.nonzero(stay)
        score = part[row, at]
        while b + 1 < len(cuts):  # the surviving pairs only
            score = score + np.einsum("nd,dn->n", block[row, cuts[b] : cuts[b + 1]], c[cuts[b] : cuts[b + 1], at])
            on = reach(score, q_rest[b][i + row] * c_rest[b][at]) >= floor[row]
            row, at, score = row[on], at[on], score[on]
            b += 1
        met.append((i + row, ids[at], score.astype(np.int64)))
    best.add(*(np.concatenate(x) for x in zip(*met)))


def _search(k):
    """Cells in order, the query block of each before its chunks."""

    def integers(columns, n):
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(columns), np.int64).reshape(-1, n)

    def run(batches):
        best = None
        for batch in batches:
            for is_chunk, ids, columns in zip(*(batch.column(i) for i in range(1, 4))):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                m = integers(columns.as_buffer(), len(ids))
                if is_chunk.as_py():
                    search_chunk(best, ids, m)
                    continue
                if best:
                    yield best.table()
                best = Best(ids, m.T, k)
        if best:
            yield best.table()

    return run


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and q (floor of scaled components) of the vectors that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False))).select("vec_id", F.transform(v, lambda x: F.floor(x * scale)).alias("q"))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query; ``is_query`` tests vec_id."""
    rows = quantised(vectors, id_col, vector_col, scale)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.repartitionById(n, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    blocks, _ = stage(dealt.mapInArrow(_pack(QUERY_BLOCK, n), _PACKED), "queries")
    chunks, _ = stage(rows.mapInArrow(_pack(CHUNK, 1009), _PACKED), "chunks")
    n_blocks = (blocks.agg(F.max("place")).first()[0] or 0) + 1
    n_chunks, size = chunks.agg(F.count("*"), F.sum(F.length("columns"))).first()
    groups = max(1, min(n_chunks, max(-(-CELLS // n_blocks), -(-(size or 0) // CELL_BYTES))))
    group = F.pmod("place", F.lit(groups))
    cells = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.col("place").alias("block"), F.lit(False).alias("is_chunk"), "ids", "columns").unionByName(
        chunks.select(group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("is_chunk"), "ids", "columns"))
    cells = cells.select((F.col("block").cast("long") * groups + F.col("group")).alias("cell"), "is_chunk", "ids", "columns")
    parts = min(n_blocks * groups, PARTS)
    pairs = cells.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "is_chunk")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
