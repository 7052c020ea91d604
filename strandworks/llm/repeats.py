"""Routing of repeated windows to shards, shared by the two exact substring operators.

A window is ``length`` consecutive tokens (words or bytes) of one text.  Each
window has an anchor, a k-gram chosen by content alone, so equal windows have
equal anchors at equal offsets.  Anchors are counted over the whole corpus with
map-side sums; only runs of windows whose anchor occurs at least twice are cut
out as *pieces* and sent to the shard of their anchor, where the operator's own
index decides which windows repeat.  Equal pieces are merged before they travel.
An anchor with more than ``HOT`` different pieces is refined: its pieces are cut
into runs that share a longer anchor as well, in rounds up to anchors as long as
the window, where all pieces of a shard are equal.  So no shard holds a third of
the corpus, and the index decides in every shard.

A row is known by its id and ``row``, a hash of id and text, so rows that repeat
an id with other texts are judged and cut each by their own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BYTES, anchor_runs, byte_codes, mix64, power, release, slices, stage, text_buffer, words

#: Different pieces of an anchor from which longer anchors tell them apart (all of them are still compared).
HOT = 2000
#: Most hot anchors that are sent to every task; beyond it they are joined by shuffle.
FEW = 1 << 18


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, under fixed names, so no other column can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def row_key(id_col, text_col):
    """Hash of id and text; rows of one id are told apart by it."""
    return F.xxhash64(id_col.cast("long"), text_col.cast("string"))


def token_rows(data: np.ndarray, offs: np.ndarray, unit: str, length: int):
    """Bounded parts of a batch: row numbers, first token of each part row, tokens and their offsets."""
    for i, j in slices(offs, SLICE_BYTES):
        part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if j - i > 1 or len(part) <= 2 * SLICE_BYTES:
            t, to = (byte_codes(part), po) if unit == "byte" else words(part, po)
            yield np.arange(i, j), np.zeros(j - i, np.int64), t, to
            continue
        if unit == "byte":  # one long row: parts that overlap by a window less one token
            t = part
        else:
            cuts, spaces = [0], np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            while len(part) - cuts[-1] > 2 * SLICE_BYTES:
                k = np.searchsorted(spaces, cuts[-1] + SLICE_BYTES)
                if k == len(spaces):
                    break
                cuts.append(int(spaces[k]))
            t = np.concatenate([words(part[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, [*cuts[1:], len(part)])])
        for a in range(0, max(1, len(t) - length + 1), SLICE_BYTES):
            x = t[a : a + SLICE_BYTES + length - 1]
            yield np.array([i]), np.array([a]), byte_codes(x) if unit == "byte" else x, np.array([0, len(x)])


def _anchors(unit: str, length: int, k: int):
    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            ids = batch.column(0)
            rows, hashes = [], []
            for row, _, tokens, to in token_rows(data, offs, unit, length):
                r, _, _, h = anchor_runs(tokens, to, k, length)
                rows.append(row[r]), hashes.append(h)
            if not rows:
                continue
            r, h = np.concatenate(rows), np.concatenate(hashes)
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1]))))[: len(r)]
            n = np.diff(np.concatenate((first, [len(r)])))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), ids.take(pa.array(r[first])), pa.array(n.astype(np.int32))], ["anchor", "row", "n"])

    return run


PIECES = "shard long, body binary, row long, doc_id long, start int, size int"


def _bodies(raw: bytes, offs, unit: str, length: int, row, first, size) -> list[bytes]:
    """Text of every run of windows: ``size`` windows from token ``first`` of ``row``."""
    if unit == "byte":
        return [raw[a : a + n] for a, n in zip((offs[row] + first).tolist(), (size + length - 1).tolist())]
    out, at, own = [], -1, []
    for r, a, n in zip(row.tolist(), first.tolist(), size.tolist()):
        if r != at:
            at, own = r, raw[offs[r] : offs[r + 1]].split()
        out.append(b" ".join(own[a : a + n + length - 1]))
    return out


def _pieces(unit: str, length: int, k: int):
    """Runs of windows with a marked anchor, from rows of (row, doc_id, text, marks)."""

    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(2))
            raw = data.tobytes()
            known = np.unique(batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            for row, base, tokens, to in token_rows(data, offs, unit, length):
                r, s, n, h = anchor_runs(tokens, to, k, length)
                if not len(known) or not len(r):
                    continue
                keep = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                r, s, n, h = r[keep], s[keep], n[keep], h[keep]
                at, first = row[r], s + base[r]
                body = _bodies(raw, offs, unit, length, at, first, n)
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(body, pa.binary()), batch.column(0).take(own), batch.column(1).take(own), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["shard", "body", "row", "doc_id", "start", "size"],
                )

    return run


def _refined(unit: str, length: int, k: int):
    """Pieces cut into runs that share an anchor of ``k`` tokens too; shard becomes a hash of both anchors."""

    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            raw, start = data.tobytes(), batch.column(4).to_numpy()
            shard = batch.column(0).to_numpy().view(np.uint64)
            for row, base, tokens, to in token_rows(data, offs, unit, length):
                r, s, n, h = anchor_runs(tokens, to, k, length)
                at, first = row[r], s + base[r]
                body = _bodies(raw, offs, unit, length, at, first, n)
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix64(shard[at] * power(k) + h).view(np.int64)), pa.array(body, pa.binary()), batch.column(2).take(own), batch.column(3).take(own), pa.array((start[at] + first).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["shard", "body", "row", "doc_id", "start", "size"],
                )

    return run


def _hashed(pieces: DataFrame) -> DataFrame:
    """128 bits that stand for a piece's text within its shard."""
    return pieces.withColumns({"h1": F.xxhash64("body"), "h2": F.xxhash64(F.lit(2), "body")})


def _spread(pieces: DataFrame, unit: str, length: int, k: int) -> tuple[DataFrame, list[str]]:
    """``pieces`` with the shards above HOT refined by longer anchors, round by round."""
    ready, paths, rest = None, [], length - k
    while rest:
        # runs inside a common passage settle while they are long; only those at its ends go on to the next anchor
        rest //= 3
        longer = length - rest
        hot, at = stage(pieces.select("shard", "h1", "h2").distinct().groupBy("shard").count().where(F.col("count") > HOT).select("shard"), "hot")
        paths.append(at)
        n_hot = hot.count()
        if not n_hot:
            break
        hot = F.broadcast(hot) if n_hot <= FEW else hot
        cold = pieces.join(hot, "shard", "left_anti").select(*pieces.columns)
        ready = cold if ready is None else ready.unionByName(cold)
        fine, at = stage(_hashed(pieces.join(hot, "shard", "left_semi").select(*pieces.columns).drop("h1", "h2").mapInArrow(_refined(unit, length, longer), PIECES)), "fine")
        paths.append(at)
        # a longer anchor that occurs once has nothing to meet
        pieces = fine.join(fine.groupBy("shard").count().where("count > 1").select("shard"), "shard", "left_semi").select(*fine.columns)
    return pieces if ready is None else ready.unionByName(pieces), paths


def repeated_windows(docs: DataFrame, unit: str, length: int, k: int, judge, judged: str, place) -> DataFrame:
    """Windows to remove, as ranges of window starts: row, doc_id and ranges of the rows that have some.

    ``judge`` reads the distinct pieces of whole shards, in order of the shard and
    then of the first occurrence, and returns (shard, h1, h2, *judged*);
    ``place`` turns a judged row beside an occurrence into a filter and a range.
    """
    spark = docs.sparkSession
    docs = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")
    anchors, at_anchors = stage(docs.select("row", "text").mapInArrow(_anchors(unit, length, k), "anchor long, row long, n int"), "anchors")
    often = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    # equal rows have one key: a set, merged on the map side
    marked = anchors.select("anchor", "row").join(often, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("marks"))
    found = docs.join(marked, "row").select("row", "doc_id", "text", "marks")
    pieces, at_pieces = stage(_hashed(found.mapInArrow(_pieces(unit, length, k), PIECES)), "pieces")
    release(spark, at_anchors)
    pieces, at_fine = _spread(pieces, unit, length, k)
    distinct = pieces.groupBy("shard", "h1", "h2", "body").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"), F.max("size").alias("size")
    )
    verdicts = (
        distinct.select("shard", "h1", "h2", "body", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "n", "size")
        .repartition("shard").sortWithinPartitions("shard", "doc_id", "start").mapInArrow(judge, f"shard long, h1 long, h2 long, {judged}")
    )
    ranges = place(pieces.drop("body", "size").join(verdicts, ["shard", "h1", "h2"]))
    ranges, _ = stage(ranges.groupBy("row", "doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    release(spark, at_pieces, *at_fine)  # before the texts are shuffled once more
    return ranges


def beside(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the ranges of each row in a last column, _ranges."""
    r = ranges.toDF("_row", "_id", "_ranges")
    own = (row_key(docs[id_col], docs[text_col]) == r["_row"]) & docs[id_col].cast("long").eqNullSafe(r["_id"])
    return docs.join(r, own, "left").select(*[docs[c] for c in docs.columns], r["_ranges"])


def shards(batches, limit: int):
    """Tables of whole shards: consecutive pieces, cut where the shard changes and ``limit`` bytes are reached."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column(0).to_numpy()
        ends = np.cumsum(np.diff(np.frombuffer(batch.column(3).cast(pa.large_binary()).buffers()[1], np.int64, len(shard) + 1)))
        change = np.flatnonzero(np.concatenate(([shard[0] != last], shard[1:] != shard[:-1])))
        begin, used = 0, 0
        for c in change:
            here = int(ends[c - 1]) if c else 0
            if size + here - used >= limit and (held or c > begin):
                held.append(batch.slice(begin, c - begin))
                yield pa.Table.from_batches(held)
                held, size, begin, used = [], 0, c, here
        held.append(batch.slice(begin))
        size += int(ends[-1]) - used
        last = shard[-1]
    if held:
        yield pa.Table.from_batches(held)


def lone_pieces(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces (in order of shard) are their shard's only one, and the number of each piece's shard.

    All windows of a piece hold its anchor, each at another offset, so a piece repeats none of its own windows.
    """
    group = np.cumsum(np.concatenate(([True], shard[1:] != shard[:-1]))) - 1 if len(shard) else np.zeros(0, int)
    return np.bincount(group)[group] == 1, group


def covered(n_tokens: int, ranges, length: int) -> np.ndarray:
    """Which tokens lie in a window that starts in one of the ranges; ranges beyond the text are cut off."""
    step = np.zeros(n_tokens + 1, np.int64)
    for r in ranges or ():
        lo, hi = max(0, min(r["lo"], n_tokens)), max(0, min(r["hi"] + length - 1, n_tokens))
        if lo < hi:
            step[lo] += 1
            step[hi] -= 1
    return np.cumsum(step[:-1]) > 0
