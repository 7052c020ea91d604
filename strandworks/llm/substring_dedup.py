"""Substring dedup: remove the words of every ``length``-word window seen earlier in the corpus.

Method: the distinct pieces of a shard, in order of first occurrence, form a
suffix automaton whose states remember where their string was first inserted;
each piece is then streamed through it, and the state of its last ``length``
words tells the earliest occurrence of the window that ends there.
:mod:`.repeats` routes the text to shards.  An automaton stays in the task that
built it: the pieces come to it through the shuffle instead of it being
broadcast, as the reference text (the corpus itself) has no size bound.

Results in edge cases
  * null text has no words; texts with fewer than ``length`` words lose nothing.
  * "earlier" is a smaller doc_id, or an earlier start in the same document;
    windows are judged on the input, so a removed window still counts as earlier.
  * rows that repeat a ``doc_id``, with equal or other texts, stand at the same
    place: of equal windows in them the one of the least start is the earliest, and
    windows of that start are not earlier than each other.  Each row is cut by its
    own text.  A null ``doc_id`` counts as an id before all others.
  * other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_buffer
from .repeats import beside, covered, keyed, lone_pieces, repeated_windows, shards

LENGTH, ANCHOR = 20, 6
#: Bytes of distinct pieces for one automaton; a single shard's pieces are at most HOT short rows.
SHARD_BYTES = 1 << 19


class SuffixAutomaton:
    """Automaton of several texts; ``first[state]`` is the first end position of its strings."""

    def __init__(self):
        self.next, self.link, self.size, self.first = [{}], [-1], [0], [-1]

    def _add(self, size, first):
        self.next.append({}), self.link.append(-1), self.size.append(size), self.first.append(first)
        return len(self.size) - 1

    def _split(self, p, symbol, q):
        clone = self._add(self.size[p] + 1, self.first[q])
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, symbol, at: int) -> int:
        """State after ``symbol``, whose position is ``at``, follows the text of state ``last``."""
        nxt, link, size = self.next, self.link, self.size
        q = nxt[last].get(symbol)
        if q is not None:
            return q if size[q] == size[last] + 1 else self._split(last, symbol, q)
        state = self._add(size[last] + 1, at)
        p = last
        while p != -1 and symbol not in nxt[p]:
            nxt[p][symbol] = state
            p = link[p]
        if p == -1:
            link[state] = 0
        else:
            q = nxt[p][symbol]
            link[state] = q if size[q] == size[p] + 1 else self._split(p, symbol, q)
        return state

    def insert(self, text, at: int) -> None:
        state = 0
        for symbol in text:
            state = self.extend(state, symbol, at)
            at += 1

    def first_ends(self, text, length: int):
        """Matching statistics, cut at ``length``: for each end of a window, the first end of an equal one, or -1."""
        state, have, out = 0, 0, []
        nxt, link, size = self.next, self.link, self.size
        for i, symbol in enumerate(text):
            while state and symbol not in nxt[state]:
                state = link[state]
                have = size[state]
            if symbol in nxt[state]:
                state, have = nxt[state][symbol], have + 1
            while link[state] > 0 and size[link[state]] >= length:
                state = link[state]
            have = min(have, size[state])
            if i >= length - 1:
                out.append(self.first[state] if have >= length else -1)
        return out


def first_windows(pieces: list[list], length: int) -> list[list[tuple[int, int]]]:
    """For each window of each piece, the piece and window start where it first occurs."""
    automaton, begin, total = SuffixAutomaton(), [], 0
    owner: list[int] = []
    for p, text in enumerate(pieces):
        automaton.insert(text, total)
        begin.append(total)
        total += len(text)
        owner += [p] * len(text)
    return [[(owner[e], e - length + 1 - begin[owner[e]]) for e in automaton.first_ends(text, length)] for text in pieces]


def _judge(length: int):
    def run(batches):
        for table in shards(batches, SHARD_BYTES):
            doc, start, size = (table.column(c).to_pylist() for c in ("doc_id", "start", "size"))
            alone, _ = lone_pieces(table.column("shard").to_numpy())
            # a lone piece is the first to hold its windows
            piece = np.flatnonzero(alone).tolist()
            lo, hi, fdoc, fstart = [0] * len(piece), [size[p] for p in piece], [doc[p] for p in piece], [start[p] for p in piece]
            rest = np.flatnonzero(~alone)
            bodies = table.column("body").take(pa.array(rest)).to_pylist()
            rest = rest.tolist()
            for p, found in zip(rest, first_windows([b.split(b" ") for b in bodies], length)):
                before = None
                for i, (q, s) in enumerate(found):
                    if before == (q, s - 1):
                        hi[-1] = i + 1
                    else:
                        piece.append(p), lo.append(i), hi.append(i + 1), fdoc.append(doc[rest[q]]), fstart.append(start[rest[q]] + s)
                    before = (q, s)
            at = pa.array(piece, pa.int64())
            keys = [table.column(c).combine_chunks().take(at) for c in ("shard", "h1", "h2")]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(fdoc, pa.int64()), pa.array(fstart, pa.int32())],
                ["shard", "h1", "h2", "from", "to", "first_doc", "first_start"],
            )

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            raw = data.tobytes()
            n, gone, kept = [], [], []
            for i, ranges in enumerate(batch.column(2).to_pylist()):
                own = raw[offs[i] : offs[i + 1]].split()
                n.append(len(own))
                if ranges:
                    own = [own[j] for j in np.flatnonzero(~covered(len(own), ranges, length))]
                gone.append(n[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept (the remaining words, joined by one space)."""
    docs = keyed(docs, id_col, text_col)

    def place(rows):
        lo = F.col("start") + F.col("from")
        earlier = ~(F.col("first_doc").eqNullSafe(F.col("doc_id")) & (F.col("first_start") == lo))
        return rows.where(earlier).select("row", "doc_id", lo.alias("lo"), (F.col("start") + F.col("to")).alias("hi"))

    judged = "from int, to int, first_doc long, first_start int"
    ranges = repeated_windows(docs, "word", length, min(ANCHOR, length), _judge(length), judged, place)
    return beside(docs, ranges).mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept string")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
