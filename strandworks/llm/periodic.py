"""Runs of periodic words: maximal stretches that repeat with a period, found by common extensions.

Method: the words of a batch of texts become numbers, one text after the other,
each closed by a number of its own.  A run of period p and length 2p or more
covers two neighbouring points of a grid of step p, from which it extends to the
left and to the right as far as the words p apart agree; so every period's grid
of every text is tried, n/1 + n/2 + ... points.  The extensions are longest
common prefixes of two suffixes.  Only suffixes at the places of a difference
cover (residues modulo ``PERIOD`` whose differences are all residues) are
sorted, by doubling over the names of their first ``PERIOD`` words; prefixes of
neighbours in that order lie in a sparse table of range minima.  Two suffixes are
compared word by word up to the first shift that brings both to sampled places,
fewer than ``PERIOD`` words, and the table gives the rest.  Extensions to the
left are those of the reversed batch.

A row is a unit of work of its own: nothing is shuffled, and memory follows the
longest text (some 100 bytes a word) or ``SLICE_BYTES`` of short ones; grid points are tried
``POINTS`` at a time.

Results in edge cases
  * null and blank texts have no words, no runs and an empty collapsed text.
  * repeated rows and null ids are rows like others; nothing refers to the id.
  * stretches under ``LEAST`` words or under two periods are no runs.
  * other columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_buffer

LEAST = 12
#: A perfect difference set modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Grid points compared at once.
POINTS = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _shifts() -> np.ndarray:
    """shift[a, b]: the least d for which a + d and b + d both lie in the cover, modulo PERIOD."""
    inside = np.isin(np.arange(PERIOD), COVER)
    at = np.arange(PERIOD)
    return np.argmax([[inside[(a + at) % PERIOD] & inside[(b + at) % PERIOD] for b in at] for a in at], axis=2)


SHIFT = _shifts()


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks, equal for equal keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
    return out


class Extensions:
    """Longest common prefixes of suffixes of one text in a batch, by a sorted sample of them.

    ``text`` is the text of each place: suffixes are sorted by text first, so names end where texts do.
    """

    def __init__(self, x: np.ndarray, text: np.ndarray):
        n = len(x)
        # beyond the end stand numbers that occur once, so no comparison runs over it
        self.x = np.concatenate((x, x.max(initial=0) + 1 + np.arange(2 * PERIOD))).astype(np.int32)
        # sampled places class by class: the next one of a class is PERIOD words on
        per_class = [np.arange(c, n + PERIOD, PERIOD) for c in COVER]
        at = np.concatenate(per_class)
        m = len(at)
        self.index = np.full(n + 2 * PERIOD, -1, np.int32)
        self.index[at] = np.arange(m)
        # a class's last place lies beyond the end, so no shared prefix crosses classes
        rank = self._names(at, text[np.minimum(at, n - 1)])
        levels, width = [rank], 1
        while int(levels[-1].max()) + 1 < m:
            r = levels[-1].astype(np.int64)
            after = np.full(m, -1, np.int64)
            after[: m - width] = r[width:]
            levels.append(_ranks(r * (int(r.max()) + 2) + after + 1))
            width *= 2
        final = levels[-1]
        order = np.empty(m, np.int64)
        order[final] = np.arange(m)
        self.rank = final
        self.table = [self._prefixes(order, levels, at)]
        span = 1
        while 2 * span <= len(self.table[0]):
            t = self.table[-1]
            self.table.append(np.minimum(t[:-span], t[span:]))
            span *= 2

    def _names(self, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Ranks of text and PERIOD words from each place, as many words at a time as fit 62 bits."""
        bits, k = max(1, int(self.x.max()).bit_length()), 0
        while k < PERIOD:
            rank = rank.astype(np.int64)
            for _ in range(max(1, (62 - int(rank.max()).bit_length()) // bits)):
                if k < PERIOD:
                    rank = (rank << bits) | self.x[at + k]
                    k += 1
            rank = _ranks(rank)
        return rank

    def _prefixes(self, order, levels, at) -> np.ndarray:
        """Common prefixes of neighbours in order: whole names from the levels of doubling, then word by word."""
        a, b = order[:-1].copy(), order[1:].copy()
        m = len(order)
        for t in range(len(levels) - 1, -1, -1):
            r, ok = levels[t], (a < m) & (b < m)
            same = np.zeros(len(a), bool)
            same[ok] = r[a[ok]] == r[b[ok]]
            a[same] += 1 << t
            b[same] += 1 << t
        done = (a - order[:-1]) * PERIOD
        i, j = at[order[:-1]] + done, at[order[1:]] + done
        return (done + self._words(i, j, np.full(len(i), PERIOD))).astype(np.int32)

    def _words(self, i, j, limit) -> np.ndarray:
        """Equal words from i and j on, at most ``limit`` (below or equal PERIOD)."""
        out = np.zeros(len(i), np.int64)
        go = np.flatnonzero(limit > 0)
        top = len(self.x) - 1
        for k in range(PERIOD):
            go = go[(self.x[np.minimum(i[go] + k, top)] == self.x[np.minimum(j[go] + k, top)]) & (k < limit[go])]
            if not len(go):
                break
            out[go] += 1
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j`` (different places)."""
        whole = np.zeros(len(i), np.int64)
        some = np.flatnonzero(self.x[i] == self.x[j])
        i, j = i[some], j[some]
        shift = SHIFT[i % PERIOD, j % PERIOD]
        out = self._words(i, j, shift)
        on = np.flatnonzero(out == shift)
        a, b = self.rank[self.index[i[on] + shift[on]]], self.rank[self.index[j[on] + shift[on]]]
        low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        rest = np.empty(len(on), np.int64)
        for t in np.unique(level):
            sel = np.flatnonzero(level == t)
            rest[sel] = np.minimum(self.table[t][low[sel]], self.table[t][high[sel] - (1 << t)])
        out[on] += rest
        whole[some] = out
        return whole


def _grid(sizes: np.ndarray):
    """Blocks of text, period and grid point: every period up to half a text, every point with another one a period on."""
    text = np.repeat(np.arange(len(sizes)), sizes // 2)
    if not len(text):
        return
    period = np.arange(len(text)) - np.repeat(np.cumsum(sizes // 2) - sizes // 2, sizes // 2) + 1
    points = (sizes[text] - 1) // period  # k p with k p + p < n
    ends = np.cumsum(points)
    start = 0
    while start < len(text):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + POINTS, "right")))
        t, p, c = text[start:stop], period[start:stop], points[start:stop]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(t, c), np.repeat(p, c), k * np.repeat(p, c)
        start = stop


def find_runs(ids: np.ndarray, offs: np.ndarray, least: int = LEAST):
    """Runs of texts whose words are ``ids[offs[d]:offs[d+1]]``: text, start, length, smallest period, in that order."""
    sizes = np.diff(offs)
    none = np.zeros(0, np.int64)
    enough = np.flatnonzero(sizes >= max(least, 2))
    if not len(enough):
        return none, none, none, none
    # each text is closed by a number of its own
    sizes = sizes[enough]
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    x = np.empty(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(x), bool)
    inside[begin + sizes] = False
    x[inside] = np.concatenate([ids[offs[d] : offs[d + 1]] for d in enough])
    x[~inside] = int(ids.max(initial=0)) + 1 + np.arange(len(sizes))
    text_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    forward, back = Extensions(x, text_of), Extensions(x[::-1], text_of[::-1])
    found = []
    for text, p, at in _grid(sizes):
        i = begin[text] + at
        right = forward.common(i, i + p)
        # to the left: common suffixes before the two points
        left, some = np.zeros(len(i), np.int64), np.flatnonzero(at > 0)
        left[some] = back.common(len(x) - i[some], len(x) - i[some] - p[some])
        ok = np.flatnonzero((left + right >= p) & (left + right + p >= least))
        found.append(np.stack((text[ok], at[ok] - left[ok], (left + right + p)[ok], p[ok])))
    if not found:
        return none, none, none, none
    t, s, n, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, n, s, t))
    t, s, n, p = t[order], s[order], n[order], p[order]
    # one stretch is found for its period and the multiples of it: the smallest counts
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    t, s, n, p = t[first], s[first], n[first], p[first]
    order = np.lexsort((p, s, t))
    return enough[t[order]], s[order], n[order], p[order]


def word_numbers(data: np.ndarray, offs: np.ndarray):
    """Equal numbers for equal words of the batch (by the words themselves), and the offsets of the texts among them."""
    ink = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(ink & ~(np.concatenate(([False], ink[:-1])) & ~cut[:-1]))
    letters = data[ink]
    at = np.concatenate((np.cumsum(ink) - ink, [len(letters)]))
    word_offs = np.concatenate((at[starts], [len(letters)])).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(word_offs), pa.py_buffer(np.ascontiguousarray(letters))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offs)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapse(batches):
    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        for i, j in slices(offs):
            part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            ids, wo = word_numbers(part, po)
            text, start, length, period = find_runs(ids, wo)
            # words after a run's first period go: a step up where that begins, a step down after the run
            steps = np.zeros(len(ids) + 1, np.int64)
            np.add.at(steps, wo[text] + start + period, 1)
            np.add.at(steps, wo[text] + start + length, -1)
            kept = np.cumsum(steps)[:-1] == 0
            touched, raw, out = set(text.tolist()), part.tobytes(), []
            for d in range(j - i):
                words = raw[po[d] : po[d + 1]].split()
                if d in touched:
                    words = [w for w, k in zip(words, kept[wo[d] : wo[d + 1]].tolist()) if k]
                out.append(b" ".join(words).decode())
            bounds = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(v) for v in (start, length, period)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(np.diff(wo)), runs.cast(RUNS), pa.array(out, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed, the words that no run repeats."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_collapse, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def damaged(docs: DataFrame) -> DataFrame:
    """Texts of the query: every tenth by crc32 of its id turns periodic from one of its words on; a null id leaves its text."""
    rows = docs.select(docs["doc_id"], docs["text"], F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")).alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)})
    rows = rows.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Columns of the contract."""
    order = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    best = found.withColumn("best", order)
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


SQL = r"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, CAST(doc_id AS VARCHAR) AS key, row_number() OVER () AS nr FROM documents),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS h FROM h),
m AS (SELECT *, (h // 10) % len(ws) AS a, 1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) AS p FROM c),
w AS (SELECT doc_id, nr, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[1 + a + (i - a) % p] ELSE ws[i + 1] END AS word
  FROM (SELECT *, unnest(range(len(ws))) AS i FROM m)),
e AS (SELECT x.nr, x.i, y.i - x.i AS p FROM w x JOIN w y ON x.nr = y.nr AND x.word = y.word AND x.i < y.i),
isle AS (SELECT nr, p, min(i) AS start, count(*) AS same FROM (SELECT *, i - row_number() OVER (PARTITION BY nr, p ORDER BY i) AS g FROM e) GROUP BY nr, p, g),
runs AS (SELECT nr, start, same + p AS length, min(p) AS period FROM isle WHERE same >= p AND same + p >= 12 GROUP BY nr, start, same + p),
gone AS (SELECT DISTINCT nr, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT nr, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (nr, i) GROUP BY nr),
best AS (SELECT nr, count(*) AS n_runs, arg_max({'start': start, 'length': length, 'period': period}, {'l': length, 's': -start, 'p': -period}) AS b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY nr)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
  CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(best.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM h LEFT JOIN best USING (nr) LEFT JOIN kept USING (nr)
"""
