"""Suffix and common-prefix arrays of one shard by external induced sorting.

Suffix tuples (position, common prefix with the tuple before it) move through a
priority queue of buckets: it yields tuples by first symbol and, within a symbol,
in the order of insertion, and keeps only ``budget`` tuples in memory, the rest
in a scratch file of the task.  The text, its types and its runs are scratch
files too, mapped and filled a block at a time.  The order of the S* suffixes
comes from naming the S* substrings and inducing the order of the reduced text
the same way, level by level, until it has at most ``base`` symbols and is sorted
in memory by prefix doubling.  Reduced texts have large alphabets: there a bucket
is a range of symbols, and the tuples of a range are ordered at once.
"""

from __future__ import annotations

import tempfile

import numpy as np

_FAR = np.int32(2**31 - 1)
#: Symbols handled at once where a text is read or a bucket of several symbols is ordered.
BLOCK = 1 << 18


def scratch(n: int, dtype) -> np.ndarray:
    """An array in a scratch file of this task; the file goes with the array."""
    return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,)) if n else np.zeros(0, dtype)


class SpillQueue:
    """Tuples by bucket, first in first out within a bucket; spilled beyond ``budget`` tuples."""

    #: Spills and induced levels since the task's process began; tests read them.
    spills = 0

    def __init__(self, budget: int):
        self.budget, self.held, self.memory, self.disk, self.file = budget, 0, {}, {}, None

    def push(self, bucket: int, rows: np.ndarray) -> None:
        self.memory.setdefault(bucket, []).append(rows)
        self.held += len(rows)
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        SpillQueue.spills += 1
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for bucket, parts in self.memory.items():
            rows = np.concatenate(parts)
            self.disk.setdefault(bucket, []).append((self.file.tell(), len(rows)))
            self.file.write(rows.tobytes())
        self.memory, self.held = {}, 0

    def pop(self, bucket: int) -> np.ndarray:
        """All tuples of a bucket so far, (n, 2)."""
        parts = []
        for at, n in self.disk.pop(bucket, ()):
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(n * 8), np.int32).reshape(n, 2))
        parts += (kept := self.memory.pop(bucket, []))
        self.held -= sum(map(len, kept))
        return np.concatenate(parts) if parts else np.zeros((0, 2), np.int32)

    def close(self) -> None:
        if self.file:
            self.file.close()


def prefix_doubling(text: np.ndarray) -> np.ndarray:
    """Suffix array in memory: ranks of suffixes, refined where several still tie."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied, width = order[~(head & np.concatenate((head[1:], [True])))], 1
    while len(tied):
        tied, width = _refined(tied, rank, rank[np.minimum(tied + width, n)] + 1), width * 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def _packed(text: np.ndarray, bits: int, per: int) -> np.ndarray:
    """The ``per`` symbols from each position in one number, in a scratch file; 0 behind the end."""
    n = len(text)
    out = scratch(n + 1, np.uint64)
    for i in range(0, n, BLOCK):
        t = np.concatenate((text[i : i + BLOCK + per].astype(np.uint64), np.zeros(per, np.uint64)))
        m = min(BLOCK, n - i)
        word = np.zeros(m, np.uint64)
        for k in range(per):
            word = (word << np.uint64(bits)) | t[k : k + m]
        out[i : i + m] = word
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b (a != b), exact below ``cap``, else at least ``cap``."""
    n, bits = len(text), max(1, int(text.max()).bit_length())
    per = 63 // bits
    packed, out = _packed(text, bits, per), np.zeros(len(a), np.int32)
    for i in range(0, len(a), BLOCK):
        live, off = np.arange(i, min(i + BLOCK, len(a))), 0
        while len(live) and off < cap:
            x, y = packed[np.minimum(a[live] + off, n)], packed[np.minimum(b[live] + off, n)]
            differ = x != y
            stop, word = live[differ], x[differ] ^ y[differ]
            shared = np.zeros(len(stop), np.int32)  # leading symbols without a differing bit; the only 0 ends every match
            for k in range(1, per):
                shared += (word >> np.uint64((per - k) * bits)) == 0
            out[stop] = off + shared
            out[live[~differ]] = off + per
            live, off = live[~differ], off + per
    return out


def _types(text: np.ndarray):
    """S types and the symbols to the end of each run (itself and one more counted), filled from the right, block by block."""
    n = len(text)
    small, run = scratch(n, np.bool_), scratch(n, np.int32)
    end, after = n - 1, True  # the run that the block to the right begins with: its last position and type
    for hi in range(n, 0, -BLOCK):
        lo = max(0, hi - BLOCK)
        t = np.asarray(text[lo : min(hi + 1, n)])
        i = np.arange(lo, hi)
        change = np.append(t[1:] != t[:-1], True) if hi == n else t[1:] != t[:-1]
        last = np.flatnonzero(change)
        if not len(last):
            stop, rising = np.full(hi - lo, end), np.full(hi - lo, after)
        else:
            place = np.searchsorted(last, i - lo)
            inside = place < len(last)
            stop = np.where(inside, lo + last[np.minimum(place, len(last) - 1)], end)
            up = np.array([True if lo + x == n - 1 else t[x] < t[x + 1] for x in last[-1:]]) if hi == n else t[last[-1:]] < t[last[-1:] + 1]
            ups = np.append(t[last[:-1]] < t[last[:-1] + 1], up)
            rising = np.where(inside, ups[np.minimum(place, len(last) - 1)], after)
        small[lo:hi], run[lo:hi] = rising, stop - i + 1
        end, after = int(stop[0]), bool(rising[0])
    return small, run


def _stars(small: np.ndarray) -> np.ndarray:
    """S suffixes that follow an L suffix."""
    parts = []
    for lo in range(1, len(small), BLOCK):
        hi = min(lo + BLOCK, len(small))
        parts.append(lo + np.flatnonzero(small[lo:hi] & ~small[lo - 1 : hi - 1]))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _names(text: np.ndarray, star: np.ndarray) -> np.ndarray:
    """Rank of each S* substring, both end symbols included; one that ends early sorts after longer ones."""
    n, bits = len(text), int(text.max() + 1).bit_length()
    per, end = max(1, 63 // bits), (1 << bits) - 1
    length = np.append(star[1:] - star[:-1] + 1, 1)
    rank, live, off = np.zeros(len(star), np.int64), np.arange(len(star)), 0  # rank: place of the first equal one
    while len(live):
        word = np.zeros(len(live), np.uint64)
        for k in range(per):
            got = text[np.minimum(star[live] + off + k, n - 1)].astype(np.uint64)
            word = (word << np.uint64(bits)) | np.where(length[live] > off + k, got, np.uint64(end))
        o = np.lexsort((word, rank[live])) if off else np.argsort(word, kind="stable")
        live, word, first = live[o], word[o], rank[live][o]
        group = np.concatenate(([True], first[1:] != first[:-1]))
        head = group | np.concatenate(([True], word[1:] != word[:-1]))
        i = np.arange(len(live))
        rank[live] = first + np.maximum.accumulate(np.where(head, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        off += per
        # told apart, or equal to the end
        live = live[~(head & np.append(head[1:], True)) & (length[live] >= off)]
    return (np.cumsum(np.bincount(rank) > 0) - 1)[rank]


def _minima(values: np.ndarray) -> list[np.ndarray]:
    table, width = [values], 1
    while width * 2 <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


class _Induce:
    """One direction of the scan: tuples read in order push the tuple one symbol to their left."""

    def __init__(self, text, wanted, queue, sigma):
        self.text, self.wanted, self.queue = text, wanted, queue
        self.least = np.full(sigma, -1, np.int32)  # least common prefix read since a symbol's last push; -1: none yet
        self.pushed = np.zeros(sigma, bool)

    def read(self, rows: np.ndarray) -> None:
        """rows: (n, 2), the second the common prefix with the tuple read before."""
        for i in range(0, len(rows), BLOCK):
            self._read(rows[i : i + BLOCK])

    def _read(self, rows: np.ndarray) -> None:
        pos, lcp = rows[:, 0], rows[:, 1]
        left = pos - 1
        go = np.flatnonzero(left >= 0)
        go = go[self.wanted(left[go])]
        low = np.minimum.accumulate(lcp)
        if len(go):
            symbol = self.text[left[go]]
            o = np.argsort(symbol.astype(np.uint16), kind="stable")
            go, symbol = go[o], symbol[o]
            head = np.concatenate(([True], symbol[1:] != symbol[:-1]))
            value = np.empty(len(go), np.int32)
            at = np.flatnonzero(head)
            ours = symbol[at]
            value[at] = np.where(self.pushed[ours], np.minimum(self.least[ours], low[go[at]]) + 1, 0)
            rest = np.flatnonzero(~head)
            if len(rest):
                a, b = go[rest - 1] + 1, go[rest]
                table = _minima(lcp)
                level = np.floor(np.log2(b - a + 1)).astype(np.int64)
                got = np.empty(len(rest), np.int32)
                for v in np.unique(level):
                    m = level == v
                    got[m] = np.minimum(table[v][a[m]], table[v][b[m] - (1 << int(v)) + 1])
                value[rest] = got + 1
            out = np.stack((left[go].astype(np.int32), value), axis=1)
            ends = np.append(at[1:], len(go))
        self.least[self.pushed] = np.minimum(self.least[self.pushed], low[-1])
        if len(go):
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], _FAR)
            self.least[ours] = tail[go[ends - 1] + 1]
            self.pushed[ours] = True
            for c, i, j in zip(ours.tolist(), at.tolist(), ends.tolist()):
                self.queue.push(c, out[i:j])


def _refined(tied: np.ndarray, rank: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Tell apart ``tied`` (whole groups of one rank, the group's first place) by ``second``; returns those still tied."""
    o = np.argsort(rank[tied] * (len(rank) + 1) + second)
    tied, second = tied[o], second[o]
    first = rank[tied]
    group = np.concatenate(([True], first[1:] != first[:-1]))
    head = group | np.concatenate(([True], second[1:] != second[:-1]))
    i = np.arange(len(tied))
    rank[tied] = first + np.maximum.accumulate(np.where(head, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
    return tied[~(head & np.append(head[1:], True))]


def _ordered(symbol: np.ndarray, kind: np.ndarray, order: np.ndarray, pusher: np.ndarray) -> np.ndarray:
    """Order of the tuples of a range by (symbol, kind, place of arrival); those pushed from within the range
    (``pusher`` >= 0) arrive in the order of their pushers, found by doubling along the chains of pushers."""
    n = len(order)
    key = (((symbol - symbol.min(initial=0)) * 4 + kind) << max(1, n.bit_length())) + order
    found = np.argsort(key, kind="stable")
    head = np.concatenate(([True], key[found][1:] != key[found][:-1]))[:n]
    rank = np.empty(n, np.int64)
    rank[found] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied, up = found[~(head & np.append(head[1:], True)[:n])], np.where(pusher >= 0, pusher, np.arange(n))
    while len(tied):
        tied, up = _refined(tied, rank, rank[up[tied]]), up[up]
    found[rank] = np.arange(n)
    return found


def _scan_ranges(text, wanted, seeds, cuts, budget, down):
    """One direction over ranges of symbols: yields (range, positions in order, which of them were seeds).

    ``seeds(r)`` are the range's given suffixes in order of reading; they are read
    after those that were pushed with their symbol.
    """
    queue = SpillQueue(budget)
    try:
        ranges = range(len(cuts) - 1)
        for r in reversed(ranges) if down else ranges:
            came, given = queue.pop(r)[:, 0].astype(np.int64), seeds(r)
            pos = np.concatenate((came, given))
            kind = np.repeat([0, 2], (len(came), len(given)))
            order, pusher = np.arange(len(pos)), np.full(len(pos), -1)
            new = np.arange(len(pos))
            while len(new):  # what the tuples of this range push into it
                left = pos[new] - 1
                own = left >= 0
                own[own] = wanted(left[own])
                symbol = text[np.maximum(left, 0)]
                own &= (symbol >= cuts[r]) & (symbol < cuts[r + 1])
                left, by = left[own], new[own]
                new = np.arange(len(pos), len(pos) + len(left))
                pos, pusher = np.concatenate((pos, left)), np.concatenate((pusher, by))
                kind, order = np.concatenate((kind, np.ones(len(left), int))), np.concatenate((order, np.zeros(len(left), int)))
            symbol = text[pos].astype(np.int64)
            found = _ordered(-symbol if down else symbol, kind, order, pusher)
            pos, kind = pos[found], kind[found]
            left = pos - 1
            go = left >= 0
            go[go] = wanted(left[go])
            left = left[go]
            to = np.searchsorted(cuts, text[left], "right") - 1
            out = to != r
            left, to = left[out], to[out]
            o = np.argsort(to, kind="stable")
            left, to = left[o], to[o]
            at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))[: len(to)]
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(to)]):
                queue.push(int(to[i]), np.stack((left[i:j], left[i:j]), axis=1).astype(np.int32))
            yield r, pos, kind == 2
    finally:
        queue.close()


#: Reduced texts that were ordered by induction since the task's process began; tests read it.
induced = [0]


def induced_order(text: np.ndarray, base: int, budget: int) -> np.ndarray:
    """Suffix order of a text over a large alphabet that ends with its only 0."""
    n = len(text)
    if n <= base:
        return prefix_doubling(text)
    induced[0] += 1
    text32 = scratch(n, np.int32)
    text32[:] = text
    text = text32
    small, _ = _types(text)
    star = _stars(small)
    stars = star[star_order(_names(text, star), base, budget)]
    # ranges of symbols of about BLOCK suffixes, one symbol at least
    total = np.cumsum(np.bincount(text))
    cuts = [0]
    while cuts[-1] < len(total):
        before = total[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, before + min(BLOCK, budget), "right"))))
    cuts = np.array(cuts)
    of = np.searchsorted(cuts, text[stars], "right") - 1
    first = np.searchsorted(of, np.arange(len(cuts)))
    large = scratch(n, np.int32)
    bounds, at = {}, 0
    for r, pos, seed in _scan_ranges(text, lambda p: ~small[p], lambda r: stars[first[r] : first[r + 1]], cuts, budget, False):
        pos = pos[~seed]
        large[at : at + len(pos)] = pos
        bounds[r] = (at, at + len(pos))
        at += len(pos)
    out, at = np.empty(n, np.int64), n

    def seeds(r):
        a, b = bounds[r]
        given = large[a:b][::-1].astype(np.int64)
        return np.append(given, n - 1) if r == 0 else given

    for r, pos, _ in _scan_ranges(text, lambda p: small[p], seeds, cuts, budget, True):
        out[at - len(pos) : at] = pos[::-1]
        at -= len(pos)
    return out


def star_order(names: np.ndarray, base: int, budget: int) -> np.ndarray:
    """Order of the S* suffixes from the names of their substrings."""
    if int(names.max()) + 1 == len(names):
        order = np.empty(len(names), np.int64)
        order[names] = np.arange(len(names))
        return order
    return induced_order(names, base, budget)


def suffix_buckets(text: np.ndarray, cap: int, base: int = 1 << 16, budget: int = 1 << 18):
    """The suffix array of ``text`` with common prefixes, one first symbol at a time, largest first.

    ``text`` holds non-negative integers below 2**16 and ends with its only 0.  Yields
    (positions in order, common prefix of each with the one before it in the
    whole order); prefixes are exact below ``cap`` and at least ``cap`` otherwise.
    """
    n, sigma = len(text), int(text.max()) + 1
    small, run = _types(text)
    star = _stars(small)
    if n == 1:
        star = np.zeros(1, np.int64)
    stars = star[star_order(_names(text, star), base, budget)]
    lcps = np.append(0, common_prefix(text, stars[:-1], stars[1:], cap)).astype(np.int32)
    symbols = np.unique(text)
    first = np.searchsorted(text[stars], symbols)
    last = np.searchsorted(text[stars], symbols, "right")

    queue, done = SpillQueue(budget), SpillQueue(budget)
    try:
        scan = _Induce(text, lambda p: ~small[p], queue, sigma)
        for c, i, j in zip(symbols.tolist(), first.tolist(), last.tolist()):
            end = -1
            while len(rows := queue.pop(c)):
                scan.read(rows)
                done.push(c, rows)
                end = int(rows[-1, 0])
            if j > i:
                rows = np.stack((stars[i:j].astype(np.int32), lcps[i:j]), axis=1)
                rows[0, 1] = min(run[end], run[stars[i]]) if end >= 0 else 0
                scan.read(rows)
        scan = _Induce(text, lambda p: small[p], queue, sigma)
        for c in symbols[::-1].tolist():
            parts = []
            if c == 0:
                parts = [np.array([[n - 1, 0]], np.int32)]
            while len(rows := queue.pop(c)):
                scan.read(rows)
                parts.append(rows)
            low = np.concatenate(parts)[::-1] if parts else np.zeros((0, 2), np.int32)  # S suffixes, now ascending
            big = done.pop(c)
            seam = min(run[big[-1, 0]], run[low[0, 0]]) if len(big) and len(low) else 0
            if len(big):
                rows = np.stack((big[::-1, 0], np.append(seam, big[:0:-1, 1]).astype(np.int32)), axis=1)
                scan.read(rows)
            up = np.append(seam, low[:-1, 1]).astype(np.int32) if len(low) else low[:, 1]
            yield np.concatenate((big[:, 0], low[:, 0])), np.concatenate((big[:, 1], up))
    finally:
        queue.close(), done.close()
