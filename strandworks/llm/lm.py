"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

Method: P(w|u) = a(b) c(u,w)/c(u) + d(b) c(w)/N + e(b)/(V+1), where b is the
bucket of the context's frequency c(u) by powers of two.  The weights of each
bucket are learned by expectation-maximisation on held-out counts: for the
training documents of one fold, the counts less the document's own ("deleted").

Counting at scale: words and bigrams ("items") are 64-bit hashes.  The texts are
taken in batches of about ``BATCH_BYTES``; a batch sends each of its distinct
items once, packed by hash range, to the group that counts that range over the
corpus, and gets the counts back in the same order.  Items that are frequent in
a bounded sample (``HEAD``) are counted in every task instead and summed, so no
group receives a frequent item from every batch; the sample decides the route
only, all counts are exact.

Results in edge cases
  * null, empty and blank texts are the end mark alone, one token.
  * folds come from the crc32 of the id as text; a null id counts as ''.
  * repeated rows are counted and scored each; other columns are ignored,
    whatever their names; an empty table gives no rows.
  * without training tokens only the uniform estimate 1/(V+1) = 1 remains.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import mix64, release, slices, stage, text_buffer, words
from .repeats import keyed

FOLDS, HELD_OUT, TUNING = 7, 2, 3
#: Frequent items counted in every task (words and bigrams together), and the documents of the sample that names them.
HEAD, SAMPLE_DOCS = 1 << 17, 20_000
#: Text of a batch; items of a counting group at most; groups for each shuffle partition at least, so that all have their share.
BATCH_BYTES, GROUP_ITEMS, GROUPS_EACH = 2 << 20, 1 << 20, 4
ROUNDS, BINS = 60, 20

_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0x9FB21C651E98DF25)


def tokens(data: np.ndarray, offs: np.ndarray):
    """Hashes of the tokens (words, then one end mark a row), of their bigrams with the token before, and row offsets."""
    w, wo = words(data, offs, lower=True)
    n = len(offs) - 1
    to = wo + np.arange(n + 1)
    t = np.empty(len(w) + n, np.uint64)
    ends = to[1:] - 1
    inner = np.ones(len(t), bool)
    inner[ends] = False
    t[inner], t[ends] = w, _END
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[to[:-1]] = _START
    return t, mix64(before * _PAIR + t), to


def _items(batches):
    """Distinct items of a sample of rows with their counts, one batch at a time."""
    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        for i, j in slices(offs, BATCH_BYTES):
            t, pairs, _ = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            for kind, x in ((0, t), (1, pairs)):
                u, c = np.unique(x, return_counts=True)
                keep = c > 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), kind, np.int32)), pa.array(u[keep].view(np.int64)), pa.array(c[keep])], ["kind", "item", "n"])


def _find(head: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Place in the head, or -1."""
    if not len(head):
        return np.full(len(items), -1)
    at = np.minimum(np.searchsorted(head, items), len(head) - 1)
    return np.where(head[at] == items, at, -1)


def _groups(items: np.ndarray, n_groups: int) -> np.ndarray:
    """Group of each item: equal ranges of the hash, so sorted items have sorted groups."""
    return ((items >> np.uint64(32)) * np.uint64(n_groups) >> np.uint64(32)).astype(np.int32)


def _tail(data, offs, head):
    """Distinct items outside the head, sorted; and the tokens they come from."""
    t, pairs, to = tokens(data, offs)
    both = np.unique(np.concatenate((t, pairs)))
    return both[_find(head, both) < 0], t, pairs, to


_BATCH = "batch long, tuning boolean, ids binary, folds binary, offs binary, text binary"
_ITEMS = "batch long, part int, items binary"
#: Head counts travel in pieces of CHUNK numbers, summed in LANES lanes a piece.
CHUNK, LANES = 512, 16


def _batches(batches):
    """Texts by the batch, those of the tuning fold apart."""
    name, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
    names, types = ["batch", "tuning", "ids", "folds", "offs", "text"], [pa.int64(), pa.bool_()] + [pa.binary()] * 4
    for record in batches:
        data, offs = text_buffer(record.column(1))
        column, folds = record.column(0), record.column(2).to_numpy().astype(np.int8)
        ids, none = column.fill_null(0).to_numpy().astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)
        for i, j in slices(offs, BATCH_BYTES):
            for tuning in (False, True):
                own = np.flatnonzero((folds[i:j] == TUNING) == tuning) + i
                if not len(own):
                    continue
                parts = [data[offs[r] : offs[r + 1]] for r in own]
                po = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
                keys = np.stack((ids[own], none[own].astype(np.int64)))
                row = ([name], [tuning], [keys.tobytes()], [folds[own].tobytes()], [po.tobytes()], [pack.compress(np.concatenate(parts).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names)
                name += 1


def _send(shared, n_groups):
    """A batch's tail items with their training counts, one row a group; and the task's head counts, as groups below 0."""
    names, types = ["batch", "part", "items"], [pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        head = shared.value
        total = np.zeros(len(head) + 2, np.int64)
        for record in batches:
            for name, _, folds, po, text in _texts(record):
                tail, t, pairs, to = _tail(text, po, head)
                train = np.repeat(folds != HELD_OUT, np.diff(to))
                both = np.concatenate((t[train], pairs[train]))
                at = _find(head, both)
                total[: len(head)] += np.bincount(at[at >= 0], minlength=len(head))
                total[-2:] += (int(train.sum()), int((folds != HELD_OUT).sum()))
                count = np.bincount(np.searchsorted(tail, both[at < 0]), minlength=len(tail)).astype(np.uint64)
                # which tail items are tokens, so that their group can count distinct ones
                is_token = np.zeros(len(tail), np.uint64)
                is_token[np.searchsorted(tail, t[_find(head, t) < 0])] = 1
                part = _groups(tail, n_groups)
                cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))[: len(part)]
                ends = np.append(cut[1:], len(part))
                blobs = [tail[a:b].tobytes() + (count[a:b] * np.uint64(2) + is_token[a:b]).tobytes() for a, b in zip(cut, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([name] * len(cut), part[cut], blobs), types)], names)
        lane = TaskContext.get().partitionId() % LANES
        pieces = [total[i : i + CHUNK].tobytes() for i in range(0, len(total), CHUNK)]
        parts = [-1 - (i * LANES + lane) for i in range(len(pieces))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([-1] * len(parts), parts, pieces), types)], names)

    return run


def _unpack(blob):
    n = len(blob) // 16
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint64, n, 8 * n)


def _count(frame):
    """Counts of one group over the corpus, sent back to every batch in the order it sent its items."""
    import pandas as pd

    part = int(frame["part"].iloc[0])
    if part < 0:  # a piece of the head counts
        total = np.sum([np.frombuffer(b, np.int64) for b in frame["items"]], axis=0, dtype=np.int64)
        return pd.DataFrame({"batch": [-1], "part": [part], "counts": [total.tobytes()], "distinct": [0]})
    got = [_unpack(b) for b in frame["items"]]
    items, back = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    marks = np.concatenate([g[1] for g in got])
    count = np.zeros(len(items), np.int64)
    np.add.at(count, back, (marks >> np.uint64(1)).astype(np.int64))
    token = np.zeros(len(items), bool)
    token[back[(marks & np.uint64(1)) > 0]] = True
    ends = np.cumsum([len(g[0]) for g in got])
    out = [c.tobytes() for c in np.split(count[back], ends[:-1])]
    distinct = int((token & (count > 0)).sum())
    return pd.DataFrame({"batch": [*frame["batch"], -1], "part": part, "counts": [*out, b""], "distinct": [0] * len(out) + [distinct]})


class _Model:
    """Head counts, totals and weights; looks up the counts of a batch's tokens."""

    def __init__(self, head, counts, n, docs, distinct, weights=None):
        self.head, self.counts, self.n, self.docs, self.distinct, self.weights = head, counts, n, docs, distinct, weights

    def look_up(self, data, offs, tail_counts):
        """Counts of each token's bigram, context and word; the hashes; and the row offsets."""
        tail, t, pairs, to = _tail(data, offs, self.head)

        def of(items):
            at = _find(self.head, items)
            out = np.zeros(len(items), np.int64)
            out[at >= 0] = self.counts[at[at >= 0]]
            out[at < 0] = tail_counts[np.searchsorted(tail, items[at < 0])]
            return out

        word = of(t)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[to[:-1]] = self.docs
        return of(pairs), context, word, t, pairs, to


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the power of two below the count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(int) + 1, 0)


def _own_counts(items, to):
    """How often each item occurs in its own row."""
    row = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((items, row))
    i, r = items[order], row[order]
    new = np.concatenate(([True], (i[1:] != i[:-1]) | (r[1:] != r[:-1])))[: len(i)]
    size = np.diff(np.append(np.flatnonzero(new), len(i)))
    out = np.empty(len(i), np.int64)
    out[order] = np.repeat(size, size)
    return out


def _texts(batch):
    """batch, ids, folds, offsets and bytes of the rows of a batch table (batch, ids, folds, offs, text, ...)."""
    for name, ids, folds, offs, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8) if text else np.zeros(0, np.uint8)
        yield name, np.frombuffer(ids, np.int64).reshape(2, -1), np.frombuffer(folds, np.int8), np.frombuffer(offs, np.int64), data


def _rows(batch):
    for (_, *row), found in zip(_texts(batch), batch.column(5).to_pylist()):
        counts = [np.frombuffer(x["counts"], np.int64) for x in sorted(found or (), key=lambda x: x["part"])]
        yield *row, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def _tuning(shared):
    """Held-out tokens by context bucket and by rounded logarithms of their deleted estimates."""

    def run(batches):
        model = shared.value
        for batch in batches:
            for _, _, offs, data, counts in _rows(batch):
                pair, context, word, t, pairs, to = model.look_up(data, offs, counts)
                size = np.repeat(np.diff(to), np.diff(to))
                own = _own_counts(t, to)
                own_context = np.empty_like(own)
                own_context[1:] = own[:-1]
                own_context[to[:-1]] = 1
                pair, context, word = pair - _own_counts(pairs, to), context - own_context, word - own
                rest = np.maximum(model.n - size, 1)
                b = bucket(context)
                p2 = np.where(pair > 0, np.round(BINS * np.log10(np.maximum(pair, 1) / np.maximum(context, 1))), -9999).astype(np.int64)
                p1 = np.where(word > 0, np.round(BINS * np.log10(np.maximum(word, 1) / rest)), -9999).astype(np.int64)
                key, n = np.unique(np.stack((b, p2, p1)), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int32)) for k in key), pa.array(n)], ["b", "p2", "p1", "n"])

    return run


def learn_weights(b, p2, p1, n, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate for each bucket (64 rows) by expectation-maximisation."""
    weights = np.full((64, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    p = np.stack((np.where(p2 > -9999, 10.0 ** (p2 / BINS), 0), np.where(p1 > -9999, 10.0 ** (p1 / BINS), 0), np.full(len(b), uniform)), axis=1)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        total = np.stack([np.bincount(b, share[:, k], 64) for k in range(3)], axis=1) + 0.1 * weights
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for ids, folds, offs, data, counts in _rows(batch):
                pair, context, word, _, _, to = model.look_up(data, offs, counts)
                w = model.weights[bucket(context)]
                p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(model.n, 1) + w[:, 2] / (model.distinct + 1)
                base = np.log10((word + 1) / (model.n + model.distinct + 1))
                add = lambda x: np.add.reduceat(x, to[:-1])  # noqa: E731  no row is empty: each has its end
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[0], mask=ids[1].astype(bool)), pa.array(folds == HELD_OUT), pa.array(np.diff(to)), pa.array(add((word > 0).astype(np.int64))),
                        pa.array(np.full(len(folds), model.n)), pa.array(add(base)), pa.array(add(np.log10(p))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    docs = keyed(docs, id_col, text_col).select("doc_id", "text", fold.cast("int").alias("fold"))
    n_docs = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n_docs, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counted = sample.mapInArrow(_items, "kind int, item long, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    # at most HEAD items come to the driver
    top = [counted.where(F.col("kind") == k).orderBy(F.desc("n"), "item").limit(HEAD // 2).select("item").toArrow().column(0).to_numpy() for k in (0, 1)]
    head = np.unique(np.concatenate(top).astype(np.int64).view(np.uint64))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(GROUPS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 8 / GROUP_ITEMS))
    shared = spark.sparkContext.broadcast(head)
    texts, _ = stage(docs.mapInArrow(_batches, _BATCH), "batches")
    plain = ["batch", "ids", "folds", "offs", "text"]
    sent = texts.select(plain).mapInArrow(_send(shared, n_groups), _ITEMS)
    found, _ = stage(sent.groupBy("part").applyInPandas(_count, "batch long, part int, counts binary, distinct long"), "counts")
    release(spark)  # the items' shuffle is done with; only now does nothing refer to it
    totals = np.zeros(len(head) + 2, np.int64)
    # LANES numbers for each head item, whatever the corpus
    for r in found.where("part < 0").select("part", "counts").toLocalIterator():
        i = (-1 - r.part) // LANES * CHUNK
        totals[i : i + CHUNK] += np.frombuffer(r.counts, np.int64)
    in_words = np.isin(head, top[0].astype(np.int64).view(np.uint64))
    distinct = int((in_words & (totals[:-2] > 0)).sum()) + (found.agg(F.sum("distinct")).first()[0] or 0)
    model = _Model(head, totals[:-2], int(totals[-2]), int(totals[-1]), distinct)
    back = found.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("part", "counts")).alias("found"))

    def joined(rows):
        return rows.join(back, "batch", "left").select(*plain, "found")

    held = joined(texts.where("tuning")).mapInArrow(_tuning(spark.sparkContext.broadcast(model)), "b int, p2 int, p1 int, n long")
    # at most 64 buckets x rounded logarithms, whatever the corpus
    seen = held.groupBy("b", "p2", "p1").agg(F.sum("n").alias("n")).toArrow()
    model.weights = learn_weights(*(seen.column(c).to_numpy() for c in ("b", "p2", "p1", "n")), 1 / (distinct + 1))
    release(spark)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined(texts).mapInArrow(_score(spark.sparkContext.broadcast(model)), schema)
