"""SimHash near-dedup: 64-bit fingerprints, linked at ``RADIUS`` or fewer differing bits.

Method: vantage-point trees over Hamming space.  Over all 64 bits random
fingerprints lie 32 +- 4 bits apart and a border of width 4 would hold most of
them, so the trees stand in three subspaces, thirds of the bits: of a pair within
four bits at least one third differs in one bit at most.  In each subspace a tree
of shared vantage points halves the fingerprints by distance, level by level,
until a shard holds about ``LEAF``; a point whose distance equals a level's radius
lies on the border and goes to both sides (triangle bound: a partner on the far
side is at most one bit further), so each pair meets in a shard.  Inside a shard a
vantage-point tree over all bits prunes by the triangle bound and yields links
that span each local group, not all pairs.  A shard that stays above ``TILE``
(near copies that no vantage point parts) is cut in blocks, and each pair of
blocks is one task's work.  Components come from star contraction over the links.

Results in edge cases
  * null, empty and blank texts have fingerprint zero and link like any other.
  * rows with equal fingerprints share a component; repeated rows each stay.
  * a null ``doc_id`` never becomes a component's id unless nothing else is there
    (then the id is null); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import release, stage, text_buffer
from .repeats import FEW, keyed

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Widths of the subspaces, and the distance in one of them that a pair within RADIUS cannot exceed in all.
THIRDS = (22, 21, 21)
NEAR = RADIUS // len(THIRDS)
#: Fingerprints of a shard to aim at; above TILE a shard is cut in blocks.
LEAF, TILE = 2048, 16_384
#: Fingerprints from which the radii of the vantage points are taken (balance only), and salts of hot components.
SAMPLE, SALTS = 50_000, 16


def fingerprint(body: bytes, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, most significant first; a bit is 1 if set in over half the shingle hashes."""
    words = body.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(joined, seed)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[: -shingle])]
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 1 << 14):
        packed = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 14)], ends[shingle - 1 + i :])])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, 64)
        while len(bits) > 255:  # sums of up to 255 rows stay in a byte
            cut = len(bits) // 255 * 255
            ones += bits[:cut].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            bits = bits[cut:]
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _fingerprints(batches):
    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        raw = data.tobytes()
        packed = b"".join([fingerprint(raw[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(packed, ">i8").astype(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return keyed(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def _near(a, b):
    return np.bitwise_count(a ^ b) <= RADIUS


class _Groups:
    """Labels of the points of one shard; merging keeps one link per merge."""

    def __init__(self, points):
        self.points, self.label, self.links = points, np.arange(len(points)), []

    def merge(self, i: int, hits: np.ndarray) -> None:
        own = self.label[i]
        other = np.unique(self.label[hits])
        other, first = other[other != own], None
        if len(other):
            for x in other:
                first = hits[np.flatnonzero(self.label[hits] == x)[0]]
                self.links.append((i, int(first)))
            self.label[np.isin(self.label, other)] = own

    def cross(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links between two sets of points (the same set: within it)."""
        if not len(a) or not len(b):
            return
        own = a is b
        if len(a) * len(b) <= 1 << 16 or min(len(a), len(b)) < 8:
            for i in range(0, len(a), 256):
                hit = _near(self.points[a[i : i + 256], None], self.points[None, b])
                for r in np.flatnonzero(hit.any(axis=1)):
                    self.merge(int(a[i + r]), b[hit[r]])
            return
        pivot = a[len(a) // 2]
        da = np.bitwise_count(self.points[a] ^ self.points[pivot]).astype(int)
        db = da if own else np.bitwise_count(self.points[b] ^ self.points[pivot]).astype(int)
        self.merge(int(pivot), b[db <= RADIUS])
        middle = int(np.median(da))
        if (da <= middle).all():
            middle -= 1
        if not (da <= middle).any() or (own and (da <= 1).all()):  # all at one distance: no cut by this pivot
            for i in range(0, len(a), 256):
                hit = _near(self.points[a[i : i + 256], None], self.points[None, b])
                for r in np.flatnonzero(hit.any(axis=1)):
                    self.merge(int(a[i + r]), b[hit[r]])
            return
        an, af, bn, bf = da <= middle, da > middle, db <= middle, db > middle
        near, far = a[an], a[af]
        self.cross(near, near if own else b[bn])
        self.cross(far, far if own else b[bf])
        # across the border only points within the radius of it can be linked
        self.cross(a[an & (da > middle - RADIUS)], b[bf & (db <= middle + RADIUS)])
        if not own:
            self.cross(a[af & (da <= middle + RADIUS)], b[bn & (db > middle - RADIUS)])


def tree_links(points: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs within the radius that span every group of the distinct points."""
    g = _Groups(points.view(np.uint64))
    every = np.arange(len(points))
    g.cross(every, every)
    return g.links


def _shard_links(batches):
    """Links of whole tiles (shard, pair of blocks), in order; the two blocks of a tile are compared with each other only."""

    def links(shard, pair, block, fp):
        begin = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (pair[1:] != pair[:-1]))))
        out = []
        for i, j in zip(begin, [*begin[1:], len(shard)]):
            if j - i < 2:
                continue
            g = _Groups(fp[i:j].view(np.uint64))
            first, rest = np.flatnonzero(block[i:j] == block[i]), np.flatnonzero(block[i:j] != block[i])
            g.cross(first, rest if len(rest) else first)
            out.append(fp[i:j][np.array(g.links, np.int64).reshape(-1, 2)])
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held = []  # parts of the last tile, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(4)]
        if held and (now[0][0] != held[-1][0][-1] or now[1][0] != held[-1][1][-1]):
            yield links(*[np.concatenate(c) for c in zip(*held)])
            held = []
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(*[np.concatenate(c) for c in zip(*held, [c[:cut] for c in now])])
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield links(*[np.concatenate(c) for c in zip(*held)])


def subspaces() -> list[int]:
    """Masks of the thirds of the 64 bits."""
    at, masks = 0, []
    for width in THIRDS:
        masks.append(((1 << width) - 1) << at)
        at += width
    return masks


def vantage_points(points: DataFrame, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each subspace the vantage points of its levels and their radii, the median distance of a bounded sample.

    The sample is the ``SAMPLE`` least fingerprints by hash; it sets the balance of the halves, not what is found.
    """
    sample = points.select("fp").orderBy(F.xxhash64(F.lit("vantage"), "fp"), "fp").limit(SAMPLE).toArrow().column(0).to_numpy().view(np.uint64)
    trees = []
    for mask, width in zip(subspaces(), THIRDS):
        own = sample & np.uint64(mask)
        # points half the width apart part the fingerprints independently of each other
        candidates, chosen = np.unique(own[:1024]), own[:1]
        while len(chosen) < levels:
            skew = np.abs(2 * np.bitwise_count(candidates[:, None] ^ chosen[None, :]).astype(int) - width)
            chosen = np.append(chosen, candidates[int((skew**2).sum(axis=1).argmin())])
        chosen = chosen[:levels]
        radii = []
        for c in chosen:
            d = np.bitwise_count(own ^ c).astype(int)
            m = int(np.median(d))
            radii.append(m if (d <= m).mean() + (d < m).mean() <= 1 else m - 1)
        trees.append((chosen, np.array(radii, int)))
    return trees


def tree_shards(fp: np.ndarray, mask: int, tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of each fingerprint and its shard in one subspace; those on a border have several."""
    own, at, leaf = fp & np.uint64(mask), np.arange(len(fp)), np.zeros(len(fp), np.int64)
    for vantage, radius in zip(*tree):
        d = np.bitwise_count(own ^ vantage).astype(int)[at]
        border = np.flatnonzero((d <= radius) & (d > radius - NEAR))
        leaf = np.concatenate((leaf * 2 + (d > radius), leaf[border] * 2 + 1))
        at = np.concatenate((at, at[border]))
    return at, leaf


def _placed(trees):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                fp = batch.column(0).slice(i, 1 << 14).to_numpy()
                for space, (mask, tree) in enumerate(zip(subspaces(), trees)):
                    at, leaf = tree_shards(fp.view(np.uint64), mask, tree)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf * len(THIRDS) + space), pa.array(fp[at])], ["shard", "fp"])

    return run


def fingerprint_links(points: DataFrame) -> DataFrame:
    """Links (a, b) that span the groups of the distinct fingerprints in column fp."""
    n = points.count()
    if not n:
        return points.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    trees = vantage_points(points, max(0, int(n / LEAF).bit_length()))
    placed = points.select("fp").mapInArrow(_placed(trees), "shard long, fp long")
    large = placed.groupBy("shard").count().where(F.col("count") > TILE).select("shard", F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("blocks"))
    large, _ = stage(large, "large")
    usual = F.broadcast(large) if large.count() <= FEW else large
    dealt = placed.join(usual, "shard", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = dealt.select("shard", "fp", "block", F.explode(others).alias("other"))
    pair = F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other")
    tiles = tiles.select("shard", pair.alias("pair"), F.col("block").cast("long").alias("block"), "fp")
    return tiles.repartition("shard", "pair").sortWithinPartitions("shard", "pair", "block").mapInArrow(_shard_links, "a long, b long").distinct()


def by_key(rows: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` beside the one row of ``few`` with their key.  ``few`` is repeated for SALTS salts and ``rows`` are dealt over
    them by ``spread``, so the rows of one hot key (the centre of a star, the root of a large component) are many tasks' work."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """Least member of the component of every linked node: (node, root).  Star contraction, a staged table a round."""
    spark = links.sparkSession
    edges, path = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "stars")
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = by_key(both.where("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = by_key(large, low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new, at = stage(small, "stars")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(spark, path)
        edges, path = new, at
        if now == before:
            return edges.toDF("node", "root"), [path]
        before = now


def component_ids(points: DataFrame, roots: DataFrame) -> DataFrame:
    """fp, root and component_id (the least id) of the component of every point (fp, least).  Points without a link are their own."""
    linked = roots.union(roots.select("root", "root")).distinct().toDF("fp", "root")
    named = points.join(linked, "fp", "left")
    groups = named.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    own = by_key(named.where("root IS NOT NULL"), groups, "root", "fp").select("fp", "root", "component_id")
    return own.union(named.where("root IS NULL").select("fp", "fp", "least"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed 64-bit), component_id (least doc_id reachable over links)."""
    prints, _ = stage(fingerprints(docs, id_col, text_col), "prints")
    points, at = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots, paths = components(fingerprint_links(points))
    ids, _ = stage(component_ids(points, roots), "components")
    release(docs.sparkSession, at, *paths)
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
