"""Contigs trimmed to a reference: by chained anchors for linear ones, by votes of offsets for circular ones.

A contig's reference is the one that shares most k-mers with it.  Anchors are
k-mers that occur once in the contig and once in that reference.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import sequence as S
from .contigs import kmer_similarity

CHAIN = "struct<first_p:int,first_q:int,last_p:int,last_q:int,size:int>"


def best_references(contigs: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """id and ref_id; equal similarities go to the smaller reference."""
    sim = kmer_similarity(contigs.select("id", "seq"), refs.select("id", "seq"), k)
    return sim.groupBy(F.col("a_id").alias("id")).agg(F.max_by("b_id", F.struct("similarity", (-F.col("b_id")))).alias("ref_id"))


def unique_places(seqs: DataFrame, k: int, *keep: str) -> DataFrame:
    """k-mers that occur once in a sequence, with their place."""
    at = seqs.select("id", *keep, F.posexplode(S.kmers("seq", k)).alias("pos", "kmer"))
    return at.groupBy("id", *keep, "kmer").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n = 1").drop("n")


def longest_chain(ps, qs) -> tuple[int, int, int, int, int] | None:
    """The longest run of anchors that rises in both sequences, as its first and last anchor and its size.

    Of equally long ones that with the least first place, then the least last one.
    ``ps`` rises; best[i] is the best chain that ends at or before the i-th value of q.
    """
    if not len(ps):
        return None
    values = sorted(set(qs))
    best: list[tuple] = [()] * (len(values) + 1)  # a Fenwick tree of maxima
    top = None
    for p, q in zip(ps, qs):
        at, i, before = bisect_left(values, q) + 1, bisect_left(values, q), ()
        while i > 0:
            before = max(before, best[i])
            i -= i & -i
        mine = (before[0] + 1, before[1], before[2]) if before else (1, -p, -q)
        if top is None or mine[:2] > top[0][:2]:
            top = mine, p, q
        while at <= len(values):
            best[at] = max(best[at], mine)
            at += at & -at
    (size, p1, q1), p2, q2 = top
    return -p1, -q1, p2, q2, size


def _chains(ps: pd.Series, qs: pd.Series) -> pd.DataFrame:
    rows = [longest_chain(p, q) for p, q in zip(ps, qs)]
    return pd.DataFrame(rows, columns=["first_p", "first_q", "last_p", "last_q", "size"])


def trim_to_reference(contigs: DataFrame, refs: DataFrame, k: int = 7, errors: int = 3) -> DataFrame:
    """seq cut to the reference's span, with ref_id, trim_start, trim_end and trim_status: both ends were found.

    Anchors of contig and reference are chained; before the first and behind the last
    one, the cut is the place where the contig's piece and the reference's end have
    the least edit distance, at most ``errors`` (ties: nearest to where the anchor
    points, then further left).  An end that is not found stays.
    """
    pairs = best_references(contigs, refs, k)
    own = unique_places(contigs.select("id", "seq"), k).withColumnRenamed("pos", "p").join(pairs, "id")
    theirs = unique_places(refs.select("id", "seq"), k).select(F.col("id").alias("ref_id"), "kmer", F.col("pos").alias("q"))
    anchors = own.join(theirs, ["ref_id", "kmer"]).groupBy("id", "ref_id").agg(F.sort_array(F.collect_list(F.struct("p", "q"))).alias("a"))
    chained = anchors.select("id", "ref_id", F.pandas_udf(_chains, CHAIN)("a.p", "a.q").alias("c"))
    x = contigs.join(chained, "id", "left").join(refs.select(F.col("id").alias("ref_id"), F.col("seq").alias("_ref")), "ref_id", "left")
    c, n, m = F.col("c"), F.length("seq"), F.length("_ref")
    shifts = F.sequence(F.lit(-errors), F.lit(errors))

    def nearest(place, inside, mine, theirs):
        tries = F.transform(shifts, lambda i: F.struct(F.when(inside(place(i)), F.levenshtein(mine(place(i)), theirs)).alias("errors"), F.abs(i).alias("off"), place(i).alias("at")))
        return F.array_min(F.filter(tries, lambda t: t.errors <= errors))

    start = nearest(
        lambda i: c.first_p - c.first_q + i, lambda s: (s >= 0) & (s <= c.first_p), lambda s: S.piece("seq", s, c.first_p - s), F.left("_ref", c.first_q))
    behind = m - c.last_q - k
    end = nearest(
        lambda i: c.last_p + k + behind + i, lambda e: (e >= c.last_p + k) & (e <= n), lambda e: S.piece("seq", c.last_p + k, e - c.last_p - k), S.piece("_ref", c.last_q + k, behind))
    x = x.withColumns({"_s": start, "_e": end})
    a, z = F.coalesce("_s.at", F.lit(0)), F.coalesce("_e.at", n)
    return x.withColumns({"trim_start": a, "trim_end": z, "trim_status": F.col("_s").isNotNull() & F.col("_e").isNotNull(), "seq": S.piece("seq", a, z - a)}).drop("_ref", "_s", "_e", "c")


def circle_offsets(contigs: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """id, ref_id, rev, offset (of the contig's first base in the reference, modulo its length) and votes: the offset most anchors name."""
    def strand(rev):
        return contigs.select("id", F.lit(rev).alias("rev"), (S.reverse_complement("seq") if rev else F.col("seq")).alias("seq"))

    both = strand(False).unionByName(strand(True))
    ring = refs.where(F.length("seq") >= k).select("id", F.length("seq").alias("size"), F.concat("seq", F.left("seq", F.lit(k - 1))).alias("seq"))
    own = both.select("id", "rev", F.posexplode(S.kmers("seq", k)).alias("p", "kmer"))
    theirs = unique_places(ring, k, "size").select(F.col("id").alias("ref_id"), "size", "kmer", F.col("pos").alias("q"))
    votes = own.join(theirs, "kmer").groupBy("id", "ref_id", "rev", F.pmod(F.col("q") - F.col("p"), F.col("size")).alias("offset")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy("id").orderBy(F.desc("votes"), "ref_id", "rev", "offset")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def trim_to_circle(contigs: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """Contigs of a circular reference on its strand, starting where it starts, one round long; with ref_id, rev, closed and trim_status.

    closed: the contig ends as it begins, by k bases or more; the longest such end
    goes and the rest is turned as it is, insertions and all.  Else a contig of a
    round or more gives the round from the reference's first base, put together over
    the contig's ends where it has to be; a shorter one stays open (trim_status false).
    """
    x = contigs.join(circle_offsets(contigs, refs, k), "id", "left").join(refs.select(F.col("id").alias("ref_id"), F.length("seq").cast("long").alias("_size")), "ref_id", "left")
    x = x.withColumn("seq", F.when(F.coalesce("rev", F.lit(False)), S.reverse_complement("seq")).otherwise(F.col("seq")))
    n = F.length("seq")
    # ends that the contig also begins with: places of its first k bases, compared as a whole
    first = F.left("seq", F.lit(k))
    sizes = F.when(n > k, F.filter(F.sequence(F.lit(k), n - 1), lambda o: F.substr("seq", n - o + 1, F.lit(k)) == first)).otherwise(F.array().cast("array<int>"))
    x = x.withColumn("_o", F.array_max(F.filter(sizes, lambda o: F.left("seq", o) == F.right("seq", o))))
    size = F.col("_size")
    # of a doubled circle the longest such end is a whole round, so what is left is one round
    whole = S.piece("seq", 0, n - F.col("_o"))
    lap = F.length(whole)
    at = F.pmod(-F.col("offset"), size).cast("int")
    turn = F.when(at < lap, at).otherwise(F.lit(0))
    closed = F.concat(S.piece(whole, turn, lap), S.piece(whole, 0, turn))
    straight = S.piece("seq", at, size)
    joined = F.concat(S.piece("seq", at, n), S.piece("seq", n - size, at - (n - size)))
    round_ = F.when(at + size <= n, straight).when(n >= size, joined)
    known = F.col("ref_id").isNotNull()
    is_closed = F.coalesce(F.col("_o").isNotNull() & known, F.lit(False))
    out = x.withColumns({"_round": F.when(is_closed, closed).when(known, round_), "closed": is_closed})
    return out.withColumns({"trim_status": F.col("_round").isNotNull(), "seq": F.coalesce("_round", "seq")}).drop("_o", "_size", "_round", "votes", "offset")
