"""Contig post-processing, scoring of settings and abundance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequence as S
from .graph import run_difference
from .kmers import A, AGAIN, Graph
from .staging import staged


def long_enough(contigs: DataFrame, k: int, length: int | None = None, open_length: int | None = None) -> DataFrame:
    """Contigs above the length (k-1 by default); those without head or tail have their own cutoff."""
    length = k - 1 if length is None else length
    least = F.when(F.col("headless") | F.col("tailless"), F.lit(length if open_length is None else open_length)).otherwise(F.lit(length))
    return contigs.where(F.length("seq") > least)


def trim_open_ends(contigs: DataFrame, k: int, bases: int | None = None) -> DataFrame:
    """``bases`` (k+5) off every end without a neighbour."""
    n = k + 5 if bases is None else bases
    front, back = (F.when(F.col(c), F.lit(n)).otherwise(F.lit(0)) for c in ("headless", "tailless"))
    return contigs.withColumn("seq", S.piece("seq", front, F.greatest(F.length("seq") - front - back, F.lit(0))))


def rename_by_length(contigs: DataFrame, by: str = A) -> DataFrame:
    """name: number by descending length, padded to the width of the count."""
    w = Window.partitionBy(by)
    i = F.row_number().over(w.orderBy(F.length("seq").desc(), F.desc("cnt"), "seq")) - 1
    width = F.length(F.count("*").over(w).cast("string"))
    return contigs.withColumn("name", F.concat(F.lit("contig."), F.lpad(i.cast("string"), width, "0")))


def kmer_similarity(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Shared k-mers (with multiplicity) over those of the shorter sequence, for every pair that shares one: a_id, b_id, similarity."""
    def counted(t, name):
        return t.select(F.col("id").alias(f"{name}_id"), F.length("seq").alias(f"{name}_n"), F.explode(S.kmers("seq", k)).alias("kmer")).groupBy(f"{name}_id", f"{name}_n", "kmer").agg(F.count("*").alias(f"{name}_c"))

    both = counted(a, "a").join(counted(b, "b"), "kmer").groupBy("a_id", "b_id", "a_n", "b_n").agg(F.sum(F.least("a_c", "b_c")).alias("shared"))
    return both.select("a_id", "b_id", (F.col("shared") / (F.least("a_n", "b_n") - k + 1)).alias("similarity"))


def keep_like_references(contigs: DataFrame, refs: DataFrame, k: int = 10, cut: float = 0.40, end: int = 75) -> DataFrame:
    """keep: similarity to some reference reaches the cut; for 100 to 400 bases either end alone may reach it."""
    rows = contigs.select("id", "seq")
    n = F.length("seq")
    mid = rows.where(n.between(100, 400))
    parts = rows.unionByName(mid.withColumn("seq", F.left("seq", F.lit(end)))).unionByName(mid.withColumn("seq", F.right("seq", F.lit(end))))
    parts = parts.select(F.struct("id", "seq").alias("id"), "seq")
    best = kmer_similarity(parts, refs, k).groupBy(F.col("a_id.id").alias("id")).agg(F.max("similarity").alias("similarity"))
    return contigs.join(best, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0))).withColumn("keep", F.col("similarity") >= cut)


def keep_whole_groups(contigs: DataFrame, group: str = "group") -> DataFrame:
    """A group stays if one member does."""
    any_kept = contigs.groupBy(group).agg(F.bool_or("keep").alias("_k"))
    return contigs.join(any_kept, group).withColumn("keep", F.col("_k")).drop("_k")


def reads_touching(reads: DataFrame, contig_reads: DataFrame) -> DataFrame:
    return reads.join(contig_reads.select("read_id").distinct(), "read_id", "left_semi")


def used_by_kmers(reads: DataFrame, contigs: DataFrame, k: int, share: float = 0.75) -> DataFrame:
    """Reads counted as used: more than ``share`` of their k-mers seen more than once lie in a contig.  One row a sample."""
    own = reads.select("sample", "read_id", F.explode(S.kmers("seq", k)).alias("kmer"))
    often = own.groupBy("sample", "kmer").count().where("count > 1").select("sample", "kmer")
    inside = contigs.select("sample", F.explode(F.array_distinct(S.kmers("seq", k))).alias("kmer")).distinct().withColumn("in", F.lit(1))
    x = own.join(often, ["sample", "kmer"], "left_semi").join(inside, ["sample", "kmer"], "left")
    per = x.groupBy("sample", "read_id").agg((F.sum(F.coalesce("in", F.lit(0))) / F.count("*")).alias("share"))
    used = per.groupBy("sample").agg(F.count_if(F.col("share") > share).alias("used"))
    return reads.groupBy("sample").agg(F.count("*").alias("total")).join(used, "sample", "left").select("sample", "total", F.coalesce("used", F.lit(0)).alias("used"), (F.coalesce("used", F.lit(0)) / F.col("total")).alias("used_share"))


def used_by_nodes(node_reads: DataFrame, totals: DataFrame) -> DataFrame:
    """Distinct reads on nodes, without occurrence and mate tags, over all reads of the assembly."""
    plain = F.regexp_replace("read", rf"({AGAIN}\d+|_mate)", "")
    used = node_reads.groupBy(A).agg(F.countDistinct(plain).alias("used"))
    return totals.join(used, A, "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("used_share", F.col("used") / F.col("total"))


def score_runs(contigs: DataFrame, internal_length: int, short: int = 100) -> DataFrame:
    """Open ends, short open ends and short inner contigs of each assembly."""
    open_ = F.col("headless") | F.col("tailless")
    return contigs.groupBy(A).agg(
        F.count("*").alias("contigs"), (F.count_if("headless") + F.count_if("tailless")).alias("open_ends"),
        F.count_if(open_ & (F.length("seq") < short)).alias("short_open"), F.count_if(~open_ & (F.length("seq") < internal_length)).alias("short_inner"))


def settings(spark, klens=(31, 41), kcuts=(2, 3, 4, 5), tips=(2, 10, 30)) -> DataFrame:
    """The sweep: every combination of k, cutoff and tip length, a few dozen rows."""
    return spark.createDataFrame([(k, c, t) for k in klens for c in kcuts for t in tips], "klen int, kcut int, tip int")


def best_runs(runs: DataFrame, by: str, start: float = 0.9, step: float = 0.1) -> DataFrame:
    """The best run of each ``by``: highest step of used_share that any run passes; fewest open ends, then short inner
    contigs, then (with fewer than two open ends) contigs; then the lowest cutoff, tip and k."""
    level = F.least(F.floor(F.lit(0.0) + (F.col("used_share") - 1e-12) / step), F.lit(int(round(start / step))))
    best = runs.groupBy(by).agg(F.max(level).alias("_top"))
    order = ["open_ends", "short_inner", F.when(F.col("open_ends") < 2, F.col("contigs")), "kcut", "tip", "klen"]
    x = runs.join(best, by).where(level == F.col("_top"))
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r", "_top")


def stop_early(runs: DataFrame, by: str, patience: int) -> DataFrame:
    """Runs of a sweep (ordered by kcut, tip, klen) up to ``patience`` runs without a new least number of open ends."""
    w = Window.partitionBy(by).orderBy("kcut", "tip", "klen")
    x = runs.withColumns({"_i": F.row_number().over(w), "_before": F.min("open_ends").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    x = x.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("open_ends") < F.col("_before")), F.col("_i")))
    x = x.withColumn("_gap", F.col("_i") - F.max("_new").over(w))
    return x.withColumn("_over", F.max((F.col("_gap") > patience).cast("int")).over(w)).where("_over = 0").drop("_i", "_before", "_new", "_gap", "_over")


def estimate_coverage(contigs: DataFrame, counts: DataFrame, k: int, window: int) -> DataFrame:
    """Per-base coverage of each contig: at every position the window of k-mer counts around it with the least spread
    gives a mean; the estimate is the least mean.  ``counts``: sample, kmer, cnt; missing k-mers count 0."""
    x = contigs.select("sample", "id", F.posexplode(S.kmers("seq", k)).alias("pos", "kmer"))
    c = x.join(counts.select("sample", "kmer", "cnt"), ["sample", "kmer"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    here = Window.partitionBy("sample", "id").orderBy("pos").rowsBetween(0, window - 1)
    w = c.withColumns({"s": F.sum("cnt").over(here), "q": F.sum(F.col("cnt") * F.col("cnt")).over(here), "n": F.count("*").over(here)})
    last = F.max("pos").over(Window.partitionBy("sample", "id"))
    w = w.withColumn("last", last).where((F.col("n") == window) | ((F.col("pos") == 0) & (F.col("last") < window - 1)))
    around = Window.partitionBy("sample", "id").orderBy("pos").rowsBetween(-(window - 1), 0)
    # n q - s^2 is the spread in whole numbers, so equal spreads are equal
    spread = F.col("n") * F.col("q") - F.col("s") * F.col("s")
    per = w.withColumn("best", F.min(F.struct(spread.alias("spread"), "s", "n")).over(around))
    return per.groupBy("sample", "id").agg(F.min(F.col("best.s") / F.col("best.n")).alias("coverage"))


def node_estimates(g: Graph, counts: DataFrame, window: int) -> DataFrame:
    """node_id and coverage of nodes longer than 2 k, estimated from k-mer counts (assembly_id, kmer, cnt)."""
    long = g.nodes.where(F.length("seq") > 2 * g.k).select(A, F.col(A).alias("sample"), F.col("node_id").alias("id"), "seq")
    return estimate_coverage(long, counts.withColumnRenamed(A, "sample"), g.k, window).toDF(A, "node_id", "coverage")


def trim_by_coverage(contigs: DataFrame, counts: DataFrame, k: int, cutoff: int) -> DataFrame:
    """k bases off an end whose outermost k-mer is counted at most twice the cutoff."""
    c = counts.select("sample", "kmer", "cnt")
    x = contigs.withColumns({"_a": F.left("seq", F.lit(k)), "_z": F.right("seq", F.lit(k))})
    x = x.join(c.toDF("sample", "_a", "_ca"), ["sample", "_a"], "left").join(c.toDF("sample", "_z", "_cz"), ["sample", "_z"], "left")
    front, back = (F.when(F.coalesce(v, F.lit(0)) <= 2 * cutoff, F.lit(k)).otherwise(F.lit(0)) for v in ("_ca", "_cz"))
    return x.withColumn("seq", S.piece("seq", front, F.greatest(F.length("seq") - front - back, F.lit(0)))).drop("_a", "_z", "_ca", "_cz")


def unique_contigs(contigs: DataFrame, length: int = 0) -> DataFrame:
    """One contig a sequence (the best counted), of at least ``length``."""
    w = Window.partitionBy(A, "seq").orderBy(F.desc("cnt"), "id")
    return contigs.where(F.length("seq") >= length).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def collapse_homopolymer_equal(contigs: DataFrame, k: int, similarity: float = 0.80) -> DataFrame:
    """Of contigs equal up to homopolymer lengths the better covered one stays (one round)."""
    rows = contigs.withColumn("_runs", S.run_bases("seq"))
    a, b = rows.select(A, "_runs", F.col("id").alias("a_id"), "seq", "coverage"), rows.select(A, "_runs", F.col("id").alias("b_id"), F.col("seq").alias("seq2"), F.col("coverage").alias("cov2"))
    beats = (F.col("cov2") > F.col("coverage")) | ((F.col("cov2") == F.col("coverage")) & (F.col("b_id") < F.col("a_id")))
    shared = F.size(F.array_intersect(S.kmers("seq", k), S.kmers("seq2", k))) / (F.least(F.length("seq"), F.length("seq2")) - k + 1)
    lost = a.join(b, [A, "_runs"]).where((F.col("a_id") != F.col("b_id")) & beats & (shared >= similarity)).select(F.col("a_id").alias("id")).distinct()
    return contigs.join(lost, "id", "left_anti")


def map_reads(reads: DataFrame, contigs: DataFrame, k: int = 5, similarity: float = 0.50, max_error: float = 0.1) -> DataFrame:
    """Best contigs of each read: read_id, contig, errors, ties.  A pair is tried where enough k-mers are shared; the score is
    the least number of mismatches over offsets on which the first or last k bases agree."""
    sim = kmer_similarity(reads.select(F.col("read_id").alias("id"), "seq"), contigs.select(F.col("contig").alias("id"), "seq"), k).where(F.col("similarity") >= similarity)
    x = sim.select(F.col("a_id").alias("read_id"), F.col("b_id").alias("contig")).join(reads.select("read_id", "seq"), "read_id").join(contigs.select("contig", F.col("seq").alias("ref")), "contig")
    n = F.length("seq")
    offsets = F.filter(S.upto(F.length("ref") - n + 1), lambda i: (F.col("ref").substr(i + 1, F.lit(k)) == F.left("seq", F.lit(k))) | (F.col("ref").substr(i + n - k + 1, F.lit(k)) == F.right("seq", F.lit(k))))
    errors = F.array_min(F.transform(offsets, lambda i: S.mismatches(F.col("seq"), F.col("ref").substr(i + 1, n))))
    scored = x.select("read_id", "contig", errors.alias("errors"), n.alias("n")).where((F.col("errors").isNotNull()) & (F.col("errors") <= max_error * F.col("n")))
    best = scored.groupBy("read_id").agg(F.min("errors").alias("least"))
    top = scored.join(best, "read_id").where("errors = least")
    ties = top.groupBy("read_id").agg(F.count("*").alias("ties"))
    return top.join(ties, "read_id").select("read_id", "contig", "errors", "ties")


def resolve_ties(hits: DataFrame, reads: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """Tied contigs that lack a k-mer of the read which another tied contig has go; class: unique, multi or indeterminate."""
    texts = hits.select("read_id", "contig", "ties").join(contigs.select("contig", F.col("seq").alias("ref")).hint("merge"), "contig")
    # texts travel to their read, and what is made of them stays where they lie
    own = texts.repartition("read_id").join(reads.select("read_id", "seq").hint("merge"), "read_id")
    shared = F.array_intersect(S.kmers("seq", k), S.kmers("ref", k))
    votes = own.select("read_id", "contig", "ties", F.explode(shared).alias("kmer")).groupBy("read_id", "kmer", "ties").agg(F.count("*").alias("n"), F.collect_list("contig").alias("contigs"))
    telling = votes.where("n < ties")
    need = telling.groupBy("read_id").agg(F.count("*").alias("need"))
    have = telling.select("read_id", F.explode("contigs").alias("contig")).groupBy("read_id", "contig").agg(F.count("*").alias("have"))
    left = hits.join(need.hint("merge"), "read_id", "left").join(have.hint("merge"), ["read_id", "contig"], "left").where("need IS NULL OR have = need")
    left = staged(left.select("read_id", "contig"))
    n = left.groupBy("read_id").agg(F.count("*").alias("left"))
    out = hits.select("read_id").distinct().join(n, "read_id", "left")
    kind = F.when(F.col("left").isNull(), "indeterminate").when(F.col("left") == 1, "unique").otherwise("multi")
    return out.withColumn("class", kind).join(left.select("read_id", "contig"), "read_id", "left")


def share_multi(hits: DataFrame) -> DataFrame:
    """Counts of contigs (sample, contig): unique reads, plus each multi-mapped read shared by unique counts (evenly where
    none has any), rounded; and the fraction of the sample's total.  ``hits``: sample, read_id, contig."""
    n = hits.groupBy("sample", "read_id").agg(F.count("*").alias("ways"))
    x = hits.join(n, ["sample", "read_id"])
    u = x.where("ways = 1").groupBy("sample", "contig").agg(F.count("*").alias("u"))
    multi = x.where("ways > 1").join(u, ["sample", "contig"], "left").withColumn("u", F.coalesce("u", F.lit(0)))
    total = multi.groupBy("sample", "read_id").agg(F.sum("u").alias("us"))
    part = multi.join(total, ["sample", "read_id"]).withColumn("w", F.when(F.col("us") > 0, F.col("u") / F.col("us")).otherwise(1 / F.col("ways")))
    shares = part.groupBy("sample", "contig").agg(F.sum("w").alias("s"))
    all_ = hits.select("sample", "contig").distinct().join(u, ["sample", "contig"], "left").join(shares, ["sample", "contig"], "left")
    all_ = all_.withColumn("cnt", F.round(F.coalesce("u", F.lit(0)) + F.round(F.coalesce("s", F.lit(0.0)), 6)).cast("long"))
    sums = all_.groupBy("sample").agg(F.sum("cnt").alias("t"))
    return all_.join(sums, "sample").select("sample", "contig", "cnt", (F.col("cnt") / F.col("t")).alias("fraction"))


def contig_coverage(placed: DataFrame, end: int = 25, least: int = 60) -> DataFrame:
    """Mean weighted coverage of each contig (contig, start, end, weight a read), without ``end`` positions at either side of
    contigs of more than ``least`` covered positions."""
    whole = Window.partitionBy("contig")
    before = F.max("end").over(whole.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    # reads stay intervals: no row is made for a base; what a read covers first begins where those before it end
    x = placed.where("end > start").groupBy("contig", "start", "end").agg(F.sum("weight").alias("weight"))
    x = x.withColumn("first", F.least("end", F.greatest("start", F.coalesce(before, "start"))))
    x = x.withColumns({"n": F.sum(F.col("end") - F.col("first")).over(whole), "lo": F.min("start").over(whole), "hi": F.max("end").over(whole)})
    left = F.when(F.col("n") <= least, F.col("lo")).otherwise(F.col("lo") + end)
    right = F.when(F.col("n") <= least, F.col("hi")).otherwise(F.col("hi") - end)

    def inner(start):
        return F.greatest(F.least("end", right) - F.greatest(start, left), F.lit(0))

    sums = x.groupBy("contig").agg(F.sum(F.col("weight") * inner("start")).alias("depth"), F.sum(inner("first")).alias("at"), F.max("n").alias("positions"))
    return sums.select("contig", F.when(F.col("at") > 0, F.col("depth") / F.col("at")).alias("coverage"), "positions")


def enough_coverage(contigs: DataFrame, cutoff: float = 10) -> DataFrame:
    return contigs.where(F.col("coverage") >= cutoff)


def final_or_partial(contigs: DataFrame, ignore_failed: bool = False) -> DataFrame:
    """final: every contig of the region is trimmed; with ``ignore_failed`` untrimmed contigs go instead."""
    if ignore_failed:
        return contigs.where("trim_status").withColumn("final", F.lit(True))
    ok = contigs.groupBy("region").agg(F.bool_and("trim_status").alias("final"))
    return contigs.join(ok, "region")


def name_haplotypes(contigs: DataFrame) -> DataFrame:
    """hap: region.NN by descending count."""
    w = Window.partitionBy("region")
    i = F.row_number().over(w.orderBy(F.desc("cnt"), "seq")) - 1
    width = F.greatest(F.length((F.count("*").over(w) - 1).cast("string")), F.lit(2))
    return contigs.withColumn("hap", F.concat("region", F.lit("."), F.lpad(i.cast("string"), width, "0")))


def recount_totals(classes: DataFrame, reads_in: DataFrame) -> DataFrame:
    """Reads by outcome: unmappable, indeterminate, unique, multi."""
    x = reads_in.select("read_id").distinct().join(classes.select("read_id", "class").distinct(), "read_id", "left")
    return x.agg(F.count("*").alias("reads"), F.count_if(F.col("class").isNull()).alias("unmappable"), *[F.count_if(F.col("class") == c).alias(c) for c in ("indeterminate", "unique", "multi")])


def final_selection(contigs: DataFrame, length: int) -> DataFrame:
    """Trimmed contigs of at least ``length``, with their fraction of the sample's count."""
    kept = contigs.where("trim_status").where(F.length("seq") >= length)
    sums = kept.groupBy("sample").agg(F.sum("cnt").alias("_t"))
    return kept.join(sums, "sample").withColumn("fraction", F.col("cnt") / F.col("_t")).drop("_t")


def variant_positions(contigs: DataFrame, by: str = "region") -> DataFrame:
    """Positions at which contigs of equal length of a group differ, with each contig's base."""
    x = contigs.select(by, "id", F.length("seq").alias("n"), F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    several = x.groupBy(by, "n", "pos").agg(F.countDistinct("base").alias("kinds")).where("kinds > 1")
    return x.join(several, [by, "n", "pos"]).select(by, "id", "pos", "base", "kinds")
