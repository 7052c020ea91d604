"""K-mer counting and the read-threaded graph: nodes, edges and the reads behind them.

Every table carries assembly_id, so all samples, regions and settings run in one job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequence as S
from .staging import staged

A = "assembly_id"
#: Between a read's id and the number of times a k-mer came before in it.
AGAIN = "#again"


@dataclass(frozen=True)
class Graph:
    """nodes (assembly_id, node_id, seq, cnt), edges (assembly_id, src, dst, cnt), node_reads (assembly_id, node_id, read), edge_reads (assembly_id, src, dst, read)."""

    nodes: DataFrame
    edges: DataFrame
    node_reads: DataFrame
    edge_reads: DataFrame
    #: In a sweep an expression of assembly_id.
    k: int | Column

    def with_(self, **changes) -> "Graph":
        return replace(self, **changes)


def explode_kmers(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """pos and kmer of reads longer than k."""
    return reads.where(F.length("seq") > k).select(*keep, F.posexplode(S.kmers("seq", k)).alias("pos", "kmer"))


#: Letters of a minimizer, and the least k from which k-mers travel in pieces that share one.
MINIMIZER, PIECES_FROM = 13, 24


def minimizer_pieces(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """Stretches of reads longer than k whose k-mers have the same minimizer: the least hash of ``MINIMIZER`` letters inside
    each.  Columns least and piece; every k-mer of a read lies in exactly one of its pieces."""
    seq, width = F.col("seq"), k - MINIMIZER + 1

    def cut(least):
        n = F.size(least)
        starts = F.filter(S.upto(n), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))
        return S.let(starts, lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(least, i).alias("least"), seq.substr(i + 1, F.coalesce(F.get(at, j + 1), n) - i + k - 1).alias("piece"))))

    hashes, span = F.transform(S.kmers("seq", MINIMIZER), lambda x: F.xxhash64(x)), 1

    def pairwise(step):  # the least of two spans that begin ``step`` apart
        return lambda h: F.zip_with(F.slice(h, 1, F.size(h) - step), F.slice(h, step + 1, F.size(h) - step), lambda a, b: F.least(a, b))

    while span < width:
        step = min(span, width - span)
        hashes, span = S.let(hashes, pairwise(step)), span + step
    pieces = S.let(hashes, cut)
    return reads.where(F.length("seq") > k).select(*keep, F.explode(pieces).alias("_p")).select(*keep, "_p.least", "_p.piece")


def count_kmers(reads: DataFrame, k: int, *by: str) -> DataFrame:
    """Counts by ``by`` and k-mer.

    Long k-mers overlap in all but a letter, so pieces that share a minimizer are dealt
    out instead, equal ones once, and cut into k-mers where all of a minimizer lie.
    Short k-mers are summed on the map side first.
    """
    if k < PIECES_FROM:
        return explode_kmers(reads, k, *by).groupBy(*by, "kmer").agg(F.count("*").alias("cnt"))
    once = minimizer_pieces(reads, k, *by).groupBy(*by, "least", "piece").agg(F.count("*").alias("_n"))
    # a number of partitions of its own: pieces are few bytes beside the k-mers made of them
    dealt = once.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "least")
    cut = dealt.select(*by, "least", "_n", F.explode(S.kmers("piece", k)).alias("kmer"))
    return cut.groupBy(*by, "least", "kmer").agg(F.sum("_n").alias("cnt")).drop("least")


def spanning_tokens(seq: Column, intervals: Column, k: int) -> Column:
    """Ordered tokens of a read: k-mers outside the intervals, one long token across each.

    A long token starts k-1 bases before its interval and ends k-1 bases after it (or
    at the read's ends), so it overlaps its neighbours by k-1 bases.
    """
    n = F.length(seq)
    spans = F.transform(intervals, lambda x: F.struct(F.greatest(x.start - (k - 1), F.lit(0)).alias("start"), F.least(x.end + (k - 1), n).alias("end")))
    merged = F.filter(S.merge_intervals(spans, 1 - k + 1), lambda x: x.end - x.start >= k)

    def in_order(ks, long):
        """The k-mers up to each long token, then it, and those after the last: no place is looked up among the intervals."""
        def plain(begin, end):
            at = F.when(end > begin, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(ks, i).alias("kmer")))

        def begin(j):
            return F.coalesce(F.get(long, j - 1).end - k + 1, F.lit(0))

        def upto(x, j):
            whole = F.struct(x.start.alias("pos"), seq.substr(x.start + 1, x.end - x.start).alias("kmer"))
            return F.concat(plain(begin(j), x.start), F.array(whole))

        return F.flatten(F.concat(F.transform(long, upto), F.array(plain(begin(F.size(long)), n - k + 1))))

    return S.let(S.kmers(seq, k), lambda ks: S.let(merged, lambda long: in_order(ks, long)))


def with_tokens(reads: DataFrame, k: int, intervals: DataFrame | None = None) -> DataFrame:
    """tokens of reads longer than k, in order: their k-mers, or those around expansion intervals (read_id, intervals),
    which may be a column of the reads."""
    x = reads.where(F.length("seq") > k)
    if intervals is None and "intervals" not in reads.columns:
        return x.withColumn("tokens", S.kmers("seq", k))
    none = F.array().cast("array<struct<start:int,end:int>>")
    spanning = spanning_tokens(F.col("seq"), F.coalesce("intervals", none), k)
    x = x if intervals is None else x.join(intervals, "read_id", "left")
    return x.withColumn("tokens", F.transform(spanning, lambda t: t.kmer)).drop("intervals")


def count_tokens(tokens: DataFrame, *by: str) -> DataFrame:
    return tokens.select(*by, F.explode("tokens").alias("kmer")).groupBy(*by, "kmer").agg(F.count("*").alias("cnt"))


def count_stats(counts: DataFrame, *by: str) -> DataFrame:
    """Mean and median of all counts, of those above 2, and of those above half the larger of the two where that is at least 30."""
    # counts are made once: what follows needs how many k-mers have each count, a few rows
    n = F.col("_n")
    sizes = staged(counts.groupBy(*by, "cnt").agg(F.count("*").alias("_n")))

    def stats(name, over):
        of = F.when(over, F.col("cnt"))
        return (F.sum(of * n) / F.sum(F.when(over, n))).alias(f"mean_{name}"), F.percentile(of, 0.5, n).alias(f"median_{name}")

    one = sizes.groupBy(*by).agg(*stats("all", F.lit(True)), *stats("above2", F.col("cnt") > 2)).withColumn("pivot_count", F.greatest("mean_above2", "median_above2"))
    big = sizes.join(one.select(*by, "pivot_count"), list(by)).where((F.col("pivot_count") >= 30) & (F.col("cnt") > F.col("pivot_count") * 0.5))
    return one.join(big.groupBy(*by).agg(*stats("high", F.lit(True))), list(by), "left")


def cutoffs_from_nodes(node_counts: DataFrame, percents: DataFrame) -> DataFrame:
    """kcut = ceil(percent x count) where the count is above 100.  ``percents`` is a parameter table of a few rows."""
    return node_counts.where("node_count > 100").join(F.broadcast(percents)).withColumn("kcut", F.ceil(F.col("percent") * F.col("node_count")).cast("long"))


def cutoffs_from_bases(reads: DataFrame, ref_length: int, percents: DataFrame) -> DataFrame:
    """kcut = ceil(percent x total bases / reference length), by sample."""
    bases = reads.groupBy("sample").agg(F.sum(F.length("seq").cast("long")).alias("bases"))
    return bases.join(F.broadcast(percents)).withColumn("kcut", F.ceil(F.col("percent") * F.col("bases") / ref_length).cast("long"))


def cutoffs_from_coverage(coverage: DataFrame, percents: DataFrame) -> DataFrame:
    """kcut = round(percent x per-base coverage) where the coverage is above 100."""
    return coverage.where("coverage > 100").join(F.broadcast(percents)).withColumn("kcut", F.round(F.col("percent") * F.col("coverage")).cast("long"))


def nodes_from_counts(counts: DataFrame, cutoff: int) -> DataFrame:
    """Nodes are k-mers counted more than the cutoff."""
    return counts.where(F.col("cnt") > cutoff).select(A, F.xxhash64("kmer").alias("node_id"), F.col("kmer").alias("seq"), "cnt")


def token_ids(tokens: DataFrame) -> DataFrame:
    """Tokens as the hashes that are their nodes' ids."""
    return tokens.withColumn("tokens", F.transform("tokens", lambda t: F.xxhash64(t)))


def token_edges(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges of thread_reads, counted before they are compared with ``nodes``: reads and places in them are left out."""
    ts, known = F.col("tokens"), nodes.select(A, "node_id")
    pairs = F.explode(F.arrays_zip(F.slice(ts, F.lit(1), F.size(ts) - 1).alias("src"), F.slice(ts, F.lit(2), F.size(ts)).alias("dst")))
    edges = token_ids(tokens).where(F.size(ts) > 1).select(A, pairs.alias("e")).groupBy(A, "e.src", "e.dst").agg(F.count("*").alias("cnt"))
    return edges.join(known.toDF(A, "src"), ["src", A], "left_semi").join(known.toDF(A, "dst"), ["dst", A], "left_semi").select(A, "src", "dst", "cnt")


def steps_of(tokens: DataFrame, *keep: str) -> DataFrame:
    """Consecutive tokens of each read: pos, kmer, next, occ and the read's tag.

    occ is how often the token or the next one occurred before in the read; a read
    that repeats one gets a tag of its own there.  Reads without a repeat are cut in
    their own row; the occurrences of the others are numbered in two windows (a read
    is known by its id and the columns of ``keep``).
    """
    marked = tokens.select(A, "read_id", *keep, "tokens", (F.size(F.array_distinct("tokens")) == F.size("tokens")).alias("once"))

    def cut(rows):
        ts = F.col("tokens")
        both = F.arrays_zip(ts.alias("kmer"), F.slice(ts, F.lit(2), F.size(ts)).alias("next"))
        return rows.select(A, "read_id", *keep, F.posexplode(both).alias("pos", "s")).select(A, "read_id", *keep, "pos", F.col("s.kmer").alias("kmer"), F.col("s.next").alias("next"))

    single = cut(marked.where("once")).withColumn("occ", F.lit(0))

    def before(token):
        return F.row_number().over(Window.partitionBy(token, "read_id", A, *keep).orderBy("pos")) - 1

    # whole reads are dealt out, not their steps, and both windows find them in place
    again = cut(marked.where("NOT once").repartition(A, "read_id", *keep)).withColumn("occ", before("kmer"))
    again = again.withColumn("occ", F.greatest("occ", F.when(F.col("next").isNotNull(), before("next")).otherwise(0)))
    name = F.col("read_id").cast("string")
    both = single.unionByName(again)
    return both.withColumn("read", F.when(F.col("occ") == 0, name).otherwise(F.concat_ws(AGAIN, name, F.col("occ").cast("string"))))


def mate_tags(steps: DataFrame) -> DataFrame:
    """Second mates keep the first one's tag where neither k-mer was in the first mate, else the read ends in _mate."""
    # as many rows as there are k-mers, which Spark takes for no more than their texts: sorted, not sent to the driver and all tasks
    first = steps.where("mate = 1").select(A, "pair_id", "kmer").distinct().hint("merge")
    a, b = first.withColumn("_a", F.lit(True)), first.withColumnRenamed("kmer", "next").withColumn("_b", F.lit(True))
    second = steps.where("mate = 2").join(a, [A, "pair_id", "kmer"], "left").join(b, [A, "pair_id", "next"], "left")
    seen = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    second = second.withColumn("read", F.when(seen, F.concat("read", F.lit("_mate"))).otherwise(F.col("read"))).drop("_a", "_b")
    return steps.where("mate = 1").unionByName(second.select(steps.columns))


def thread_reads(tokens: DataFrame, nodes: DataFrame, k: int, paired: bool = False, hold=None) -> Graph:
    """Edges between consecutive tokens that are both nodes, with the reads on nodes and edges.

    ``tokens``: assembly_id, read_id, tokens and, for pairs, pair_id and mate
    (a pair too short in its first mate is just its second).  ``nodes`` are those of
    nodes_from_counts: steps travel by the hashes that are their ids, not by their letters.
    ``hold`` keeps the links, which three tables are made from (``staged``, where all of them are read).
    """
    ids = token_ids(tokens)
    steps = mate_tags(steps_of(ids, "pair_id", "mate")) if paired else steps_of(ids)
    known = nodes.select(A, "node_id")
    links = steps.where("next IS NOT NULL").select(A, F.col("kmer").alias("src"), F.col("next").alias("dst"), "read")
    links = links.join(known.toDF(A, "src"), ["src", A], "left_semi").join(known.toDF(A, "dst"), ["dst", A], "left_semi").select(A, "src", "dst", "read")
    # counted where the last join left them, so equal links are not dealt out again
    links = links.groupBy(A, "src", "dst", "read").agg(F.count("*").alias("n"))
    links = hold(links) if hold else links
    edges = links.groupBy(A, "src", "dst").agg(F.sum("n").alias("cnt"))
    edge_reads = links.select(A, "src", "dst", "read")
    node_reads = links.select(A, F.explode(F.array("src", "dst")).alias("node_id"), "read").distinct()
    return Graph(nodes, edges, node_reads, edge_reads, k)


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with more counts added."""
    return edges.unionByName(more).groupBy(A, "src", "dst").agg(F.sum("cnt").alias("cnt"))


def has_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    return wanted.join(nodes.select(A, "seq"), [A, "seq"], "left_semi")


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes and those of ``more`` whose sequence is new."""
    fresh = more.join(nodes.select(A, "seq"), [A, "seq"], "left_anti").withColumn("node_id", F.xxhash64("seq"))
    return nodes.unionByName(fresh.select(nodes.columns))


def with_key(rows: DataFrame, keys: DataFrame, *on: str, how: str = "left_semi") -> DataFrame:
    """``rows`` beside the ids ``on`` of their assembly, in their own order of columns; ids are sorted by first, as most rows have one assembly."""
    out = rows.join(keys, [*on, A], how)
    return out.select(*rows.columns, *(c for c in out.columns if c not in rows.columns))


def keep_nodes(g: Graph, keep: DataFrame) -> Graph:
    """Only the nodes of ``keep`` (assembly_id, node_id), their edges and reads."""
    ids = keep.select(A, "node_id")
    src, dst = ids.toDF(A, "src"), ids.toDF(A, "dst")
    return g.with_(
        nodes=with_key(g.nodes, ids, "node_id"), node_reads=with_key(g.node_reads, ids, "node_id"),
        edges=with_key(with_key(g.edges, src, "src"), dst, "dst"), edge_reads=with_key(with_key(g.edge_reads, src, "src"), dst, "dst"),
    )


def keep_edges(g: Graph, keep: DataFrame) -> Graph:
    ids = keep.select(A, "src", "dst")
    return g.with_(edges=with_key(g.edges, ids, "src", "dst"), edge_reads=with_key(g.edge_reads, ids, "src", "dst"))


def prune_nodes(g: Graph, cutoff: int) -> Graph:
    """Nodes counted at most ``cutoff`` go, with their edges."""
    return keep_nodes(g, g.nodes.where(F.col("cnt") > cutoff))


def prune_edges(g: Graph, cutoff: int) -> Graph:
    return keep_edges(g, g.edges.where(F.col("cnt") > cutoff))


def degrees(g: Graph) -> DataFrame:
    """nodes with heads (edges in) and tails (edges out), headless and tailless."""
    ins = g.edges.groupBy(A, F.col("dst").alias("node_id")).agg(F.count("*").alias("heads"))
    outs = g.edges.groupBy(A, F.col("src").alias("node_id")).agg(F.count("*").alias("tails"))
    x = with_key(with_key(g.nodes, ins, "node_id", how="left"), outs, "node_id", how="left")
    x = x.withColumns({"heads": F.coalesce("heads", F.lit(0)), "tails": F.coalesce("tails", F.lit(0))})
    return x.withColumns({"headless": F.col("heads") == 0, "tailless": F.col("tails") == 0})


def neighbours(g: Graph) -> DataFrame:
    """first and last tail and head of every node, by id."""
    outs = g.edges.groupBy(A, F.col("src").alias("node_id")).agg(F.min("dst").alias("first_tail"), F.max("dst").alias("last_tail"))
    ins = g.edges.groupBy(A, F.col("dst").alias("node_id")).agg(F.min("src").alias("first_head"), F.max("src").alias("last_head"))
    return g.nodes.join(outs, [A, "node_id"], "left").join(ins, [A, "node_id"], "left")


def unique_names(nodes: DataFrame) -> DataFrame:
    """name: the sequence, with a number where several nodes share it."""
    i = F.row_number().over(Window.partitionBy(A, "seq").orderBy("node_id")) - 1
    return nodes.withColumn("_i", i).withColumn("name", F.when(F.col("_i") == 0, F.col("seq")).otherwise(F.concat("seq", F.col("_i").cast("string")))).drop("_i")


def broken_edges(g: Graph) -> DataFrame:
    """Edges whose end is not a node; an intact graph has none."""
    ids = g.nodes.select(A, "node_id")
    src = g.edges.join(ids.toDF(A, "src"), [A, "src"], "left_anti")
    dst = g.edges.join(ids.toDF(A, "dst"), [A, "dst"], "left_anti")
    return src.unionByName(dst).distinct()


def state_counts(g: Graph) -> DataFrame:
    return degrees(g).groupBy(A).agg(
        F.count("*").alias("nodes"), F.count_if("headless").alias("headless"), F.count_if("tailless").alias("tailless"), F.count_if(F.col("headless") & F.col("tailless")).alias("isolated"))


def tail_histogram(g: Graph) -> DataFrame:
    return degrees(g).groupBy(A, "tails").agg(F.count("*").alias("n"))


def by_size(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(A, F.length("seq").desc(), F.desc("cnt"), "seq", "node_id")


def for_settings(g: Graph, settings: DataFrame) -> Graph:
    """A copy of the graph for every row of ``settings`` (setting), a small parameter table; ids stay."""
    def copy(t):
        return t.join(F.broadcast(settings.select("setting"))).withColumn(A, F.concat_ws("|", A, "setting")).drop("setting")

    return Graph(copy(g.nodes), copy(g.edges), copy(g.node_reads), copy(g.edge_reads), g.k)
