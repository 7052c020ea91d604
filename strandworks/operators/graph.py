"""Graph rewriting as rounds of joins and aggregates; each operator maps a Graph to a Graph.

Rounds are synchronous: where the order of changes matters, an independent set of
nodes, ranked by support and then id, changes in one round and the rest wait.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions import sequence as S
from .kmers import A, AGAIN, Graph, degrees, keep_edges, keep_nodes, steps_of, token_ids, with_key
from .staging import staged, staged_all


def staged_graph(g: Graph) -> Graph:
    nodes, edges, node_reads, edge_reads = staged_all(g.nodes, g.edges, g.node_reads, g.edge_reads)
    return g.with_(nodes=nodes, edges=edges, node_reads=node_reads, edge_reads=edge_reads)


# --- linear paths -----------------------------------------------------------------


def chain_edges(g: Graph) -> DataFrame:
    """Edges that are the only one out of their source and the only one into their target."""
    outs = g.edges.groupBy(A, "src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1 AND src <> dst").drop("n")
    ins = g.edges.groupBy(A, "dst").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return with_key(outs, ins, "dst")


def _jump(state: DataFrame) -> DataFrame:
    """Every open node points as far again as it did, and knows the least id on the way."""
    at = state.select(A, F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("rank").alias("rank2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
    moved = state.where("NOT done").join(at, ["up", A]).select(
        A, "node_id", F.col("up2").alias("up"), (F.col("rank") + F.col("rank2")).alias("rank"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"))
    return state.where("done").unionByName(moved)


def chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """chain (id of the first node) and rank of every node; a node without links is a chain of its own."""
    found = linked_chains(nodes, links)
    alone = nodes.select(A, "node_id").join(found.select(A, "node_id"), [A, "node_id"], "left_anti")
    return found.unionByName(alone.select(A, "node_id", F.col("node_id").alias("chain"), F.lit(0).cast("long").alias("rank")))


def linked_chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """chain and rank of the nodes on ``links``, by pointer jumping; a circle starts at its least sequence.

    Two jumps a written table; how many nodes are open is observed while it is written.
    """
    def held(df):
        seen = Observation()
        out = staged(df.observe(seen, F.count_if(~F.col("done")).alias("n"), F.sum(F.when(~F.col("done"), F.col("low").cast("decimal(38,0)"))).alias("low")))
        return out, (seen.get["n"], seen.get["low"])

    above = links.select(A, F.col("dst").alias("node_id"), F.col("src").alias("up"))
    heads = links.select(A, F.col("src").alias("node_id")).join(above.select(A, "node_id"), ["node_id", A], "left_anti").withColumn("up", F.col("node_id"))
    state, open_ = held(above.withColumn("done", F.lit(False)).unionByName(heads.withColumn("done", F.lit(True))).select(
        A, "node_id", "up", F.when(F.col("done"), 0).otherwise(1).cast("long").alias("rank"), F.least("node_id", "up").alias("low"), "done"))
    before = None
    while open_[0] and open_ != before:
        before = open_
        state, open_ = held(_jump(_jump(state)))
    found = state.where("done").select(A, "node_id", F.col("up").alias("chain"), "rank")
    if not open_[0]:
        return found
    # only circles are left, and each node knows the least id of its own
    rings = nodes.join(state.where("NOT done").select(A, "node_id", "low"), [A, "node_id"])
    heads = rings.groupBy(A, "low").agg(F.min_by("node_id", F.struct("seq", "node_id")).alias("dst"))
    cut = links.join(rings.select(A, F.col("node_id").alias("dst")), [A, "dst"], "left_semi").join(heads, [A, "dst"], "left_anti")
    return found.unionByName(linked_chains(rings.select(A, "node_id", "seq"), cut))


def joined_nodes(nodes: DataFrame, place: DataFrame, k: int | Column) -> DataFrame:
    """Nodes of one chain as its first node: sequences joined with k-1 overlap, counts summed; the others as they are."""
    tail = F.when(F.col("rank") == 0, F.col("seq")).otherwise(F.col("seq").substr(F.lit(k), F.length("seq")))
    made = nodes.join(place, ["node_id", A]).groupBy(A, F.col("chain").alias("node_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", tail.alias("s")))), lambda x: x.s), "").alias("seq"), F.sum("cnt").alias("cnt"))
    return made.select(A, "node_id", "seq", "cnt").unionByName(nodes.select(A, "node_id", "seq", "cnt").join(place.select(A, "node_id"), ["node_id", A], "left_anti").select(A, "node_id", "seq", "cnt"))


def placed_edges(edges: DataFrame, place: DataFrame) -> DataFrame:
    """Edges with new_src and new_dst, the nodes that chains become; inner: inside a chain; chained: an end lies on one."""
    a, b = place.toDF(*(c if c == A else f"{c}1" for c in place.columns)), place.toDF(*(c if c == A else f"{c}2" for c in place.columns))
    x = edges.join(a.withColumnRenamed("node_id1", "src"), ["src", A], "left").join(b.withColumnRenamed("node_id2", "dst"), ["dst", A], "left")
    return x.select(
        A, "src", "dst", "cnt", F.coalesce("chain1", "src").alias("new_src"), F.coalesce("chain2", "dst").alias("new_dst"),
        F.coalesce((F.col("chain1") == F.col("chain2")) & (F.col("rank2") == F.col("rank1") + 1), F.lit(False)).alias("inner"), F.expr("chain1 IS NOT NULL OR chain2 IS NOT NULL").alias("chained"))


def contract(g: Graph, place: DataFrame) -> Graph:
    """Nodes of one chain become its first node: sequences joined with k-1 overlap, counts summed, reads united.

    ``place`` (linked_chains) has the nodes of chains only; what lies on none of them keeps its ids and is not dealt anew.
    """
    ids, nodes = place.select(A, "node_id"), joined_nodes(g.nodes, place, g.k)
    x = placed_edges(g.edges, place).where("chained").drop("chained")
    x = staged(x)
    at, new = x.select(A, "src", "dst"), x.where("NOT inner").select(A, "src", "dst", "new_src", "new_dst", "cnt")

    def ends(t):
        return t.drop("src", "dst").withColumnsRenamed({"new_src": "src", "new_dst": "dst"})

    edges = ends(new).groupBy(A, "src", "dst").agg(F.sum("cnt").alias("cnt")).select(A, "src", "dst", "cnt")
    edges = edges.unionByName(g.edges.select(A, "src", "dst", "cnt").join(at, ["src", "dst", A], "left_anti").groupBy(A, "src", "dst").agg(F.sum("cnt").alias("cnt")))
    # no two edges outside the chains get the same ends, as a chain is entered at its first node and left at its last one:
    # reads told apart under the old ends, where the join has put them, stay apart under the new ones
    there = g.edge_reads.select(A, "src", "dst", "read").join(x.drop("cnt"), ["src", "dst", A], "left").where("inner IS NULL OR NOT inner")
    edge_reads = there.groupBy(A, "src", "dst", "read").agg(F.any_value("new_src").alias("new_src"), F.any_value("new_dst").alias("new_dst")).select(
        A, F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "read")
    united = g.node_reads.join(place, ["node_id", A]).select(A, F.col("chain").alias("node_id"), "read").distinct()
    node_reads = united.unionByName(with_key(g.node_reads.select(A, "node_id", "read"), ids, "node_id", how="left_anti").distinct())
    return g.with_(nodes=nodes, edges=edges, node_reads=node_reads, edge_reads=edge_reads)


def collapse(g: Graph) -> Graph:
    """Every single-linked path becomes one node (circles too, cut at their least sequence)."""
    return contract(g, linked_chains(g.nodes, staged(chain_edges(g))))


def collapsed_shape(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the collapsed graph, and every edge with its place in it (placed_edges), from nodes and edges alone."""
    place = linked_chains(nodes, staged(chain_edges(Graph(nodes, edges, None, None, k))))
    placed = staged(placed_edges(edges, place).drop("chained"))
    # no two edges outside the chains get the same ends (see contract)
    left = placed.where("NOT inner").select(A, F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "cnt")
    return joined_nodes(nodes, place, k), left, placed


def collapsed_links(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    """Links of reads on the edges of ``placed``, each once, under the ends that these have in the collapsed graph: src, dst, read, inner.

    Steps are dealt out by their edge, once; tokens and nodes that are not in the graph go there.
    """
    steps = steps_of(token_ids(tokens)).where("next IS NOT NULL").select(A, F.col("kmer").alias("src"), F.col("next").alias("dst"), "read")
    links = steps.join(placed.drop("cnt"), ["src", "dst", A]).distinct()
    return links.select(A, F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "read", "inner")


def reads_on_nodes(links: DataFrame) -> DataFrame:
    """node_reads of collapsed_links, dealt out by their node alone: what is joined on it finds them in place."""
    ends = F.when(F.col("inner"), F.array("src")).otherwise(F.array("src", "dst"))
    return links.select(A, F.explode(ends).alias("node_id"), "read").repartition("node_id", A).distinct()


def split_low_coverage(g: Graph, cutoff: int) -> Graph:
    """A node with one way in and one out, which share too few reads, is split in two."""
    d = degrees(g).where("heads = 1 AND tails = 1").select(A, "node_id")
    i = g.edge_reads.select(A, F.col("src").alias("h"), F.col("dst").alias("node_id"), "read")
    o = g.edge_reads.select(A, F.col("src").alias("node_id"), F.col("dst").alias("t"), "read")
    ins, outs = (x.join(d, [A, "node_id"], "left_semi") for x in (i, o))
    n = ins.groupBy(A, "node_id").agg(F.count("*").alias("n_in")).join(outs.groupBy(A, "node_id").agg(F.count("*").alias("n_out")), [A, "node_id"])
    shared = ins.join(outs, [A, "node_id", "read"]).groupBy(A, "node_id").agg(F.count("*").alias("shared"))
    bad = n.join(shared, [A, "node_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(0))).where((F.col("shared") != F.least("n_in", "n_out")) & (F.col("shared") <= cutoff)).select(A, "node_id")
    mark = bad.withColumn("twin", F.xxhash64("node_id", F.lit("split")))
    nodes = g.nodes.unionByName(g.nodes.join(mark, [A, "node_id"]).select(A, F.col("twin").alias("node_id"), "seq", "cnt"))

    def moved(t):
        return t.join(mark.withColumnRenamed("node_id", "src"), [A, "src"], "left").withColumn("src", F.coalesce("twin", "src")).select(t.columns)

    reads = outs.join(mark, [A, "node_id"]).select(A, F.col("twin").alias("node_id"), "read")
    return g.with_(nodes=nodes, edges=moved(g.edges), edge_reads=moved(g.edge_reads), node_reads=g.node_reads.unionByName(reads))


# --- tips, islands, loops ---------------------------------------------------------


def read_counts(g: Graph) -> DataFrame:
    return g.node_reads.groupBy(A, "node_id").agg(F.count("*").alias("reads"))


def tip_nodes(g: Graph, length: int, cutoff: int | DataFrame | None = None) -> DataFrame:
    """Ends of the graph shorter than k + length that fewer than ``cutoff`` reads support: one number, or a table
    (assembly_id, tip_cutoff) in which null, like no cutoff at all, sets no limit."""
    d = with_key(degrees(g), read_counts(g), "node_id", how="left").withColumn("reads", F.coalesce("reads", F.lit(0)))
    tips = d.where("headless <> tailless").where(F.length("seq") - g.k < length)
    if isinstance(cutoff, DataFrame):
        return tips.join(cutoff, A, "left").where(F.col("tip_cutoff").isNull() | (F.col("reads") < F.col("tip_cutoff"))).drop("tip_cutoff")
    return tips if cutoff is None else tips.where(F.col("reads") < cutoff)


def without_tips(g: Graph, tips: DataFrame) -> Graph:
    # the edges of a tip go with it
    return keep_nodes(g, with_key(g.nodes, tips, "node_id", how="left_anti"))


def remove_tips(g: Graph, length: int, cutoff: int | DataFrame | None = None, until_stable: bool = True) -> Graph:
    while True:
        tips = staged(tip_nodes(g, length, cutoff).select(A, "node_id"))
        if tips.isEmpty():
            return g
        g = staged_graph(without_tips(g, tips))
        if not until_stable:
            return g


def tip_cutoffs(stats: DataFrame, cutoff: int | Column) -> DataFrame:
    """(assembly_id, tip_cutoff) from the k-mer count statistics of each assembly: no limit where the usual count is below
    ten, else the larger of 40 % of it and cutoff + 2."""
    usual = F.coalesce(F.greatest("mean_high", "median_high"), "pivot_count", F.lit(0.0))
    least = (F.lit(cutoff) if isinstance(cutoff, int) else cutoff) + 2
    return stats.select(A, F.when(usual >= 10, F.greatest(F.round(usual * 0.40), least)).cast("long").alias("tip_cutoff"))


def remove_pair_tips(g: Graph, length: int) -> Graph:
    """After disentangling: isolated pieces of two nodes, one of them short; a partner that equals another node goes too."""
    d = degrees(g).select(A, "node_id", "heads", "tails", "seq")
    s, t = d.toDF(A, "src", "h1", "t1", "s1"), d.toDF(A, "dst", "h2", "t2", "s2")
    alone = g.edges.join(s, [A, "src"]).join(t, [A, "dst"]).where("h1 = 0 AND t1 = 1 AND h2 = 1 AND t2 = 0")
    short = (F.length("s1") - g.k < length) | (F.length("s2") - g.k < length)
    twice = g.nodes.groupBy(A, "seq").agg(F.count("*").alias("n")).where("n > 1").select(A, "seq")
    pieces = alone.where(short)
    tips = pieces.select(A, F.explode(F.array(
        F.struct(F.col("src").alias("node_id"), F.col("s1").alias("seq")), F.struct(F.col("dst").alias("node_id"), F.col("s2").alias("seq")))).alias("x")).select(A, "x.node_id", "x.seq")
    gone = tips.where(F.length("seq") - g.k < length).select(A, "node_id").union(tips.join(twice, [A, "seq"], "left_semi").select(A, "node_id")).distinct()
    return keep_nodes(g, g.nodes.join(gone, [A, "node_id"], "left_anti"))


def remove_islands(g: Graph, length: int | None = None) -> Graph:
    """Isolated nodes of at most ``length`` bases (k by default) go; edges and the reads on them touch none of these and stay as they are."""
    short = g.nodes.where(F.length("seq") <= (g.k if length is None else length)).select(A, "node_id")
    for end in ("src", "dst"):
        short = with_key(short, g.edges.select(A, F.col(end).alias("node_id")), "node_id", how="left_anti")
    gone = staged(short)  # few: Spark knows their size then, and need not deal out the reads for them
    return g.with_(**{name: with_key(t, gone, "node_id", how="left_anti") for name, t in (("nodes", g.nodes), ("node_reads", g.node_reads))})


def self_loops(g: Graph) -> DataFrame:
    return g.edges.where("src = dst")


def break_self_loops(g: Graph, keep_others: bool = False) -> Graph:
    """Loops on one node are cut; unless ``keep_others``, the node's other edges too."""
    if keep_others:
        return g.with_(edges=g.edges.where("src <> dst"), edge_reads=g.edge_reads.where("src <> dst"))
    loops = staged(self_loops(g).select(A, F.col("src").alias("node_id")))  # few, as in remove_islands
    src, dst = loops.toDF(A, "src"), loops.toDF(A, "dst")
    return g.with_(**{name: with_key(with_key(t, src, "src", how="left_anti"), dst, "dst", how="left_anti") for name, t in (("edges", g.edges), ("edge_reads", g.edge_reads))})


# --- disentangling ----------------------------------------------------------------


def connector_cutoff(cutoff: int | Column) -> int | Column:
    """From 6 on, 34 % of the cutoff and at least 3; below, the cutoff and at most 3."""
    if isinstance(cutoff, Column):
        return F.when(cutoff >= 6, F.greatest(F.lit(3), F.floor(0.34 * cutoff))).otherwise(F.least(F.lit(3), cutoff))
    return max(3, int(0.34 * cutoff)) if cutoff >= 6 else min(3, cutoff)


def shared_reads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reads of both tables (assembly_id, read)."""
    return a.select(A, "read").join(b.select(A, "read"), [A, "read"]).distinct()


def reads_of_both(g: Graph, edges: DataFrame) -> DataFrame:
    """Reads on both ends of ``edges`` (assembly_id, src, dst): those of the end with fewer reads, looked up at the other one."""
    few, nr = read_counts(g), g.node_reads.select(A, "node_id", "read")
    for end in ("src", "dst"):
        edges = edges.join(few.toDF(A, end, f"{end}_reads"), [end, A])
    fewer = F.col("src_reads") <= F.col("dst_reads")
    ends = edges.select(A, "src", "dst", F.when(fewer, F.col("src")).otherwise(F.col("dst")).alias("node_id"), F.when(fewer, F.col("dst")).otherwise(F.col("src")).alias("other"))
    return ends.join(nr, ["node_id", A]).drop("node_id").join(nr.withColumnRenamed("node_id", "other"), ["other", "read", A], "left_semi").select(A, "src", "dst", "read")


def bridges(g: Graph, cutoff: int, by_nodes: bool = False) -> DataFrame:
    """(node_id, h, t, n): reads that pass a node only from h to t, where more than the connector cutoff do."""
    d = degrees(g).where("heads > 0 AND tails > 0 AND (heads > 1 OR tails > 1)").select(A, "node_id")
    on = (reads_of_both(g, g.edges.select(A, "src", "dst").where("src <> dst")) if by_nodes else g.edge_reads.where("src <> dst")).select(A, "src", "dst", "read")
    none = F.lit(None).cast("long")
    ends = F.explode(F.array(
        F.struct(F.col("dst").alias("node_id"), F.col("src").alias("h"), none.alias("t")), F.struct(F.col("src").alias("node_id"), none.alias("h"), F.col("dst").alias("t")))).alias("e")
    # both sides of a node meet in one aggregate: a read's ways through it, heads times tails, are one only where both are
    sides = on.select(A, "read", ends).select(A, "read", "e.node_id", "e.h", "e.t")
    through = sides.groupBy("node_id", "read", A).agg(F.count("h").alias("ins"), F.count("t").alias("outs"), F.min("h").alias("h"), F.min("t").alias("t")).where("ins = 1 AND outs = 1")
    ways = through.groupBy(A, "node_id", "h", "t").agg(F.count("*").alias("n")).where(F.col("n") > connector_cutoff(cutoff))
    return with_key(ways, d, "node_id").select(A, "node_id", "h", "t", "n")


def disentangle(g: Graph, cutoff: int, by_nodes: bool = False, conservative: bool = False) -> tuple[Graph, DataFrame]:
    """One round: a copy of the node for every bridged way through it.  Returns the graph and the assemblies that changed."""
    b = bridges(g, cutoff, by_nodes)
    if conservative:  # only where every edge of the node is explained
        d = degrees(g).select(A, "node_id", "heads", "tails")
        full = b.groupBy(A, "node_id").agg(F.countDistinct("h").alias("nh"), F.countDistinct("t").alias("nt")).join(d, [A, "node_id"]).where("nh = heads AND nt = tails")
        b = b.join(full, [A, "node_id"], "left_semi")
    b = staged(b)
    rank = b.groupBy(A, "node_id").agg(F.sum("n").alias("w")).join(g.nodes.select(A, "node_id", "seq"), [A, "node_id"])
    near = g.edges.select(A, "src", "dst").union(g.edges.select(A, "dst", "src")).toDF(A, "node_id", "other").where("node_id <> other")
    beaten = near.join(rank, [A, "node_id"]).join(rank.toDF(A, "other", "w2", "seq2"), [A, "other"]).where("w2 > w OR (w2 = w AND (seq2 < seq OR (seq2 = seq AND other < node_id)))").select(A, "node_id").distinct()
    chosen = staged(rank.join(beaten, [A, "node_id"], "left_anti").select(A, "node_id"))
    changed = chosen.select(A).distinct()
    if changed.isEmpty():
        return g, changed
    b = b.join(chosen, [A, "node_id"], "left_semi").withColumn("new", F.xxhash64("node_id", "h", "t"))
    fresh = b.join(g.nodes.select(A, "node_id", "seq"), [A, "node_id"]).select(A, F.col("new").alias("node_id"), "seq", F.col("n").alias("cnt"))
    into = b.select(A, F.col("h").alias("src"), F.col("new").alias("dst"), F.col("n").alias("cnt"))
    out = b.select(A, F.col("new").alias("src"), F.col("t").alias("dst"), F.col("n").alias("cnt"))
    used = b.select(A, F.col("h").alias("src"), F.col("node_id").alias("dst")).union(b.select(A, "node_id", "t")).distinct()
    left = g.edges.join(used, ["src", "dst", A], "left_anti").where(F.col("cnt") > connector_cutoff(cutoff))
    i = g.edge_reads.select(A, F.col("src").alias("h"), F.col("dst").alias("node_id"), "read")
    o = g.edge_reads.select(A, F.col("src").alias("node_id"), F.col("dst").alias("t"), "read")
    reads = staged(b.join(i, ["node_id", "h", A]).join(o, ["node_id", "t", "read", A]).select(A, "node_id", "h", "t", "new", "read").distinct())
    edge_reads = g.edge_reads.join(left, ["src", "dst", A], "left_semi").unionByName(reads.select(A, F.col("h").alias("src"), F.col("new").alias("dst"), "read")).unionByName(reads.select(A, F.col("new").alias("src"), F.col("t").alias("dst"), "read"))
    node_reads = g.node_reads.join(reads.select(A, "node_id", "read"), ["node_id", "read", A], "left_anti").unionByName(reads.select(A, F.col("new").alias("node_id"), "read"))
    edges = left.unionByName(into).unionByName(out)
    # what is left of a changed node stays only while it has an edge
    linked = edges.select(A, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    rest = g.nodes.join(chosen, [A, "node_id"], "left_semi").join(linked, [A, "node_id"], "left_anti").select(A, "node_id")
    out_graph = Graph(g.nodes.join(rest, [A, "node_id"], "left_anti").unionByName(fresh), edges, node_reads, edge_reads, g.k)
    return staged_graph(keep_nodes(out_graph, out_graph.nodes)), changed


def share_loop_nodes(g: Graph) -> Graph:
    """Two nodes that feed each other through one linear node: the linear node is copied once, one copy each way."""
    d = degrees(g).where("heads = 2 AND tails = 2").select(A, F.col("node_id").alias("m"))
    i = g.edges.select(A, F.col("src").alias("x"), F.col("dst").alias("m"))
    o = g.edges.select(A, F.col("src").alias("m"), F.col("dst").alias("y"))
    seqs = g.nodes.select(A, "node_id", "seq")
    both = i.join(d, [A, "m"], "left_semi").join(o, [A, "m"]).join(seqs.toDF(A, "x", "xs"), [A, "x"]).join(seqs.toDF(A, "y", "ys"), [A, "y"]).where("xs < ys OR (xs = ys AND x < y)").select(A, "m", "x", "y")
    back = o.select(A, "m", F.col("y").alias("x")).join(i.select(A, "m", F.col("x").alias("y")), [A, "m"])
    way = both.join(back, [A, "m", "x", "y"]).withColumn("copy", F.xxhash64("m", F.lit("loop")))
    nodes = g.nodes.unionByName(way.join(g.nodes.withColumnRenamed("node_id", "m"), [A, "m"]).select(A, F.col("copy").alias("node_id"), "seq", "cnt"))

    def moved(t):
        a = way.select(A, F.col("m").alias("dst"), F.col("x").alias("src"), F.col("copy").alias("new_dst"))
        b = way.select(A, F.col("m").alias("src"), F.col("y").alias("dst"), F.col("copy").alias("new_src"))
        y = t.join(a, [A, "src", "dst"], "left").join(b, [A, "src", "dst"], "left")
        return y.withColumns({"dst": F.coalesce("new_dst", "dst"), "src": F.coalesce("new_src", "src")}).select(t.columns)

    edge_reads = moved(g.edge_reads)
    extra = edge_reads.join(way.select(A, F.col("copy").alias("dst")), [A, "dst"], "left_semi").select(A, F.col("dst").alias("node_id"), "read")
    return g.with_(nodes=nodes, edges=moved(g.edges), edge_reads=edge_reads, node_reads=g.node_reads.unionByName(extra.distinct()))


# --- bubbles ----------------------------------------------------------------------


def bubble_groups(g: Graph, least: int = 2, most: int = 2) -> DataFrame:
    """Nodes with one head and one tail, by that pair: members ranked by count (rank 1 is the best)."""
    i = g.edges.groupBy(A, F.col("dst").alias("node_id")).agg(F.count("*").alias("a"), F.min("src").alias("h")).where("a = 1")
    o = g.edges.groupBy(A, F.col("src").alias("node_id")).agg(F.count("*").alias("b"), F.min("dst").alias("t")).where("b = 1")
    x = g.nodes.join(i, [A, "node_id"]).join(o, [A, "node_id"])
    size = x.groupBy(A, "h", "t").agg(F.count("*").alias("size")).where(F.col("size").between(least, most))
    w = Window.partitionBy(A, "h", "t").orderBy(F.desc("cnt"), "node_id")
    return x.join(size, [A, "h", "t"]).withColumn("rank", F.row_number().over(w)).select(A, "h", "t", "size", "rank", "node_id", "seq", "cnt")


def merge_into(g: Graph, pairs: DataFrame) -> Graph:
    """Nodes ``node_id`` of ``pairs`` merge into ``best``: counts and reads are added; both have the same neighbours."""
    to = pairs.select(A, "node_id", "best")
    added = to.join(g.nodes, [A, "node_id"]).groupBy(A, F.col("best").alias("node_id")).agg(F.sum("cnt").alias("more"))
    nodes = g.nodes.join(to, [A, "node_id"], "left_anti").join(added, [A, "node_id"], "left").select(A, "node_id", "seq", (F.col("cnt") + F.coalesce("more", F.lit(0))).alias("cnt"))

    def renamed(t, *cols):
        for c in cols:
            t = t.join(to.toDF(A, c, "_best"), [A, c], "left").withColumn(c, F.coalesce("_best", c)).drop("_best")
        return t

    edges = renamed(g.edges, "src", "dst").groupBy(A, "src", "dst").agg(F.sum("cnt").alias("cnt"))
    return g.with_(
        nodes=nodes, edges=edges, edge_reads=renamed(g.edge_reads, "src", "dst").select(A, "src", "dst", "read").distinct(),
        node_reads=renamed(g.node_reads, "node_id").select(A, "node_id", "read").distinct(),
    )


def collapse_bubbles(g: Graph, max_errors: int, multiplier: float, max_length_difference: int = 20) -> Graph:
    """Bubbles of exactly two nodes: the weaker merges into the stronger if that is ``multiplier`` times better and within the errors."""
    b = bubble_groups(g)
    best = b.where("rank = 1").select(A, "h", "t", F.col("node_id").alias("best"), F.col("seq").alias("best_seq"), F.col("cnt").alias("best_cnt"))
    x = b.where("rank = 2").join(best, [A, "h", "t"])
    ok = (F.abs(F.length("seq") - F.length("best_seq")) <= max_length_difference) & (F.col("best_cnt") >= multiplier * F.col("cnt"))
    return merge_into(g, x.where(ok & (F.levenshtein("seq", "best_seq", max_errors) >= 0)))


def run_difference(a: Column, b: Column) -> Column:
    """Sum of run length differences of two sequences with the same bases run by run, else null."""
    return F.when(S.run_bases(a) == S.run_bases(b), F.aggregate(F.zip_with(S.runs(a), S.runs(b), lambda x, y: F.abs(x["size"] - y["size"])), F.lit(0), lambda s, v: s + v))


def collapse_indels(g: Graph, multiplier: float, limit: int = 1, estimates: DataFrame | None = None, max_length_difference: int = 10) -> Graph:
    """Bubbles of two or three nodes that differ in homopolymer lengths only: the weaker merge into the best covered.

    Coverage is the node's estimate (node_id, coverage) where there is one, else its
    count by k-mer; nodes are ranked by it, then by sequence.
    """
    depth = F.col("cnt") / (F.length("seq") - g.k + 1)
    b = bubble_groups(g, 2, 3)
    if estimates is not None:
        b, depth = b.join(estimates.select(A, "node_id", "coverage"), [A, "node_id"], "left"), F.coalesce("coverage", depth)
    b = b.withColumn("depth", depth).withColumn("rank", F.row_number().over(Window.partitionBy(A, "h", "t").orderBy(F.desc("depth"), "seq", "node_id")))
    best = b.where("rank = 1").select(A, "h", "t", F.col("node_id").alias("best"), F.col("seq").alias("best_seq"), F.col("depth").alias("best_depth"))
    x = b.where("rank > 1").join(best, [A, "h", "t"])
    ok = (F.abs(F.length("seq") - F.length("best_seq")) <= max_length_difference) & (F.col("best_depth") >= multiplier * F.col("depth")) & (run_difference(F.col("seq"), F.col("best_seq")) <= limit)
    return merge_into(g, x.where(ok))


def collapse_two_level_indels(g: Graph, multiplier: float, homopolymer: int = 7, max_length_difference: int = 10) -> Graph:
    """A node that ends in a long homopolymer with two tails, whose tails meet in the same two nodes, pair by pair."""
    start = g.nodes.where(S.end_homopolymer("seq") > homopolymer).select(A, F.col("node_id").alias("root"))
    d = degrees(g).select(A, "node_id", "heads", "tails", "seq", "cnt")
    two = d.where("tails = 2").select(A, F.col("node_id").alias("root")).join(start, [A, "root"], "left_semi")
    e = g.edges.select(A, "src", "dst")
    first = e.withColumnRenamed("src", "root").join(two, [A, "root"], "left_semi").join(d.where("heads = 1 AND tails = 2").withColumnRenamed("node_id", "dst"), [A, "dst"]).select(A, "root", F.col("dst").alias("n"), "seq", "cnt")
    second = e.toDF(A, "n", "m").join(d.where("heads = 1 AND tails = 1").select(A, F.col("node_id").alias("m"), F.col("seq").alias("mseq"), F.col("cnt").alias("mcnt")), [A, "m"]).join(e.toDF(A, "m", "meet"), [A, "m"])
    x, y = first.toDF(A, "root", "n", "seq", "cnt"), first.toDF(A, "root", "n2", "seq2", "cnt2")
    pair = x.join(y, [A, "root"]).where("cnt > cnt2 OR (cnt = cnt2 AND n < n2)")
    good = (F.abs(F.length("seq") - F.length("seq2")) <= max_length_difference) & (F.col("cnt") >= multiplier * F.col("cnt2")) & run_difference(F.col("seq"), F.col("seq2")).isNotNull()
    lower = second.select(A, F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("mseq").alias("mseq2"), F.col("mcnt").alias("mcnt2"), "meet")
    legs = pair.where(good).join(second, [A, "n"]).join(lower, [A, "n2", "meet"])
    leg_ok = (F.abs(F.length("mseq") - F.length("mseq2")) <= max_length_difference) & (F.col("mcnt") >= multiplier * F.col("mcnt2")) & run_difference(F.col("mseq"), F.col("mseq2")).isNotNull()
    full = legs.where(leg_ok).groupBy(A, "root", "n", "n2").agg(F.countDistinct("meet").alias("meets"), F.collect_set(F.struct(F.col("m2").alias("node_id"), F.col("m").alias("best"))).alias("legs")).where("meets = 2")
    one = full.withColumn("r", F.row_number().over(Window.partitionBy(A, "root").orderBy("n", "n2"))).where("r = 1")
    moves = one.select(A, F.explode(F.array_append("legs", F.struct(F.col("n2").alias("node_id"), F.col("n").alias("best")))).alias("x")).select(A, "x.node_id", "x.best")
    return merge_into(g, moves)


# --- splitting and trimming -------------------------------------------------------


def _exclusive(side: DataFrame) -> DataFrame:
    """Rows of (node_id, other, read) whose read is on one of the node's edges only."""
    once = side.groupBy(A, "node_id", "read").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return side.join(once, [A, "node_id", "read"], "left_semi")


def _split(g: Graph, chosen: DataFrame, tails: bool, heads: bool, drop: bool = True) -> Graph:
    """A copy of every chosen node for each of its tail edges and/or head edges, with exclusive reads."""
    nodes, edges, er, nr = [], [], [], []
    for on, end, other in ((tails, "src", "dst"), (heads, "dst", "src")):
        if not on:
            continue
        e = g.edges.withColumnRenamed(end, "node_id").join(chosen, [A, "node_id"], "left_semi").withColumn("new", F.xxhash64("node_id", other, F.lit(end)))
        nodes.append(e.join(g.nodes.select(A, "node_id", "seq"), [A, "node_id"]).select(A, F.col("new").alias("node_id"), "seq", "cnt"))
        edges.append(e.select(A, F.col("new").alias(end), other, "cnt").select(A, "src", "dst", "cnt"))
        reads = _exclusive(g.edge_reads.withColumnRenamed(end, "node_id").join(chosen, [A, "node_id"], "left_semi").withColumnRenamed(other, "other"))
        reads = reads.withColumnRenamed("other", other).withColumn("new", F.xxhash64("node_id", other, F.lit(end)))
        er.append(reads.select(A, F.col("new").alias(end), other, "read").select(A, "src", "dst", "read"))
        nr.append(reads.select(A, F.col("new").alias("node_id"), "read"))

    def joined(base, parts):
        for p in parts:
            base = base.unionByName(p)
        return base

    kept = keep_nodes(g, g.nodes.join(chosen, [A, "node_id"], "left_anti"))
    out = Graph(joined(kept.nodes, nodes), joined(kept.edges, edges), joined(kept.node_reads, nr), joined(kept.edge_reads, er), g.k)
    # an edge between two split nodes has lost its other end
    return keep_nodes(out, out.nodes)


def split_ends(g: Graph, max_length: int | None = None) -> Graph:
    """End nodes with several edges: one copy an edge."""
    d = degrees(g).where("(headless AND tails > 1) OR (tailless AND heads > 1)")
    if max_length is not None:
        d = d.where(F.length("seq") <= max_length)
    return _split(g, d.select(A, "node_id"), True, True)


def split_multitailed(g: Graph) -> Graph:
    """A node with several tails: one copy a tail and one copy a head; paths stop there."""
    return _split(g, degrees(g).where("tails > 1").select(A, "node_id"), True, True)


def remove_low_entropy_ends(g: Graph, bits: float = 1.5) -> Graph:
    """End nodes of low dinucleotide entropy go."""
    bad = degrees(g).where("headless OR tailless").where(S.kmer_entropy("seq", 2) < bits)
    return keep_nodes(g, g.nodes.join(bad, [A, "node_id"], "left_anti"))


def trim_low_entropy_ends(g: Graph, window: int, step: int, bits: float) -> Graph:
    """Low-entropy stretches come off the open ends; a node shorter than k afterwards goes."""
    d = degrees(g).select(A, "node_id", "headless", "tailless")
    x = g.nodes.join(d, [A, "node_id"]).withColumn("b", S.entropy_bounds("seq", window, step, bits, 2))
    a = F.when(F.col("headless"), F.col("b.start")).otherwise(F.lit(0))
    z = F.when(F.col("tailless"), F.col("b.end")).otherwise(F.length("seq"))
    cut = x.select(A, "node_id", F.when(F.col("headless") | F.col("tailless"), S.piece("seq", a, F.greatest(z - a, F.lit(0)))).otherwise(F.col("seq")).alias("seq"), "cnt")
    return keep_nodes(g.with_(nodes=cut), cut.where(F.length("seq") >= g.k))


def strongest_edges(g: Graph) -> Graph:
    """At each fork only the best supported edges stay (ties all), by source and then by target."""
    n = g.edges.join(g.edge_reads.groupBy(A, "src", "dst").agg(F.count("*").alias("reads")), [A, "src", "dst"], "left").withColumn("reads", F.coalesce("reads", F.lit(0)))
    for end in ("src", "dst"):
        best = n.groupBy(A, end).agg(F.max("reads").alias("best"))
        n = n.join(best, [A, end]).where("reads = best").drop("best")
    return keep_edges(g, n)


def components(g: Graph, loop_aware: bool = True) -> DataFrame:
    """nodes with group, the least node id reachable; without ``loop_aware`` pieces without a headless node have none."""
    label = staged(g.nodes.select(A, "node_id", F.col("node_id").alias("group")))
    both = staged(g.edges.select(A, "src", "dst").union(g.edges.select(A, "dst", "src")).toDF(A, "node_id", "other"))
    while True:
        near = both.join(label.toDF(A, "other", "g2"), [A, "other"]).groupBy(A, "node_id").agg(F.min("g2").alias("g2"))
        low = label.join(near, [A, "node_id"], "left").select(A, "node_id", F.least("group", F.coalesce("g2", "group")).alias("g"))
        jump = low.join(low.toDF(A, "g", "g3"), [A, "g"]).select(A, "node_id", F.least("g", "g3").alias("group"))
        new = staged(jump)
        if new.join(label, [A, "node_id", "group"], "left_anti").isEmpty():
            break
        label = new
    out = g.nodes.join(label, [A, "node_id"])
    if loop_aware:
        return out
    open_groups = degrees(g).where("headless").select(A, "node_id").join(label, [A, "node_id"]).select(A, F.col("group").alias("g")).distinct()
    return out.join(open_groups, (out[A] == open_groups[A]) & (out["group"] == open_groups["g"]), "left").select(out[A], "node_id", "seq", "cnt", F.col("g").alias("group"))


# --- contigs and paths ------------------------------------------------------------


def node_sequences(g: Graph, add_neighbours: bool = False) -> DataFrame:
    """Contig of every node; with neighbours, the part of a unique head before it and of a unique tail behind it."""
    d = degrees(g)
    if not add_neighbours:
        return d
    seqs = g.nodes.select(A, "node_id", "seq")
    h = g.edges.groupBy(A, F.col("dst").alias("node_id")).agg(F.count("*").alias("n"), F.min("src").alias("o")).where("n = 1").drop("n").join(seqs.toDF(A, "o", "hs"), [A, "o"]).drop("o")
    t = g.edges.groupBy(A, F.col("src").alias("node_id")).agg(F.count("*").alias("n"), F.min("dst").alias("o")).where("n = 1").drop("n").join(seqs.toDF(A, "o", "ts"), [A, "o"]).drop("o")
    x = d.join(h, [A, "node_id"], "left").join(t, [A, "node_id"], "left")
    front = F.coalesce(F.col("hs").substr(F.lit(1), F.length("hs") - (g.k - 1)), F.lit(""))
    return x.withColumn("seq", F.concat(front, F.col("seq"), F.coalesce(F.col("ts").substr(F.lit(g.k), F.length("ts")), F.lit("")))).drop("hs", "ts")


def drop_contained(contigs: DataFrame, k: int) -> DataFrame:
    """Isolated contigs inside a longer one of the assembly go; candidates share the contained one's first k-mer."""
    short = contigs.where("headless AND tailless").select(A, F.col("node_id").alias("short"), F.col("seq").alias("s"), F.left("seq", F.lit(k)).alias("kmer"))
    long = contigs.select(A, "node_id", "seq", F.explode(F.array_distinct(S.kmers("seq", k))).alias("kmer"))
    inside = short.join(long, [A, "kmer"]).where((F.col("short") != F.col("node_id")) & (F.length("seq") > F.length("s")) & F.contains("seq", "s"))
    return contigs.join(inside.select(A, F.col("short").alias("node_id")).distinct(), [A, "node_id"], "left_anti")


# --- compare graph ----------------------------------------------------------------


def edge_positions(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of threaded contigs with the positions of both k-mers in each contig."""
    ids = nodes.select(A, F.col("seq").alias("kmer"), F.col("node_id").alias("src"))
    x = steps.where("next IS NOT NULL").join(ids, [A, "kmer"]).join(ids.toDF(A, "next", "dst"), [A, "next"])
    return x.select(A, "src", "dst", "read_id", F.col("pos").alias("head_pos"), (F.col("pos") + 1).alias("tail_pos"))


def collapse_same_reads(g: Graph) -> Graph:
    """Single-linked paths collapse only where every read of the next node is on the current one."""
    links = chain_edges(g)
    nxt = links.join(g.node_reads.toDF(A, "dst", "read"), [A, "dst"])
    foreign = nxt.join(g.node_reads.toDF(A, "src", "read"), [A, "src", "read"], "left_anti").select(A, "src", "dst").distinct()
    return contract(g, linked_chains(g.nodes, staged(links.join(foreign, [A, "src", "dst"], "left_anti"))))


def redundant_nodes(g: Graph) -> DataFrame:
    """Nodes that one read enters from several heads and leaves to several tails."""
    def several(end, other):
        x = g.edge_reads.withColumn("r", F.regexp_replace("read", rf"{AGAIN}\d+|_mate", ""))
        return x.groupBy(A, F.col(end).alias("node_id"), "r").agg(F.countDistinct(other).alias(other)).where(f"{other} > 1")

    return several("dst", "src").join(several("src", "dst"), [A, "node_id", "r"]).select(A, "node_id").distinct()


def split_redundant(g: Graph) -> Graph:
    return _split(g, redundant_nodes(g), True, True)


def samples_per_node(g: Graph, sample_of: DataFrame) -> DataFrame:
    """Distinct samples behind every node; ``sample_of``: read, sample."""
    return g.node_reads.join(sample_of, "read").groupBy(A, "node_id").agg(F.countDistinct("sample").alias("samples"))
