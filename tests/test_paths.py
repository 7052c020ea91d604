"""Breaks by reach, loops, numbered paths and indel bubbles against plain computations."""

import random

from pyspark.sql import functions as F

from strandworks.operators import graph as G
from strandworks.operators import kmers as K
from strandworks.operators import paths as P


def make(spark, nodes, edges, node_reads=(), edge_reads=(), k=5):
    """nodes: (assembly, id, seq, cnt); edges: (assembly, src, dst, cnt)."""
    return K.Graph(
        spark.createDataFrame(list(nodes), "assembly_id string, node_id long, seq string, cnt long"), spark.createDataFrame(list(edges), "assembly_id string, src long, dst long, cnt long"),
        spark.createDataFrame(list(node_reads), "assembly_id string, node_id long, read string"), spark.createDataFrame(list(edge_reads), "assembly_id string, src long, dst long, read string"), k)


def brute_cuts(n, reads, reach, flank):
    """Ranks before which a chain of n nodes is cut; reads: sets of ranks."""
    spans = []
    for r in reads:
        ranks = sorted(r)
        for i, x in enumerate(ranks):
            if i and x == ranks[i - 1] + 1:
                spans[-1][1] = x
            else:
                spans.append([x, x])
    far = int(sum(b - a + 1 for a, b in spans) / len(spans) + 0.5)
    if n - far <= 2:
        return set()
    passing = [sum(a <= p and b >= p + far for a, b in spans) for p in range(n - far)]
    out, p = set(), 0
    while p < len(passing):
        q = p
        while q < len(passing) and passing[q] <= reach:
            q += 1
        if q - p >= 2 and (p == 0 or q == len(passing) or (passing[p - 1] > flank and passing[q] > flank)):
            if p > 0:
                out.add(p + far)
            if q < len(passing):
                out.add(q)
        p = q + 1
    return out


def test_reach_cuts(spark):
    rng = random.Random(4)
    place, on, want = [], [], set()
    for c in range(25):
        n = rng.choice([1, 2, 8, 30, 60])
        place += [("s", c * 1000 + i, c * 1000, i) for i in range(n)]
        reads = []
        for r in range(rng.choice([3, 15, 60])):
            a = rng.randrange(n)
            ranks = set(range(a, min(n, a + rng.randint(1, 9))))
            if rng.random() < 0.2:
                ranks |= {rng.randrange(n)}
            reads.append(ranks)
            on += [("s", c * 1000 + i, f"{c}.{r}") for i in ranks]
        if n > 1:
            want |= {(c * 1000, x) for x in brute_cuts(n, reads, 1, 2)}
    got = P.reach_cuts(spark.createDataFrame(place, "assembly_id string, node_id long, chain long, rank long"), spark.createDataFrame(on, "assembly_id string, node_id long, read string"), 1, 2)
    assert {(r.chain, r.rank) for r in got.collect()} == want and want


def test_break_by_reach_cuts_the_middle(spark):
    nodes = [("s", i, f"{i:05d}", 1) for i in range(40)]
    edges = [("s", i, i + 1, 1) for i in range(39)]
    # reads of 4 and 12 nodes, 8 in the mean; none passes from both sides of 18 and 19
    reads = [(a, f"{a}.{j}", 12 if j % 2 else 4) for a in [*range(0, 15), *range(20, 28)] for j in range(4)]
    on = [("s", a + i, r) for a, r, n in reads for i in range(n)]
    g = P.break_by_reach(make(spark, nodes, edges, on), 1, 1)
    left = {(e.src, e.dst) for e in g.edges.collect()}
    cut = {(i, i + 1) for i in range(39)} - left
    assert cut == {(19, 20), (25, 26)}


def scc(ids, edges):
    reach = {i: {i} for i in ids}
    for _ in ids:
        for s, d in edges:
            for i in ids:
                if s in reach[i]:
                    reach[i].add(d)
    groups = {frozenset(j for j in reach[i] if i in reach[j]) for i in ids}
    return {g for g in groups if len(g) > 1 or any((i, i) in edges for i in g)}


def test_loops(spark):
    rng = random.Random(6)
    nodes, edges, want = [], [], set()
    for a in range(6):
        ids = list(range(12))
        pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(rng.choice([6, 12, 18]))}
        nodes += [(f"a{a}", i, f"{i:05d}", 1) for i in ids]
        edges += [(f"a{a}", s, d, 1) for s, d in pairs]
        want |= {(f"a{a}", g) for g in scc(ids, pairs)}
    got = P.loops(make(spark, nodes, edges)).groupBy("assembly_id", "loop").agg(F.collect_set("node_id").alias("g")).collect()
    assert {(r.assembly_id, frozenset(r.g)) for r in got} == want


def test_only_real_loops_lose_an_entry(spark):
    # s: 1 -> 2 -> 3 -> 2, 3 -> 4: the loop 2, 3 is entered from 1 only.  t: 5 and 6 meet in 7, which lies on no cycle
    nodes = [("s", i, f"{i:05d}", 1) for i in (1, 2, 3, 4)] + [("t", i, f"{i:05d}", 1) for i in (5, 6, 7, 8)]
    edges = [("s", 1, 2, 9), ("s", 2, 3, 5), ("s", 3, 2, 5), ("s", 3, 4, 5), ("t", 5, 7, 1), ("t", 6, 7, 2), ("t", 7, 8, 3)]
    g = make(spark, nodes, edges)
    assert [tuple(r) for r in P.loop_entries(g).collect()] == [("s", 1, 2, 9)]
    done = P.collapse_simple_loops(g, 1)
    assert {(e.src, e.dst) for e in done.edges.where("assembly_id = 't'").collect()} >= {(5, 7), (6, 7)}
    assert done.edges.where("assembly_id = 's' AND src = 1").isEmpty()


def brute_paths(nodes, edges):
    seq = {i: s for _, i, s, _ in nodes}
    tails = {i: sorted((d for _, s, d, _ in edges if s == i), key=lambda d: seq[d]) for i in seq}
    heads = {d for _, _, d, _ in edges}
    out = []

    def walk(p):
        if not tails[p[-1]]:
            out.append(p)
        for d in tails[p[-1]]:
            walk([*p, d])

    for i in sorted(seq, key=seq.get):
        if i not in heads:
            walk([i])
    return out


def test_numbered_paths(spark):
    rng = random.Random(2)
    nodes = [("s", i, "".join(rng.choices("ACGT", k=6)) + f"{i:02d}", 1) for i in range(14)]
    edges = [("s", i, j, 1) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.3]
    g = make(spark, nodes, edges, k=3)
    want = brute_paths(nodes, edges)
    assert len(want) > 40
    seq = {i: s for _, i, s, _ in nodes}
    starts = K.degrees(g).where("headless").select("node_id")
    assert int(P.path_counts(g)[0].join(starts, "node_id").agg(F.sum("paths")).first()[0]) == len(want)
    for lo, hi in ((0, None), (7, 31), (len(want) - 1, len(want) + 50)):
        got = sorted(P.numbered_paths(g, lo, hi).collect(), key=lambda r: r.number)
        assert [(r.number, [p.node_id for p in r.places]) for r in got] == list(enumerate(want))[lo:hi]
        for r in got:
            assert r.seq == seq[r.places[0].node_id] + "".join(seq[p.node_id][2:] for p in r.places[1:]) and r.places[-1].end == len(r.seq)


def test_very_many_paths_are_counted_and_chosen(spark):
    # 30 bubbles in a row: 2^30 paths
    nodes, edges = [("s", 0, "AAAAA", 1)], []
    for b in range(30):
        nodes += [("s", 3 * b + 1, f"C{b:04d}", 1), ("s", 3 * b + 2, f"G{b:04d}", 1), ("s", 3 * b + 3, f"T{b:04d}", 1)]
        edges += [("s", 3 * b, 3 * b + 1, 1), ("s", 3 * b, 3 * b + 2, 1), ("s", 3 * b + 1, 3 * b + 3, 1), ("s", 3 * b + 2, 3 * b + 3, 1)]
    # levels are joined one at a time: six bubbles are enough for the rows
    few = make(spark, nodes[:19], edges[:24])
    assert sorted(r.number for r in P.numbered_paths(few, 60, 999).collect()) == [60, 61, 62, 63]


def test_indels_are_ranked_by_coverage(spark):
    # the longer node has the higher sum and the lower coverage
    k, run = 5, "A"
    short, long = "CGTCA" + run * 7 + "GTCAG", "CGTCA" + run * 16 + "GTCAG"
    nodes = [("s", 1, "TTTTCGTC", 50), ("s", 2, short, 120), ("s", 3, long, 130), ("s", 4, "TCAGTTTT", 50)]
    edges = [("s", 1, 2, 5), ("s", 1, 3, 5), ("s", 2, 4, 5), ("s", 3, 4, 5)]
    g = make(spark, nodes, edges, k=k)
    done = G.collapse_indels(g, 1.2, 20)
    assert {r.node_id for r in done.nodes.collect()} == {1, 2, 4} and done.nodes.where("node_id = 2").first().cnt == 250
    other = spark.createDataFrame([("s", 2, 3.0), ("s", 3, 30.0)], "assembly_id string, node_id long, coverage double")
    done = G.collapse_indels(g, 1.2, 20, other)
    assert {r.node_id for r in done.nodes.collect()} == {1, 3, 4}


def test_two_level_indels(spark):
    run = "A" * 9
    nodes = [("s", 0, "CG" + run, 40), ("s", 1, "AAAAGC", 30), ("s", 2, "AAAAAGC", 10)]
    nodes += [("s", 3, "AAGCT", 20), ("s", 4, "AAGCC", 10), ("s", 5, "AAGCTT", 6), ("s", 6, "AAGCCC", 4), ("s", 7, "GCTGA", 20), ("s", 8, "GCCGA", 12)]
    edges = [("s", 0, 1, 9), ("s", 0, 2, 3), ("s", 1, 3, 6), ("s", 1, 4, 3), ("s", 2, 5, 2), ("s", 2, 6, 1), ("s", 3, 7, 6), ("s", 4, 8, 3), ("s", 5, 7, 2), ("s", 6, 8, 1)]
    done = G.collapse_two_level_indels(make(spark, nodes, edges, k=4), 1.5)
    assert {(r.node_id, r.cnt) for r in done.nodes.collect()} == {(0, 40), (1, 40), (3, 26), (4, 14), (7, 20), (8, 12)}
    assert {(e.src, e.dst, e.cnt) for e in done.edges.collect()} == {(0, 1, 12), (1, 3, 8), (1, 4, 4), (3, 7, 8), (4, 8, 4)}


def test_same_reads_guard_the_collapse(spark):
    nodes = [("s", i, s, 1) for i, s in enumerate(["AACCG", "ACCGT", "CCGTT"])]
    edges = [("s", 0, 1, 1), ("s", 1, 2, 1)]
    on = [("s", 0, "x"), ("s", 0, "y"), ("s", 1, "x"), ("s", 2, "x"), ("s", 2, "z")]
    g = G.collapse_same_reads(make(spark, nodes, edges, on))
    assert sorted(r.seq for r in g.nodes.collect()) == ["AACCGT", "CCGTT"]
