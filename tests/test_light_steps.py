"""Islands, loops and bridges without dealing out what they leave alone, against loops over everything."""

import random
from collections import defaultdict

from strandworks.operators import graph as G
from strandworks.operators import kmers as K


def random_graph(spark):
    """Fifteen linked nodes of two assemblies with shared ids, a loop on node 3, and five islands."""
    r, edges, edge_reads, node_reads = random.Random(5), set(), set(), set()
    for a in "xy":
        edges |= {(a, r.randrange(15), r.randrange(15)) for _ in range(40)} | {(a, 3, 3)}
        for e in sorted(x for x in edges if x[0] == a):
            edge_reads |= {(*e, f"r{r.randrange(12)}") for _ in range(4)}
        node_reads |= {(a, n, f"r{r.randrange(12)}") for n in range(20) for _ in range(6)}
    node_reads |= {(a, n, read) for a, s, d, read in edge_reads for n in (s, d)}
    nodes = [(a, n, "ACGT" * (1 + n % 3), 1) for a in "xy" for n in range(20)]
    made = K.Graph(
        spark.createDataFrame(nodes, "assembly_id string, node_id long, seq string, cnt long"), spark.createDataFrame([(*e, 1) for e in sorted(edges)], "assembly_id string, src long, dst long, cnt long"),
        spark.createDataFrame(sorted(node_reads), "assembly_id string, node_id long, read string"), spark.createDataFrame(sorted(edge_reads), "assembly_id string, src long, dst long, read string"), 4)
    return made, nodes, edges, node_reads, edge_reads


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_islands_leave_edges_alone(spark):
    g, nodes, edges, node_reads, _ = random_graph(spark)
    linked = {(a, n) for a, s, d in edges for n in (s, d)}
    gone = {(a, n) for a, n, seq, _ in nodes if (a, n) not in linked and len(seq) <= 8}
    got = G.remove_islands(g, 8)
    assert got.edges is g.edges and got.edge_reads is g.edge_reads and gone
    assert rows(got.nodes) == sorted(x for x in nodes if x[:2] not in gone)
    assert rows(got.node_reads) == sorted(x for x in node_reads if x[:2] not in gone)


def test_loops_are_found_before_the_reads_are_read(spark):
    g, _, edges, _, edge_reads = random_graph(spark)
    loops = {(a, s) for a, s, d in edges if s == d}
    got = G.break_self_loops(g)
    assert rows(got.edges.drop("cnt")) == sorted(x for x in edges if not {(x[0], x[1]), (x[0], x[2])} & loops)
    assert rows(got.edge_reads) == sorted(x for x in edge_reads if not {(x[0], x[1]), (x[0], x[2])} & loops)
    # staged, they have a size that Spark knows: neither reads nor edges are dealt out for them
    assert "Exchange hashpartitioning" not in got.edge_reads._jdf.queryExecution().executedPlan().toString()


def test_bridges_meet_in_one_aggregate(spark):
    g, _, edges, node_reads, edge_reads = random_graph(spark)
    both = {(a, s, d, read) for a, s, d in edges for b, n, read in node_reads if (a, s) == (b, n) and (a, d, read) in node_reads}
    for by_nodes, on in ((False, edge_reads), (True, both)):
        heads, tails, ins, outs, want = (defaultdict(set) for _ in range(5))
        for a, s, d in edges:
            heads[a, d].add(s), tails[a, s].add(d)
        for a, s, d, read in on:
            if s != d:
                ins[a, d, read].add(s), outs[a, s, read].add(d)
        for (a, n, read), h in ins.items():
            t = outs[a, n, read]
            if len(h) == len(t) == 1 and max(len(heads[a, n]), len(tails[a, n])) > 1:
                want[a, n, *h, *t].add(read)
        want = sorted((*k, len(v)) for k, v in want.items() if len(v) > 1)
        assert rows(G.bridges(g, 1, by_nodes)) == want != [], by_nodes
    assert rows(G.reads_of_both(g, g.edges.select(K.A, "src", "dst"))) == sorted(both)


def test_reads_on_nodes_are_dealt_out_by_node(spark):
    links = spark.createDataFrame([("x", 1, 2, "r", False), ("x", 2, 3, "r", False), ("x", 3, 3, "r", True)], "assembly_id string, src long, dst long, read string, inner boolean")
    at = G.reads_on_nodes(links)
    assert rows(at) == [("x", n, "r") for n in (1, 2, 3)]
    joined = at.join(links.select(K.A, "src").toDF(K.A, "node_id").hint("merge"), ["node_id", K.A])
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
