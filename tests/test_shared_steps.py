"""Steps that many queries share: no row is dealt anew that a step leaves as it is, and nothing is worked out twice."""

import re

from pyspark.sql import functions as F

from strandworks.functions import sequence as S
from strandworks.operators import contigs as C
from strandworks.operators import graph as G
from strandworks.operators import kmers as K
from strandworks.operators import reads as R
from strandworks.operators import regions as I


def tokens(spark, *texts, k=5):
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "read_id long, assembly_id string, seq string")
    return K.with_tokens(rows, k).select("assembly_id", "read_id", "tokens")


def test_links_are_kept_once_and_chains_hold_linked_nodes_only(spark):
    t, held = tokens(spark, "ACGTTGCAAC", "ACGTTGCAAC", "CCCCCCC", "CCCCCCC", "GGATC", "GGATCA", "GGATCA"), []
    nodes = K.nodes_from_counts(K.count_tokens(t, "assembly_id"), 0)

    def hold(df):
        held.append(df)
        return df

    g = K.thread_reads(t, nodes, 5, hold=hold)
    assert len(held) == 1
    names = {r.node_id: r.seq for r in g.nodes.collect()}
    edges = {(names[r.src], names[r.dst], r.cnt) for r in g.edges.collect()}
    assert ("CCCCC", "CCCCC", 4) in edges and ("GGATC", "GATCA", 2) in edges
    loops = g.edge_reads.where("src = dst").select("read").collect()
    # a step that repeats the one before in its read has a tag of its own
    assert sorted(r.read for r in loops) == ["2", "2#again1", "3", "3#again1"]
    linked = G.linked_chains(g.nodes, G.chain_edges(g))
    assert "CCCCC" not in {names[r.node_id] for r in linked.collect()}
    assert G.chains(g.nodes, G.chain_edges(g)).count() == g.nodes.count() > linked.count()
    c = G.collapse(g)
    assert sorted(r.seq for r in c.nodes.collect()) == ["ACGTTGCAAC", "CCCCC", "GGATCA"]
    assert {r.cnt for r in c.edges.collect()} == {4} and c.edge_reads.count() == 4
    assert c.node_reads.groupBy("node_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] == 4


def test_kmers_of_single_and_longer_characters(spark):
    rows = spark.createDataFrame([("ACGTA",), ("ÄBCÖE",), ("AC",), ("",), (None,)], "s string")
    got = [r[0] for r in rows.select(S.kmers("s", 4)).collect()]
    assert got == [["ACGT", "CGTA"], ["ÄBCÖ", "BCÖE"], [], [], []]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_makes_no_row_for_a_base(spark):
    rows = [("a", 0, 100, 1.0), ("a", 10, 60, 0.5), ("a", 150, 200, 2.0), ("b", 5, 30, 1.0), ("b", 5, 30, 1.0), ("c", 0, 50, 1.0), ("c", 10, 20, 1.0), ("c", 30, 70, 1.0)]
    got = C.contig_coverage(spark.createDataFrame(rows, "contig string, start long, end long, weight double"))
    assert "Generate" not in plan(got) and "explode" not in plan(got)
    for r in got.collect():
        depth = {}
        for c, start, end, w in rows:
            for p in range(start, end) if c == r.contig else ():
                depth[p] = depth.get(p, 0) + w
        ends = (min(depth), max(depth)) if len(depth) <= 60 else (min(depth) + 25, max(depth) - 25)
        inner = [v for p, v in depth.items() if ends[0] <= p <= ends[1]]
        assert r.positions == len(depth) and abs(r.coverage - sum(inner) / len(inner)) < 1e-9


def test_spanning_reads_send_each_hit_once(spark):
    a = spark.createDataFrame([("x", 1, "A", 0, 15, False), ("x", 2, "A", 10, 40, True), ("y", 1, "A", 0, 15, False), ("y", 2, "A", 10, 40, False), ("z", 1, "A", 0, 50, False)], "name string, mate int, chrom string, pos long, end_pos long, is_reverse boolean")
    got = I.spanning_reads(a, spark.createDataFrame([(1, "A", 5, 35)], "uid long, chrom string, start long, end long"))
    assert "Expand" not in plan(got)
    assert [(r.reads, r.spanning) for r in got.collect()] == [(3, 2)]


def test_mates_are_bound_once_and_no_sample_is_lost(spark):
    p = spark.createDataFrame([("ACGTACGTTT", "GGGAAACGTA", None), ("ACGT", "TTTT", "s"), ("AC", "GT", "s")], "seq1 string, seq2 string, sample string")
    st = R.stitch(p.withColumn("seq2", S.reverse_complement("seq2")), 3)
    assert [(r.overlap, r.status, r.stitched) for r in st.collect()] == [(7, "r1_ends_in_r2", "ACGTACGTTTCCC"), (None, "none", None), (None, "none", None)]
    got = {r.sample: (r.n, r.long) for r in R.filter_tests(p, {"long": F.length("seq1") > 3}).collect()}
    assert got == {None: (1, 1), "s": (2, 1)}


def test_quality_and_long_runs_by_brute_force(spark):
    rows = [("5!5I!!", "AAAACCGTTTTTT"), ("!!!!", "ACGT"), ("", ""), ("I", "GGGG"), ("!I!", "CAAAAAG")]
    x = spark.createDataFrame(rows, "q string, s string").select("q", "s", S.quality_bounds("q", 20).alias("b"), S.quality_fraction("q", 20).alias("f"), S.homopolymers("s", 4).alias("h"))
    for r in x.collect():
        good = [i for i, c in enumerate(r.q) if ord(c) - 33 >= 20]
        assert (r.b.start, r.b.end) == ((good[0], good[-1] + 1) if good else (0, 0)) and r.f == (len(good) / len(r.q) if r.q else 0)
        assert [(h.start, h.end) for h in r.h] == [m.span() for m in re.finditer(r"(.)\1{3,}", r.s)]
