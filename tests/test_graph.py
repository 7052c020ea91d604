"""Hand-made graphs with exact results."""

import random

import pytest
from pyspark.sql import functions as F

from strandworks.operators import graph as G
from strandworks.operators import kmers as K
from strandworks.operators import paths as P
from strandworks.plans.assemble import Settings, assemble, build

SCHEMA = "read_id long, sample string, name string, seq string, qual string"
R = random.Random(11)
LINE = "".join(R.choices("ACGT", k=60))


def reads(spark, *groups):
    rows, i = [], 0
    for seq, n in groups:
        for _ in range(n):
            rows.append((i, "s", f"r{i}", seq, "I" * len(seq)))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def graph(spark, *groups, k=15, cutoff=1):
    return build(reads(spark, *groups), Settings(k=k, cutoff=cutoff))


def seqs(g):
    return sorted(r.seq for r in g.nodes.collect())


def test_linear_path_is_one_contig(spark):
    g = G.collapse(graph(spark, (LINE, 5)))
    assert seqs(g) == [LINE] and g.edges.count() == 0
    assert {r.read for r in g.node_reads.collect()} == {str(i) for i in range(5)}


def test_counts_and_degrees(spark):
    g = graph(spark, (LINE, 5))
    assert g.nodes.count() == 46 and {r.cnt for r in g.nodes.collect()} == {5} and {r.cnt for r in g.edges.collect()} == {5}
    s = K.state_counts(g).first()
    assert (s.headless, s.tailless, s.isolated) == (1, 1, 0) and K.broken_edges(g).isEmpty()


def test_bubble_is_disentangled_by_reads(spark):
    other = LINE[:30] + {"A": "C", "C": "G", "G": "T", "T": "A"}[LINE[30]] + LINE[31:]
    g = G.collapse(graph(spark, (LINE, 10), (other, 8)))
    assert len(seqs(g)) == 4
    # the fork is at ends of the graph, where nothing passes through: ends are split by their reads
    assert seqs(G.collapse(G.split_ends(g))) == sorted([LINE, other])


def test_inner_fork_is_disentangled_by_reads(spark):
    tail, tail2 = ("".join(R.choices("ACGT", k=30)) for _ in range(2))
    head, head2 = ("".join(R.choices("ACGT", k=30)) for _ in range(2))
    a, b = head + LINE[:25] + tail, head2 + LINE[:25] + tail2
    g = G.collapse(graph(spark, (a, 10), (b, 8)))
    assert len(seqs(g)) == 5
    g, n = G.disentangle(g, 2)
    assert n.count() == 1 and seqs(G.collapse(g)) == sorted([a, b])


def test_far_variants_are_not_joined(spark):
    a, b = LINE, LINE[:5] + "ACGT"[("ACGT".index(LINE[5]) + 1) % 4] + LINE[6:55] + "ACGT"[("ACGT".index(LINE[55]) + 1) % 4] + LINE[56:]
    parts = [(x[i : i + 30], 6) for x in (a, b) for i in range(0, 31, 2)]
    g = G.collapse(graph(spark, *parts))
    g2, n = G.disentangle(g, 2)
    assert n.isEmpty()


def test_tip_goes(spark):
    wrong = LINE[:40] + "ACGT"[("ACGT".index(LINE[40]) + 1) % 4]
    g = G.collapse(graph(spark, (LINE, 20), (wrong, 2)))
    assert len(seqs(g)) == 3
    g = G.collapse(G.remove_tips(g, 10, 5))
    assert seqs(g) == [LINE]


def test_indel_bubble(spark):
    a, b = LINE[:30] + "C" + "A" * 7 + "G" + LINE[30:], LINE[:30] + "C" + "A" * 8 + "G" + LINE[30:]
    g = G.collapse(graph(spark, (a, 20), (b, 3)))
    done = G.collapse(G.collapse_indels(g, 2.0))
    assert seqs(done) == [a]
    assert sum(r.cnt for r in done.nodes.collect()) >= sum(r.cnt for r in g.nodes.collect()) - 1


def test_bubble_with_error(spark):
    other = LINE[:30] + "ACGT"[("ACGT".index(LINE[30]) + 1) % 4] + LINE[31:]
    g = G.collapse(graph(spark, (LINE, 20), (other, 3)))
    assert seqs(G.collapse(G.collapse_bubbles(g, 1, 2.0))) == [LINE]
    assert len(seqs(G.collapse(G.collapse_bubbles(g, 1, 20.0)))) == 4


def test_cycle_is_cut_at_its_least_sequence(spark):
    unit = "ACGGTCATTGCA"
    g = graph(spark, (unit * 3, 4), k=8)
    assert K.degrees(g).where("headless OR tailless").isEmpty()
    c = G.collapse(g)
    assert c.nodes.count() == 1 and G.self_loops(c).count() == 1 and len(c.nodes.first().seq) == len(unit) + 7
    assert c.nodes.first().seq.startswith(min((unit * 2)[i : i + 8] for i in range(len(unit))))
    assert G.break_self_loops(c).edges.count() == 0
    assert G.components(g).select("group").distinct().count() == 1
    assert G.components(g, loop_aware=False).where("group IS NOT NULL").isEmpty()


def test_components_and_paths(spark):
    other = "".join(R.choices("ACGT", k=50))
    g = G.collapse(graph(spark, (LINE, 4), (other, 4)))
    assert G.components(g).select("group").distinct().count() == 2
    bub = G.collapse(graph(spark, (LINE, 10), (LINE[:30] + "ACGT"[("ACGT".index(LINE[30]) + 1) % 4] + LINE[31:], 8)))
    paths = P.numbered_paths(bub).collect()
    assert len(paths) == 2 and LINE in {p.seq for p in paths} and all(p.places[-1].end == len(p.seq) for p in paths)


def test_split_ends_and_forks(spark):
    a, b = LINE, LINE[:40] + "".join(R.choices("ACGT", k=20))
    g = G.collapse(graph(spark, (a, 6), (b, 5)))
    stem = max(seqs(g), key=len)
    split = G.collapse(G.split_ends(g))
    assert sorted(split.nodes.agg(F.count("*")).first()) == [2] and {len(s) for s in seqs(split)} == {60}
    assert len(stem) < 60
    strong = G.strongest_edges(g)
    assert strong.edges.count() == 1


def test_mate_tags(spark):
    rows = [("s", 1, 1, 1, [LINE[i : i + 15] for i in range(20)]), ("s", 2, 1, 2, [LINE[i : i + 15] for i in range(10, 40)])]
    steps = K.mate_tags(K.steps_of(spark.createDataFrame(rows, "assembly_id string, read_id long, pair_id long, mate int, tokens array<string>"), "pair_id", "mate")).collect()
    tags = {(r.mate, r.pos): r.read for r in steps}
    assert tags[1, 0] == "1" and tags[2, 0] == "2_mate" and tags[2, 25] == "2"


def test_repeated_kmers_get_their_own_tag(spark):
    g = K.steps_of(spark.createDataFrame([("s", 7, ["a", "b", "a", "b", "c"])], "assembly_id string, read_id long, tokens array<string>")).orderBy("pos").collect()
    assert [r.read for r in g] == ["7", "7", "7#again1", "7#again1", "7"]


def test_recovery_of_known_haplotypes(spark):
    base = "".join(R.choices("ACGT", k=150))
    haps = {base: 12, base[:70] + "ACGT"[("ACGT".index(base[70]) + 1) % 4] + base[71:]: 9}
    groups = [(h[i : i + 100], n) for h, n in haps.items() for i in range(0, 51, 5)]
    rows = reads(spark, *groups)
    rows = rows.withColumn("seq", F.col("seq"))
    s = Settings(k=21, cutoff=2, tip=5)
    # reads are copies, so filtering would leave one of each
    from strandworks.plans.assemble import simplify

    g = simplify(build(rows, s), s)
    assert set(seqs(g)) == set(haps)


def test_assemble_has_fractions(spark):
    out = assemble(reads(spark, *[(LINE[i : i + 40], 1) for i in range(21)]), Settings(k=15, cutoff=1)).collect()
    assert [r.seq for r in out] and abs(sum(r.fraction for r in out) - 1) < 1e-9


def test_graph_is_independent_of_partitions(spark):
    groups = [(LINE, 10), (LINE[:30] + "ACGT"[("ACGT".index(LINE[30]) + 1) % 4] + LINE[31:], 8)]
    a = build(reads(spark, *groups), Settings(k=15, cutoff=1))
    b = build(reads(spark, *groups).orderBy(F.desc("read_id")).repartition(7), Settings(k=15, cutoff=1))
    assert sorted(map(tuple, a.edges.collect())) == sorted(map(tuple, b.edges.collect()))
