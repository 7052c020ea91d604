"""The collapsed graph made from edges first, and loops found around one node of an assembly."""

import random

from pyspark.sql import functions as F

from strandworks.operators import graph as G
from strandworks.operators import kmers as K
from strandworks.operators import paths as P
from strandworks.plans import fixtures as X
from tests.test_paths import make, scc


def test_reads_on_collapsed_edges_equal_the_collapsed_graph(spark):
    r = random.Random(3)
    base = ["".join(r.choices("ACGT", k=40)) for _ in range(3)]
    texts = [b[i : i + r.choice([4, 9, 25])] for b in base for i in range(0, 30, 3)] + ["ACGACGACGACGACG", "ACGACGACGACGACG"]
    rows = spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in enumerate(texts)] + [(0, "s0", texts[0])], "read_id long, assembly_id string, seq string")
    tokens = K.with_tokens(rows, 5).select("assembly_id", "read_id", "tokens")
    nodes = K.nodes_from_counts(K.count_tokens(tokens, "assembly_id"), 1)
    want = G.collapse(K.thread_reads(tokens, nodes, 5))
    n, e, placed = G.collapsed_shape(nodes, K.token_edges(tokens, nodes), 5)
    links = G.collapsed_links(tokens, placed)
    got = {"nodes": n, "edges": e, "edge_reads": links.where("NOT inner").drop("inner"), "node_reads": G.reads_on_nodes(links)}
    for name, t in got.items():
        other = getattr(want, name)
        assert sorted(map(tuple, t.select(other.columns).collect())) == sorted(map(tuple, other.collect())) != [], name


def test_loops_around_one_node(spark, monkeypatch):
    spread = []
    monkeypatch.setattr(P, "_spread", lambda *a, f=P._spread: spread.append(1) or f(*a))
    # a ring with a chord, entered from one ring and left to another, of more steps than one walk
    pairs = [(i, (i + 1) % 9) for i in range(9)] + [(2, 6), (4, 2), (20, 21), (21, 20), (20, 0), (3, 30), (30, 31), (31, 32), (32, 30)]
    ids = sorted({x for p in pairs for x in p})
    got = P.loops(make(spark, [("s", i, f"{i:05d}", 1) for i in ids], [("s", s, d, 1) for s, d in pairs]))
    groups = got.groupBy("loop").agg(F.collect_set("node_id").alias("g")).collect()
    assert {frozenset(r.g) for r in groups} == scc(ids, set(pairs)) and len(groups) == 3
    assert len(spread) == 2  # the largest group is found without marks; the two others in one round


def test_turns_are_dealt_out_before_they_are_cut(spark, tmp_path):
    rows = [(i, 1, "user", f"abcdefgh {i}") for i in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    at = X.chats(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(at) == 4 and sum(r["count"] for r in at) == 200
