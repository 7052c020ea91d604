"""Links of reads are counted once; marks go on from what changed only."""

from pyspark.sql import functions as F

from strandworks.operators import graph as G
from strandworks.operators import kmers as K
from strandworks.operators import paths as P


def test_equal_links_are_held_once_with_their_number(spark):
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(["ACGTTGCAAC", "ACGTTGCAAC", "GGATCA"]) for _ in (0, 1)], "read_id long, assembly_id string, seq string")
    tokens, held = K.with_tokens(rows, 5).select("assembly_id", "read_id", "tokens"), []
    g = K.thread_reads(tokens, K.nodes_from_counts(K.count_tokens(tokens, "assembly_id"), 0), 5, hold=lambda df: held.append(df) or df)
    assert held[0].count() == held[0].select("src", "dst", "read").distinct().count() == 11
    assert {r.cnt for r in g.edges.collect()} == {2, 4} and G.collapse(g).edge_reads.count() == 0


def test_marks_spread_to_the_end(spark):
    links = spark.createDataFrame([("s", i, i + 1) for i in range(9)] + [("s", 9, 4)], "assembly_id string, src long, dst long")
    label = spark.createDataFrame([("s", i, {7: 7, 5: 5}.get(i)) for i in range(10)], "assembly_id string, node_id long, mark long")
    got = P._spread(label, links)
    assert got.columns == label.columns and {r.node_id: r.mark for r in got.collect()} == {i: 5 if i > 3 else None for i in range(10)}
