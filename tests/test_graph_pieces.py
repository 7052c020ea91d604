"""A graph as JSON comes in pieces."""

import json

from strandworks.operators import kmers as K
from strandworks.sources import writers as W


def test_no_row_holds_the_whole_graph(spark, monkeypatch):
    monkeypatch.setattr(W, "PIECE", 10)
    nodes = [(a, n, "ACGT", n) for a in "xy" for n in range(40)]
    edges = [("x", n, (n * 7) % 40, n) for n in range(40)]
    none = spark.createDataFrame([], "assembly_id string, node_id long, read string")
    g = K.Graph(spark.createDataFrame(nodes, "assembly_id string, node_id long, seq string, cnt long"), spark.createDataFrame(edges, "assembly_id string, src long, dst long, cnt long"), none, none, 4)
    rows = [(x.assembly_id, json.loads(x.graph)) for x in W.graph_json(g).collect()]
    assert max(len(p["nodes"]) + len(p["links"]) for _, p in rows) < 40
    assert sorted((a, v["node_id"], v["seq"], v["cnt"]) for a, p in rows for v in p["nodes"]) == nodes
    assert sorted((a, v["source"], v["target"], v["value"]) for a, p in rows for v in p["links"]) == sorted(edges)
