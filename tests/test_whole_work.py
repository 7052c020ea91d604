"""Queries use their whole input."""

import random

from strandworks.plans import graph_queries as Q


def test_contigs_are_compared_whole(spark, tmp_path):
    """Two contigs that begin alike are two."""
    r = random.Random(3)
    head, one, two = ("".join(r.choices("abcd", k=40)) for _ in range(3))
    rows = [(i, 0, "user", head + ("a" + one, "b" + two)[i % 2]) for i in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(x.seq for x in Q.c17_unique_contigs(spark, str(tmp_path)).collect())
    assert got == sorted(x.seq for x in Q.base(spark, str(tmp_path)).nodes.collect()) and len(got) == 3
    assert {len(s) for s in got} == {40, 51}
