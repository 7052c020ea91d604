"""Tables of k-mers, whose size Spark does not know, are made once and not sent whole to the driver."""

import random

from pyspark.sql import functions as F

from strandworks.functions import sequence as S
from strandworks.operators import contigs as C
from strandworks.operators import kmers as K


def texts(spark, n=40, length=60):
    r = random.Random(7)
    rows = [(i, "x", "".join(r.choices("ACGT", k=length - i % 7)) + "A" * (i % 6) + "CGCG") for i in range(n)]
    return spark.createDataFrame(rows, "read_id long, assembly_id string, seq string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_around_intervals(spark):
    """Against a look at every place of the read; the intervals are a column, so reads are not joined with themselves."""
    t = texts(spark).withColumn("intervals", S.homopolymers("seq", 3))
    got = K.with_tokens(t, 5)
    assert "Join" not in plan(got)
    some = 0
    for x in got.withColumn("iv", S.homopolymers("seq", 3)).collect():
        spans = []
        for s, e in sorted((max(i.start - 4, 0), min(i.end + 4, len(x.seq))) for i in x.iv):
            if spans and s <= spans[-1][1] - 4:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        spans = [(s, e) for s, e in spans if e - s >= 5]
        plain = [(i, x.seq[i : i + 5]) for i in range(len(x.seq) - 4) if not any(s <= i and i + 5 <= e for s, e in spans)]
        assert x.tokens == [k for _, k in sorted(plain + [(s, x.seq[s:e]) for s, e in spans])]
        some += len(spans)
    assert some > 20


def test_counts_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(n):
        made.add(1)
        return n

    counts = spark.range(90).select(F.lit("x").alias("a"), F.col("id").cast("string").alias("kmer"), seen((F.col("id") % 60) * 2).alias("cnt"))
    values = sorted(i % 60 * 2 for i in range(90))
    x = K.count_stats(counts, "a").collect()[0]
    assert made.value == 90
    assert x.mean_all == sum(values) / 90 and x.median_all == (values[44] + values[45]) / 2
    high = [v for v in values if v > x.pivot_count * 0.5]
    assert x.mean_high == sum(high) / len(high) and x.median_high == (high[(len(high) - 1) // 2] + high[len(high) // 2]) / 2


def test_kmers_are_not_broadcast(spark, monkeypatch):
    reads = texts(spark)
    tokens = K.with_tokens(reads.withColumns({"pair_id": F.col("read_id") % 20, "mate": (F.col("read_id") / 20 + 1).cast("int")}), 5)
    assert "BroadcastHashJoin" not in plan(K.mate_tags(K.steps_of(tokens, "pair_id", "mate")))
    kept = []
    monkeypatch.setattr(C, "staged", lambda df: kept.append(df) or df)
    hits = reads.select("read_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side")).select("read_id", F.concat_ws("-", "read_id", "side").alias("contig"), F.lit(2).alias("ties"))
    whole = reads.select(F.concat_ws("-", "read_id", F.lit("a")).alias("contig"), "seq")
    cut = reads.select(F.concat_ws("-", "read_id", F.lit("b")).alias("contig"), F.left("seq", F.length("seq") - 2).alias("seq"))
    got = C.resolve_ties(hits, reads, whole.unionByName(cut), 5)
    assert "BroadcastHashJoin" not in plan(kept[0])
    rows = got.collect()
    assert len({x.read_id for x in rows}) == 40 and sum(x["class"] == "unique" and x.contig == f"{x.read_id}-a" for x in rows) >= 30
    multi = [x for x in rows if x["class"] != "unique"]
    assert all(x["class"] == "multi" for x in multi)
