"""Steps that a large table of reads needs: pieces by minimizer, reads dealt out before they are cut."""

from collections import Counter

from pyspark.sql import functions as F

from strandworks.operators import kmers as K
from strandworks.operators import reads as R
from strandworks.plans import fixtures as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_kmers_travel_in_pieces_and_counts_stay(spark):
    texts = ["ACGTTGCAACGGATCCATTACGATCGGATTACAGATTACA" * 2, "ACGTTGCAACGGATCCATTACGATCGGATTACA", "N" * 60, "ACGT", "", None, "ÄCGTTGCAACGGATCCATTACGATCGGATTACAÖ"]
    rows = spark.createDataFrame([(s, t) for s in ("x", "y", None) for t in texts + texts[:2]], "sample string, seq string")
    k = 31
    want = Counter((s, t[i : i + k]) for s in ("x", "y", None) for t in texts + texts[:2] if t and len(t) > k for i in range(len(t) - k + 1))
    pieces = K.minimizer_pieces(rows, k, "sample")
    cut = Counter((r.sample, r.piece[i : i + k]) for r in pieces.collect() for i in range(len(r.piece) - k + 1))
    assert cut == want and pieces.count() < sum(want.values())
    got = K.count_kmers(rows, k, "sample")
    assert {(r.sample, r.kmer): r.cnt for r in got.collect()} == dict(want) and got.columns == ["sample", "kmer", "cnt"]
    # k-mers are not dealt out: the last exchange is below the cut
    assert plan(got).index("Generate explode") < plan(got).index("RepartitionByExpression")
    short = K.count_kmers(rows, 12, "sample")
    assert "RepartitionByExpression" not in plan(short) and sum(r.cnt for r in short.collect()) == sum(len(t) - 11 for t in texts + texts[:2] if t and len(t) > 12) * 3


def test_documents_are_dealt_out_before_they_are_cut(spark, tmp_path):
    rows = [(i, "lorem ipsum dolor " * (i % 40), "en", "s") for i in range(60)] + [(7, "twice", "en", "s"), (None, "none", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    r = X.reads(spark, str(tmp_path))
    assert plan(r).index("Generate posexplode") < plan(r).index("RepartitionByExpression")
    kept = spark.createDataFrame(r.collect(), r.schema)
    key = lambda t: sorted(map(str, t.collect()))
    assert key(X.mates(spark, str(tmp_path))) == key(X.mates(spark, str(tmp_path), kept).select(X.mates(spark, str(tmp_path)).columns))


def test_constant_kmers_near_the_ends_only(spark):
    rows = spark.createDataFrame([(1, "AAACCCGGGTTT"), (2, "TTTAAACCCGGG"), (3, "GGG"), (4, "")], "read_id long, seq string")
    bad = spark.createDataFrame([("AAAC",)], "kmer string")
    assert sorted(r.read_id for r in R.drop_constant(rows, bad, 4, 2).collect()) == [2, 3, 4]
    assert sorted(r.read_id for r in R.drop_constant(rows, bad, 4, 4).collect()) == [3, 4]
    assert sorted(r.read_id for r in R.drop_constant(rows, bad.where(F.lit(False)), 4, 4).collect()) == [1, 2, 3, 4]
