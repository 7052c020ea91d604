"""Tandems with units longer than a dozen bases."""

from pyspark.sql import functions as F

from strandworks.operators import reads as R
from strandworks.plans import queries

UNIT = "ACGTTGCAAGTCCATGA"


def test_long_units_are_found_and_located(spark):
    reads = spark.createDataFrame([("a", "GG" + UNIT * 3 + "CC"), ("b", "CACACACACACA"), ("c", ""), ("d", "A")], "read_id string, seq string")
    found = {(x.read_id, x.unit, x.start, x.size) for x in R.tandem_candidates(reads, 5).collect()}
    assert ("a", UNIT, 2, 51) in found and ("b", "CA", 0, 12) in found
    units = spark.createDataFrame([(UNIT,), ("CA",)], "unit string")
    got = {(x.read_id, x.unit, x.start, x.end, x.repeats) for x in R.locate_tandems(reads, units, 2, 8).collect()}
    assert got == {("a", UNIT, 2, 53, 3), ("b", "CA", 0, 12, 6)}


def test_queries_set_no_bound(spark, monkeypatch):
    refs = spark.createDataFrame([("a", "GG" + UNIT * 3 + "CC")], "id string, seq string")
    monkeypatch.setattr(queries.X, "references", lambda s, d: refs)
    assert UNIT in {x.unit for x in queries.b17_tandem_candidates(spark, "").select(F.col("unit")).collect()}
