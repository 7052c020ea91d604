"""Haplotypes by place (country, site)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .population import reject
from .staging import staged

P = ["country", "site"]


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rank from 0 over all rows: rows are sorted by ranges, and the sizes of the ranges before give each its offset."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", (F.col("_before") + place).cast("int")).drop("_part", "_before", "_at")


def collapse_haplotypes(seqs: DataFrame, refs: DataFrame, prefix: str = "hap") -> DataFrame:
    """Distinct sequences with count, fraction and name: the reference's, else prefix.NN by rank."""
    n = staged(seqs.groupBy("seq").agg(F.count("*").alias("cnt")))
    total = n.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("t"), (F.count("*") - 1).alias("last"))  # one row
    x = ranked(n, F.desc("cnt"), "seq").join(refs.groupBy("seq").agg(F.min("name").alias("ref")), "seq", "left")
    x = x.join(F.broadcast(total)).withColumn("fraction", F.col("cnt") / F.col("t"))
    width = F.greatest(F.length(F.col("last").cast("string")), F.lit(2))
    return x.withColumn("name", F.coalesce("ref", F.concat(F.lit(prefix + "."), F.lpad(F.col("rank").cast("string"), width, "0")))).select("seq", "name", "cnt", "fraction", "rank")


def add_unseen_references(collapsed: DataFrame, refs: DataFrame) -> DataFrame:
    fresh = refs.join(collapsed, "seq", "left_anti").select("seq", "name", F.lit(0).cast("long").alias("cnt"), F.lit(0.0).alias("fraction"))
    return collapsed.select("seq", "name", "cnt", "fraction").unionByName(fresh)


def alternative_names(collapsed: DataFrame, alternatives: DataFrame) -> DataFrame:
    alt = alternatives.groupBy("seq").agg(F.min("name").alias("_alt"))
    return collapsed.join(alt, "seq", "left").withColumn("alternative", F.coalesce("_alt", "name")).drop("_alt")


def count_locations(rows: DataFrame) -> DataFrame:
    """Counts by haplotype, country and site; a missing site is 'na'."""
    return rows.groupBy("haplotype", "country", F.coalesce("site", F.lit("na")).alias("site")).agg(F.sum("cnt").alias("cnt"))


def country_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*P).agg(F.sum("cnt").alias("cnt")).orderBy(*P)


def fraction_within(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    sums = counts.groupBy(*by).agg(F.sum("cnt").alias("_s"))
    return counts.join(sums, by).withColumn(name, F.col("cnt") / F.col("_s")).drop("_s")


def counts_in_countries(counts: DataFrame) -> DataFrame:
    """Fractions within each site."""
    return fraction_within(counts, P, "frac")


def counts_of_haplotypes(counts: DataFrame) -> DataFrame:
    """Fractions within each haplotype."""
    return fraction_within(counts, ["haplotype"], "frac")


def normal_name(c) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def site_table(places: DataFrame, gps: DataFrame) -> DataFrame:
    """Sites with coordinates, names normalised; na-na is left out, and unknown sites are an error."""
    a = places.select(normal_name("country").alias("country"), normal_name("site").alias("site")).distinct().where("NOT (country = 'na' AND site = 'na')")
    b = gps.select(normal_name("country").alias("country"), normal_name("site").alias("site"), "latitude", "longitude")
    reject(a.join(b, P, "left_anti"), "sites without coordinates")
    return a.join(b, P)


def site_proportions(sites: DataFrame, in_countries: DataFrame) -> DataFrame:
    """Each site with its haplotypes and their proportions as one text in name order."""
    parts = in_countries.groupBy(normal_name("country").alias("country"), normal_name("site").alias("site")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("haplotype", "frac"))), lambda x: F.concat(x.haplotype, F.lit("="), F.round(x.frac, 4).cast("string"))), ",").alias("haplotypes"))
    return sites.join(parts, P, "left")


def scale(rows: DataFrame, value: Column, low: float, high: float, name: str) -> DataFrame:
    """value mapped linearly from its range over all rows to low .. high (low where all are equal)."""
    r = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = rows.join(F.broadcast(r))
    width = F.col("_hi") - F.col("_lo")
    return x.withColumn(name, F.when(width > 0, F.lit(low) + (value - F.col("_lo")) / width * (high - low)).otherwise(F.lit(low))).drop("_lo", "_hi")


def country_pieces(counts: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """Count and fraction of each haplotype by country; unseen haplotypes get 'none'."""
    per = counts.groupBy("haplotype", "country").agg(F.sum("cnt").alias("cnt"))
    x = fraction_within(per, ["haplotype"], "frac")
    return haplotypes.select("haplotype").distinct().join(x, "haplotype", "left").select(
        "haplotype", F.coalesce("country", F.lit("none")).alias("country"), F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("frac", F.lit(0.0)).alias("frac"))


def names_by_country(places: DataFrame) -> DataFrame:
    return places.groupBy("country").agg(F.array_join(F.array_sort(F.collect_set("site")), ",").alias("sites"))
