"""Mixing sources to target weights by Poisson replication.

Method: a source's mean repetition rate is its target share of the total size
divided by its own size.  Each document inverts the Poisson distribution of that
mean at a uniform number hashed from its id, is exploded into that many copies,
and a hash of id and copy orders all copies globally.  Means above ``CHUNK``
are sums of equal smaller Poisson draws, each with its own hash, which is exact
and keeps exp(-mean) far from underflow.

Documents are never dealt by their source: the rates of the ``FEW`` largest
sources are broadcast, those of any further, smaller sources are joined.  The
hash is uniform, so its leading bits name the partition of the global order and
no pass samples the copies.

Results in edge cases
  * sources are equal by name; a null source is a source of its own.
  * size is characters (at least 1 a row, so null and empty texts have a size).
  * the draw depends on the id alone: rows that repeat an id get equal counts,
    and null ids count as the id ''.
  * sources without a target weight (or with null or negative weight) get mean 0;
    without ``weights`` all sources weigh the same; an empty table gives no rows.
  * other columns pass through; columns named copy or mix_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

CHUNK, TERMS, SEED = 8, 60, "mix"
#: Sources whose rates are sent to every task.
FEW = 100_000


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """Least n whose distribution function exceeds u, for means of at most CHUNK."""
    step = F.struct(F.lit(0).alias("n"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))

    def next_term(s, k):
        p = s.p * mean / k
        return F.when(s.cdf > u, s).otherwise(F.struct(k.cast("int").alias("n"), p.alias("p"), (s.cdf + p).alias("cdf")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), step, next_term, lambda s: s.n)


def rates(docs: DataFrame, weights: DataFrame | None, total: float | None, source_col: str, text_col: str) -> DataFrame:
    """One row a source: mix_source, mean repetition rate and size."""
    size = F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("long")
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(w, sizes.mix_source.eqNullSafe(w.w_source), "left").select("mix_source", "size", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    # one row: the sums over sources
    sums = weighed.agg(F.sum("weight").alias("weights"), F.sum("size").alias("total"))
    goal = F.lit(float(total)) if total is not None else F.col("total").cast("double")
    mean = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * goal / F.col("size")).otherwise(0.0)
    return weighed.join(F.broadcast(sums)).select("mix_source", mean.alias("mean"), "size")


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture: rows of ``docs`` with copy (from 1) and mix_key, in the global order of mix_key.

    ``weights`` (source, weight) are the target shares; ``total`` is the target
    size in characters, by default that of the input.
    """
    docs = docs.drop("copy", "mix_key")
    means, _ = stage(rates(docs, weights, total, source_col, text_col).toDF("_mix_source", "_mix_mean", "_mix_size"), "rates")
    own = F.col(source_col).eqNullSafe(F.col("_mix_source"))
    if means.count() <= FEW:
        known = docs.join(F.broadcast(means.drop("_mix_size")), own)
    else:
        large = F.broadcast(means.orderBy(F.desc("_mix_size"), "_mix_source").limit(FEW).drop("_mix_size"))
        small = means.join(large.select(F.col("_mix_source").alias("_mix_large")), F.col("_mix_source").eqNullSafe(F.col("_mix_large")), "left_anti").drop("_mix_size")
        known = docs.join(large, own).unionByName(docs.join(large, own, "left_anti").join(small, own))
    key, mean = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("_mix_mean")
    chunks = F.greatest(F.ceil(mean / CHUNK), F.lit(1)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), chunks), lambda j: poisson(mean / chunks, uniform(F.concat_ws(":", F.lit(seed), key, j.cast("string")))))
    count = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    copies = known.withColumn("copy", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)))).drop("_mix_source", "_mix_mean")
    mixed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), key, F.col("copy").cast("string"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * parts / (1 << 32)).cast("int")
    placed = mixed.withColumn("_mix_part", place).repartitionById(parts, F.col("_mix_part")).drop("_mix_part")
    return placed.sortWithinPartitions("mix_key", id_col, "copy")


def digest(result: DataFrame) -> DataFrame:
    """The copies with a digest of the text that each one carries after the global shuffle."""
    return result.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "mix_key", F.md5("text").alias("text_md5"))


SQL = f"""
WITH d AS (SELECT doc_id, source, md5(text) AS text_md5, greatest(coalesce(length(text), 0), 1) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
s AS (SELECT source, sum(size) AS size FROM d GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM s) * (SELECT sum(size) FROM s)::DOUBLE / size::DOUBLE AS mean FROM s),
c AS (SELECT d.doc_id, d.source, text_md5, key, mean, greatest(ceil(mean / {CHUNK}), 1)::INT AS chunks FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
u AS (SELECT *, unnest(range(1, chunks + 1)) AS j FROM c),
v AS (SELECT *, mean / chunks AS m, ('0x' || substr(md5('{SEED}:' || key || ':' || j), 1, 13))::BIGINT::DOUBLE / {1 << 52}.0::DOUBLE AS x FROM u),
t AS (SELECT doc_id, source, text_md5, key, list_reduce(range(1, {TERMS} + 1), lambda s, k:
    CASE WHEN s.cdf > x THEN s ELSE {{'n': k, 'p': s.p * m / k, 'cdf': s.cdf + s.p * m / k}} END, {{'n': 0::BIGINT, 'p': exp(-m), 'cdf': exp(-m)}}).n AS n FROM v),
n AS (SELECT doc_id, source, text_md5, key, sum(n)::BIGINT AS n FROM t GROUP BY ALL)
SELECT doc_id, source, copy, md5('{SEED}:order:' || key || ':' || copy) AS mix_key, text_md5 FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
"""
