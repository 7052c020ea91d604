"""Gathering of haplotypes over samples, and population filters.

Table: target, sample, seq, cnt and optionally frac, replicate, meta (map).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import staged

T = ["target", "sample"]


def reject(bad: DataFrame, message: str) -> None:
    """An error that shows a few of the offending rows, if there are any."""
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {rows}")


def stack(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Rows of tables with identical headers."""
    out = first
    for t in rest:
        if t.columns != first.columns:
            raise ValueError(f"headers differ: {t.columns} and {first.columns}")
        out = out.unionByName(t)
    return out


def merge_results(tables: list[DataFrame], regions: DataFrame) -> DataFrame:
    """Result sets limited to regions; a region given twice and rows of several samples a region are errors."""
    at = ["chrom", "start", "end"]
    reject(regions.groupBy(*at).count().where("count > 1"), "regions given twice")
    rows = stack(*tables).join(regions.select(*at), at, "left_semi")
    reject(rows.groupBy(*at).agg(F.countDistinct("sample").alias("n")).where("n > 1"), "regions of several samples")
    return rows


def merged_coi(rows: DataFrame) -> DataFrame:
    """Number of haplotypes of each sample after merging, and how many regions have it."""
    return rows.groupBy("sample", "uniqHaps").agg(F.count("*").alias("regions"))


def gather(haplotypes: DataFrame, targets: DataFrame | None = None, least_length: int = 12) -> DataFrame:
    """Haplotypes of the wanted targets, long enough and counted at all."""
    out = haplotypes.where((F.length("seq") >= least_length) & (F.col("cnt") > 0))
    return out if targets is None else out.join(targets.select("target"), "target", "left_semi")


def add_partial(final: DataFrame, partial: DataFrame) -> DataFrame:
    return final.unionByName(partial.where("trim_status").select(final.columns))


def normalise(haplotypes: DataFrame, totals: DataFrame) -> DataFrame:
    """frac within (target, sample), and cnt = round(frac x reads of the target); ``totals``: target, sample, reads."""
    sums = haplotypes.groupBy(*T).agg(F.sum("cnt").alias("_s"))
    x = haplotypes.join(sums, T).withColumn("frac", F.col("cnt") / F.col("_s"))
    return x.join(totals, T).withColumn("cnt", F.round(F.col("frac") * F.col("reads")).cast("long")).drop("_s", "reads")


def attach_meta(haplotypes: DataFrame, meta: DataFrame) -> DataFrame:
    return haplotypes.join(meta, "sample", "left")


def meta_fields(meta: DataFrame, column: str = "meta") -> DataFrame:
    """All field names in use."""
    return meta.select(F.explode(F.map_keys(column)).alias("field")).distinct()


def without_output(samples: DataFrame, outputs: DataFrame) -> DataFrame:
    return samples.select("sample").distinct().join(outputs.select("sample"), "sample", "left_anti")


def one_sample_each(outputs: DataFrame, directory: str) -> None:
    reject(outputs.groupBy(directory).agg(F.countDistinct("sample").alias("n")).where("n > 1"), "folders with several samples")


def target_locations(haplotypes: DataFrame) -> DataFrame:
    """First index and number of sequences of each target in target order.  One row a target is summed in one task."""
    n = haplotypes.groupBy("target").agg(F.count("*").alias("n"))
    w = Window.orderBy("target").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))


def safe_targets(targets: DataFrame) -> DataFrame:
    """Two-way key of target names without dots."""
    return targets.select("target").distinct().withColumn("safe", F.replace("target", F.lit("."), F.lit("-")))


def choose_replicates(haplotypes: DataFrame, group: str, replicate: str, preferred: str, keep_common: bool = False) -> DataFrame:
    """One replicate of each group and target: preferred first, then the larger total, then the name; with ``keep_common``
    only sequences found in all replicates."""
    by = ["target", group]
    total = haplotypes.groupBy(*by, replicate).agg(F.max(F.col(preferred).cast("int")).alias("p"), F.sum("cnt").alias("c"))
    pick = total.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("p"), F.desc("c"), replicate))).where("r = 1")
    out = haplotypes.join(pick.select(*by, replicate), [*by, replicate], "left_semi")
    if not keep_common:
        return out
    n = haplotypes.groupBy(*by).agg(F.countDistinct(replicate).alias("n"))
    common = haplotypes.groupBy(*by, "seq").agg(F.countDistinct(replicate).alias("k")).join(n, by).where("k = n")
    return out.join(common, [*by, "seq"], "left_semi")


def choose_two_levels(haplotypes: DataFrame, experiment: str, biological: str, replicate: str, preferred: str, keep_common: bool = False) -> tuple[DataFrame, DataFrame]:
    """One replicate of each experiment's sample, then one of each biological sample among those that are left.

    Also the groups in which preference does not decide: level, target, group and
    the number of replicates that are equally preferred.
    """
    failed = None
    for level, group in (("experiment", experiment), ("biological", biological)):
        per = haplotypes.groupBy("target", F.col(group).cast("string").alias("group"), replicate).agg(F.max(F.col(preferred).cast("int")).alias("p"))
        top = per.groupBy("target", "group").agg(F.max("p").alias("p"))
        ties = per.join(top, ["target", "group", "p"]).groupBy("target", "group").agg(F.count("*").alias("replicates")).where("replicates > 1").withColumn("level", F.lit(level))
        failed = ties if failed is None else failed.unionByName(ties)
        haplotypes = choose_replicates(haplotypes, group, replicate, preferred, keep_common)
    return haplotypes, failed.select("level", "target", "group", "replicates")


def rewrite_meta(meta: DataFrame, drop: list[str], group: str, preferred: str, selected: DataFrame) -> DataFrame:
    """Metadata of preferred rows, and of selected samples that would vanish with the rest; one row a sample."""
    keep = meta.where(F.col(preferred))
    lost = meta.where(~F.coalesce(F.col(preferred), F.lit(False))).join(keep.select(group).distinct(), group, "left_anti").join(selected.select("sample"), "sample", "left_semi")
    out = keep.unionByName(lost).drop(*drop).distinct()
    reject(out.groupBy("sample").count().where("count > 1"), "samples with several rows of metadata")
    return out


def sequences_per_target(haplotypes: DataFrame, targets: DataFrame) -> DataFrame:
    n = haplotypes.groupBy("target").agg(F.count("*").alias("sequences"))
    return targets.select("target").distinct().join(n, "target", "left").na.fill(0, ["sequences"])


def sample_sets(haplotypes: DataFrame) -> DataFrame:
    return haplotypes.groupBy(*T).agg(F.count("*").alias("sequences"), F.sum("cnt").alias("reads"))


def lacking(haplotypes: DataFrame, samples: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, sample) without data, from the few targets and all samples."""
    every = samples.select("sample").distinct().join(F.broadcast(targets.select("target").distinct()))
    return every.join(haplotypes.select(*T), T, "left_anti")


def _deletions(seq: str = "seq") -> Column:
    """Hashes of a text and of all texts that lack one of its letters."""
    c = F.col(seq)
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.xxhash64(F.concat(F.left(c, i - 1), F.substr(c, i + 1))))
    return F.array_distinct(F.array_append(without, F.xxhash64(c)))


def _part_keys(n: Column, distance: int, seq: str, shift: int) -> Column:
    """Parts of a text of ``n`` letters cut in distance + 1, looked up ``shift`` letters on: length, number and letters of each."""
    d = distance + 1
    return F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: F.struct(
        n.alias("n"), i.alias("i"), F.substr(F.col(seq), F.floor(i * n / d).cast("int") + 1 + shift, (F.floor((i + 1) * n / d) - F.floor(i * n / d)).cast("int")).alias("part")))


def close_pairs(rows: DataFrame, by: list[str], distance: int) -> DataFrame:
    """Pairs (seq, other) of one group within an edit distance.

    Texts one edit apart have a text in common among themselves and those that lack
    one letter; that is the key, so only texts within two edits meet.  Within more
    edits, one of distance + 1 parts of the shorter text stands in the longer one,
    moved by at most the distance.
    """
    x = rows.select(*by, "seq").distinct()
    if distance == 1:
        keyed = x.select(*by, "seq", F.explode(_deletions()).alias("key"))
        pairs = keyed.join(keyed.withColumnRenamed("seq", "other"), [*by, "key"]).where("seq <> other")
        return pairs.select(*by, "seq", "other").distinct().where(F.levenshtein("seq", "other", 1) >= 0)
    n = F.length("seq")
    parts = x.select(*by, "seq", F.explode(_part_keys(n, distance, "seq", 0)).alias("key"))
    looks = F.concat(*[F.when(n - less >= 0, _part_keys(n - less, distance, "seq", shift)).otherwise(F.array().cast("array<struct<n:int,i:int,part:string>>")) for less in range(distance + 1) for shift in range(-distance, distance + 1)])
    found = x.select(*by, F.col("seq").alias("other"), F.explode(F.array_distinct(looks.cast("array<struct<n:int,i:int,part:string>>"))).alias("key"))
    pairs = parts.withColumn("key", F.col("key").cast("struct<n:int,i:int,part:string>")).join(found, [*by, "key"]).where("seq <> other").select(*by, "seq", "other").distinct()
    near = pairs.where(F.levenshtein("seq", "other", distance) >= 0)
    return near.unionByName(near.select(*by, F.col("other").alias("seq"), F.col("seq").alias("other"))).distinct()


def cluster(rows: DataFrame, by: list[str], distance: int = 1, rounds: int | None = None) -> DataFrame:
    """Each haplotype joins the most abundant neighbour within the distance that beats it, in rounds until none moves
    (or ``rounds`` are over): rows of *by*, seq (the representative) and cnt."""
    now = staged(rows.groupBy(*by, "seq").agg(F.sum("cnt").alias("cnt")))
    near = staged(close_pairs(now, by, distance))
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        other = now.select(*by, F.col("seq").alias("other"), F.col("cnt").alias("c2"))
        up = near.join(now, [*by, "seq"]).join(other, [*by, "other"]).where("c2 > cnt OR (c2 = cnt AND other < seq)")
        best = up.groupBy(*by, "seq").agg(F.max(F.struct("c2", "other")).alias("b")).select(*by, "seq", F.col("b.other").alias("to"))
        # only those whose target itself stays in this round move
        moves = staged(best.join(best.select(*by, F.col("seq").alias("to")), [*by, "to"], "left_anti"))
        if moves.isEmpty():
            return now
        now = staged(now.join(moves, [*by, "seq"], "left").groupBy(*by, F.coalesce("to", "seq").alias("seq")).agg(F.sum("cnt").alias("cnt")))
    return now


def least_reads(haplotypes: DataFrame, sample_reads: int = 10, cluster_size: int = 5) -> DataFrame:
    totals = haplotypes.groupBy(*T).agg(F.sum("cnt").alias("_s")).where(F.col("_s") >= sample_reads)
    return haplotypes.join(totals.select(*T), T, "left_semi").where(F.col("cnt") >= cluster_size)


def least_fraction(haplotypes: DataFrame, overall: float, custom: DataFrame | None = None) -> DataFrame:
    """frac at least the cutoff, the sample's own one where ``custom`` (sample, cutoff) has it."""
    if custom is None:
        return haplotypes.where(F.col("frac") >= overall)
    return haplotypes.join(custom, "sample", "left").where(F.col("frac") >= F.coalesce("cutoff", F.lit(overall))).drop("cutoff")


def least_fraction_in_any_replicate(haplotypes: DataFrame, cutoff: float) -> DataFrame:
    """Haplotypes whose fraction falls below the cutoff in some replicate go."""
    bad = haplotypes.where(F.col("frac") < cutoff).select(*T, "seq").distinct()
    return haplotypes.join(bad, [*T, "seq"], "left_anti")


def least_runs(haplotypes: DataFrame, runs: int) -> DataFrame:
    n = haplotypes.groupBy(*T, "seq").agg(F.countDistinct("replicate").alias("_n")).where(F.col("_n") >= runs)
    return haplotypes.join(n.select(*T, "seq"), [*T, "seq"], "left_semi")


def drop_one_offs(haplotypes: DataFrame, multiplier: float) -> DataFrame:
    """Haplotypes one edit from one of the sample that is ``multiplier`` times as frequent go."""
    pairs = close_pairs(haplotypes, T, 1)
    a, b = haplotypes.select(*T, "seq", "frac"), haplotypes.select(*T, F.col("seq").alias("other"), F.col("frac").alias("f2"))
    bad = pairs.join(a, [*T, "seq"]).join(b, [*T, "other"]).where(F.col("f2") >= multiplier * F.col("frac")).select(*T, "seq").distinct()
    return haplotypes.join(bad, [*T, "seq"], "left_anti")


def _two_best(seq: str, ordered: list[str]) -> list[tuple[int, str]]:
    """The two texts of a sorted list that share the longest prefixes with ``seq``: they are among the two on either side."""
    at = bisect_left(ordered, seq)
    near = {x for x in ordered[max(at - 2, 0) : at + 3] if x != seq}
    return sorted(((len(commonprefix((seq, x))), x) for x in near), reverse=True)[:2]


def _chimeras(factor: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Haplotypes of one sample by falling frequency; those frequent enough to be parents lie in two sorted lists, forward and backward."""
        rows = rows.sort_values(["low", "seq"], ascending=[False, True])
        parents = rows.sort_values(["high", "seq"], ascending=[False, True])
        names, highs = parents["seq"].tolist(), parents["high"].tolist()
        forward, backward, used, out = [], [], 0, []
        for seq, low in zip(rows["seq"], rows["low"]):
            while used < len(names) and highs[used] >= factor * low:
                insort(forward, names[used])
                insort(backward, names[used][::-1])
                used += 1
            fronts, backs = _two_best(seq, forward), _two_best(seq[::-1], backward)
            out.append(any(p > 0 and s > 0 and p + s >= len(seq) and a != b[::-1] for p, a in fronts for s, b in backs))
        return pd.DataFrame({"target": rows["target"], "sample": rows["sample"], "seq": rows["seq"], "chimera": out})

    return run


def mark_chimeras(haplotypes: DataFrame, factor: float = 2.0) -> DataFrame:
    """chimera: a prefix of one haplotype of the sample and the rest of another, both ``factor`` times as frequent.

    The longest prefixes are those of neighbours in sorted order, the longest
    suffixes those of neighbours of the reversed texts; two of each are enough, as
    the parents differ.  The haplotypes of one sample and target are one group.
    """
    sums = haplotypes.groupBy(*T, "seq").agg(F.max("frac").alias("high"), F.min("frac").alias("low"))
    kinds = haplotypes.schema
    schema = f"target {kinds['target'].dataType.simpleString()}, sample {kinds['sample'].dataType.simpleString()}, seq string, chimera boolean"
    marks = sums.groupBy(*T).applyInPandas(_chimeras(factor), schema).where("chimera")
    return haplotypes.join(marks, [*T, "seq"], "left").withColumn("chimera", F.coalesce("chimera", F.lit(False)))


def population_clusters(haplotypes: DataFrame, distance: int = 1) -> DataFrame:
    """Haplotypes of all samples, merged as within samples."""
    return cluster(haplotypes, ["target"], distance)


def low_level_filters(haplotypes: DataFrame, one_off_fraction: float = 0.21, common_low: float = 0.02) -> DataFrame:
    """kept_by: rare haplotypes in one sample only and below the fraction, and those low wherever they occur, go."""
    per = haplotypes.groupBy("target", "seq").agg(F.countDistinct("sample").alias("samples"), F.max("frac").alias("top"), F.avg("frac").alias("mean"))
    bad = per.where(((F.col("samples") == 1) & (F.col("top") < one_off_fraction)) | ((F.col("samples") > 1) & (F.col("mean") < common_low)))
    return haplotypes.join(bad, ["target", "seq"], "left_anti")


def rescue(kept: DataFrame, excluded: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Excluded haplotypes that are the major one of another sample, or expected, come back."""
    top = kept.unionByName(excluded.select(kept.columns)).groupBy(*T).agg(F.max(F.struct("cnt", "seq")).alias("m")).select("target", F.col("m.seq").alias("seq"))
    wanted = top if expected is None else top.unionByName(expected.select("target", "seq"))
    return kept.unionByName(excluded.join(wanted.distinct(), ["target", "seq"], "left_semi").select(kept.columns))


def previous_names(haplotypes: DataFrame, previous: DataFrame) -> DataFrame:
    """Names of an earlier population by sequence; several are joined by ':'."""
    names = previous.groupBy("target", "seq").agg(F.array_join(F.array_sort(F.collect_set("name")), ":").alias("name"))
    return haplotypes.join(names, ["target", "seq"], "left")


def samples_per_haplotype(haplotypes: DataFrame) -> DataFrame:
    return haplotypes.groupBy("target", "seq").agg(F.countDistinct("sample").alias("samples"), F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("sample_list"))


def meta_table(rows: DataFrame, fields: list[str], column: str = "meta") -> DataFrame:
    """Fields of the map as columns."""
    return rows.select(*[c for c in rows.columns if c != column], *[F.col(column).getItem(f).alias(f) for f in fields])


def coi_by_target(selected: DataFrame) -> DataFrame:
    """nSamples, total, min, max, mean and median COI of each target, one COI a sample."""
    one = selected.groupBy(*T).agg(F.max("coi").alias("coi"))
    return one.groupBy("target").agg(F.count("*").alias("n_samples"), F.sum("coi").alias("total"), F.min("coi").alias("min_coi"), F.max("coi").alias("max_coi"), F.avg("coi").alias("mean_coi"), F.median("coi").alias("median_coi"))
