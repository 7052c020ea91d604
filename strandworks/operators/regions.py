"""Regions, alignments and recruitment.  Intervals are half-open; joins go by bins of the genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sequence as S
from .staging import staged

BIN = 1000


def filter_alignments(a: DataFrame, least_mapq: int = 0, proper: bool = False, max_soft_clip: int | None = None) -> DataFrame:
    """Primary, mapped, not marked as duplicates; optionally of a mapping quality, proper, little clipped."""
    out = a.where("is_primary AND is_mapped AND NOT is_dup").where(F.col("mapq") >= least_mapq)
    out = out.where("is_proper") if proper else out
    return out if max_soft_clip is None else out.where(F.col("soft_clip") <= max_soft_clip)


def bins(start: Column, end: Column, size: int = BIN) -> Column:
    return F.sequence(F.floor(start / size), F.floor((F.greatest(end, start + 1) - 1) / size))


def overlaps(a: DataFrame, regions: DataFrame, size: int = BIN) -> DataFrame:
    """Alignments that overlap regions, once a pair: an equi-join on chromosome and bin, kept in the first shared bin."""
    x = a.withColumn("_bin", F.explode(bins(F.col("pos"), F.col("end_pos"), size)))
    y = regions.select(F.col("chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("uid"), F.explode(bins(F.col("start"), F.col("end"), size)).alias("_bin"))
    hit = x.join(y, ["chrom", "_bin"]).where("pos < r_end AND r_start < end_pos")
    return hit.where(F.col("_bin") == F.floor(F.greatest("pos", "r_start") / size)).drop("_bin")


def covered_bases(a: DataFrame, regions: DataFrame, multi_below: int = 5) -> DataFrame:
    """Bases of each region covered by alignments; where mates of a pair overlap, once.  Also those of low mapping quality."""
    hit = overlaps(a, regions).withColumns({"lo": F.greatest("pos", "r_start"), "hi": F.least("end_pos", "r_end")})
    first, second = (hit.where(F.col("mate") == m).select("uid", "name", "lo", "hi") for m in (1, 2))
    twice = first.join(second.toDF("uid", "name", "lo2", "hi2"), ["uid", "name"]).groupBy("uid").agg(F.sum(F.greatest(F.least("hi", "hi2") - F.greatest("lo", "lo2"), F.lit(0))).alias("twice"))
    size = F.col("hi") - F.col("lo")
    per = hit.groupBy("uid").agg(F.sum(size).alias("raw"), F.sum(F.when(F.col("mapq") < multi_below, size).otherwise(0)).alias("multi_bases"))
    x = regions.join(per, "uid", "left").join(twice, "uid", "left")
    bases = F.coalesce("raw", F.lit(0)) - F.coalesce("twice", F.lit(0))
    return x.withColumns({"bases": bases, "multi_bases": F.coalesce("multi_bases", F.lit(0)), "coverage": bases / F.greatest(F.col("end") - F.col("start"), F.lit(1))}).drop("raw", "twice")


def pair_fractions(a: DataFrame, regions: DataFrame) -> DataFrame:
    """Paired, proper and mate-unmapped reads of each region and their fractions of the paired."""
    per = overlaps(a, regions).groupBy("uid").agg(F.count_if("is_paired").alias("paired"), F.count_if(F.col("is_paired") & F.col("is_proper")).alias("proper"), F.count_if(F.col("is_paired") & ~F.col("mate_mapped")).alias("mate_unmapped"))
    x = regions.join(per, "uid", "left").na.fill(0, ["paired", "proper", "mate_unmapped"])
    some = F.col("paired") > 0
    return x.withColumns({"proper_fraction": F.when(some, F.col("proper") / F.col("paired")).otherwise(0.0), "mate_unmapped_fraction": F.when(some, F.col("mate_unmapped") / F.col("paired")).otherwise(0.0)})


def spanning_reads(a: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads (by name) that touch each region, and those that span it: one mate alone, or two overlapping mates of
    different strands together."""
    hit = overlaps(a, regions)
    per = hit.groupBy("uid", "name").agg(
        F.bool_or((F.col("pos") <= F.col("r_start")) & (F.col("end_pos") >= F.col("r_end"))).alias("one"),
        F.min("pos").alias("lo"), F.max("end_pos").alias("hi"), F.max("pos").alias("inner_lo"), F.min("end_pos").alias("inner_hi"),
        # a mate is 1 or 2: that both are there shows without counting distinct ones, which would send every row three times
        (F.min("mate") < F.max("mate")).alias("mates"), (F.min("is_reverse") != F.max("is_reverse")).alias("strands"), F.max("r_start").alias("r_start"), F.max("r_end").alias("r_end"))
    joint = F.col("mates") & F.col("strands") & (F.col("inner_lo") <= F.col("inner_hi")) & (F.col("lo") <= F.col("r_start")) & (F.col("hi") >= F.col("r_end"))
    n = per.groupBy("uid").agg(F.count("*").alias("reads"), F.count_if(F.col("one") | joint).alias("spanning"))
    return regions.join(n, "uid", "left").na.fill(0, ["reads", "spanning"])


def region_report(a: DataFrame, regions: DataFrame) -> DataFrame:
    """Coverage and spanning reads of all regions, in genome order."""
    cov = covered_bases(a, regions)
    return cov.join(spanning_reads(a, regions).select("uid", "reads", "spanning"), "uid").orderBy("chrom", "start", "end", "uid")


def expand_regions(regions: DataFrame, bases: int) -> DataFrame:
    return regions.withColumns({"start": F.greatest(F.col("start") - bases, F.lit(0)), "end": F.col("end") + bases})


def roll_up(regions: DataFrame, *values: str) -> DataFrame:
    """Totals over regions of one name, given to each of them."""
    sums = regions.groupBy("name").agg(*[F.sum(v).alias(f"{v}_total") for v in values], F.sum(F.col("end") - F.col("start")).alias("length_total"))
    return regions.join(sums, "name")


def recruit(a: DataFrame, regions: DataFrame) -> DataFrame:
    """All alignments of pairs that fall in a region, with read_class: pair, mate_unmapped or single."""
    names = overlaps(a, regions).select("name").distinct()
    got = a.join(names, "name", "left_semi")
    mates = got.groupBy("name").agg(F.countDistinct("mate").alias("_m"))
    kind = F.when(F.col("is_paired") & ~F.col("mate_mapped"), "mate_unmapped").when(F.col("_m") >= 2, "pair").otherwise("single")
    return got.join(mates, "name").withColumn("read_class", kind).drop("_m")


def outside(a: DataFrame, avoid: DataFrame, small: int) -> DataFrame:
    """Unmapped reads, and mapped ones of at most ``small`` bases, that overlap no region to avoid."""
    pool = a.where(~F.col("is_mapped") | (F.col("end_pos") - F.col("pos") <= small))
    hit = overlaps(pool.where("is_mapped"), avoid).select("name", "mate").distinct()
    return pool.join(hit, ["name", "mate"], "left_anti")


def recruit_by_kmers(reads: DataFrame, contigs: DataFrame, k: int = 19, least: int = 1, length: int = 80) -> DataFrame:
    """Reads that share at least ``least`` k-mers with a contig on either strand, turned to the better one; read_id, strand, seq, shared."""
    known = contigs.where(F.length("seq") >= length).select(F.explode(F.array_distinct(S.kmers("seq", k))).alias("kmer")).distinct()
    both = reads.select("read_id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), S.reverse_complement("seq").alias("seq")))).alias("x")).select("read_id", "x.strand", "x.seq")
    hit = both.select("read_id", "strand", F.explode(F.array_distinct(S.kmers("seq", k))).alias("kmer")).join(known, "kmer", "left_semi")
    n = hit.groupBy("read_id", "strand").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    best = n.groupBy("read_id").agg(F.min(F.struct((-F.col("shared")).alias("neg"), "strand")).alias("b")).select("read_id", "b.strand", (-F.col("b.neg")).alias("shared"))
    return both.join(best, ["read_id", "strand"])


def recruit_to(reads: DataFrame, contigs: DataFrame, k: int = 19, least: int = 1, length: int = 80) -> DataFrame:
    """Reads (read_id, seq) by the assembly whose contigs (assembly, seq) they share at least ``least`` k-mers with, turned to
    the better strand: assembly, read_id, seq, shared."""
    known = contigs.where(F.length("seq") >= length).select("assembly", F.explode(F.array_distinct(S.kmers("seq", k))).alias("kmer")).distinct()
    both = reads.select("read_id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), S.reverse_complement("seq").alias("seq")))).alias("x")).select("read_id", "x.strand", "x.seq")
    hit = both.select("read_id", "strand", F.explode(F.array_distinct(S.kmers("seq", k))).alias("kmer")).join(known, "kmer")
    n = hit.groupBy("assembly", "read_id", "strand").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    best = n.groupBy("assembly", "read_id").agg(F.max("shared").alias("shared"), F.min_by("strand", F.struct((-F.col("shared")).alias("n"), "strand")).alias("strand"))
    turned = F.when(F.col("strand") == "-", S.reverse_complement("seq")).otherwise(F.col("seq"))
    return best.join(reads.select("read_id", "seq"), "read_id").select("assembly", "read_id", turned.alias("seq"), "shared")


def recruit_rounds(pool: DataFrame, seeds: DataFrame, assemble, rounds: int = 20, **options) -> tuple[DataFrame, DataFrame]:
    """Recruit reads of ``pool`` that match the seeds (assembly, seq), assemble what each assembly has, go on with the contigs.

    ``assemble(reads, i)`` makes contigs (assembly, seq) from reads (assembly, read_id,
    seq) of round i.  Only contigs that no earlier round had meet the pool, and only
    reads that an assembly does not have yet are new; the loop ends when there are
    none, or after ``rounds``.  Returns reads and contigs with the round they came in.
    """
    have, met, contigs = None, staged(seeds.select("assembly", "seq").distinct()), seeds
    made = []
    for i in range(rounds):
        found = recruit_to(pool, contigs, **options)
        if have is not None:
            found = found.join(have.select("assembly", "read_id"), ["assembly", "read_id"], "left_anti")
        new = staged(found.select("assembly", "read_id", "seq", F.lit(i).alias("round")))
        if new.isEmpty():
            break
        have = new if have is None else staged(have.unionByName(new))
        # an assembly without new reads would give the contigs it gave before
        grown = have.join(new.select("assembly").distinct(), "assembly", "left_semi")
        fresh = assemble(grown.drop("round"), i).select("assembly", "seq").distinct().join(met, ["assembly", "seq"], "left_anti")
        contigs = staged(fresh.withColumn("round", F.lit(i)))
        made.append(contigs)
        met = staged(met.unionByName(contigs.select("assembly", "seq")))
    none = seeds.limit(0)
    if have is None:
        return none.select("assembly", F.lit(0).cast("long").alias("read_id"), "seq", F.lit(0).alias("round")), none.select("assembly", "seq", F.lit(0).alias("round"))
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return have, out


def reuse_settings(best: DataFrame, regions: DataFrame) -> DataFrame:
    """The settings later rounds use: those of each region's best first run."""
    return regions.join(best.select("region", "klen", "kcut", "tip"), "region")


def recruitment_filter(a: DataFrame, regions: DataFrame, in_region: float, aligned: int, clipped: float) -> DataFrame:
    """Recruited alignments: enough of the read in the region, enough aligned, little clipped, proper unless the mate is
    unmapped, no marked duplicates."""
    size = F.col("end_pos") - F.col("pos")
    inside = F.least("end_pos", "r_end") - F.greatest("pos", "r_start")
    x = overlaps(a.where("NOT is_dup"), regions)
    return x.where((inside / size >= in_region) & (size >= aligned) & (F.col("soft_clip") / (size + F.col("soft_clip")) <= clipped) & (F.col("is_proper") | ~F.col("mate_mapped") | ~F.col("is_paired")))


def coi_histogram(haplotypes: DataFrame) -> DataFrame:
    """Regions by number of haplotypes."""
    return haplotypes.groupBy("region").agg(F.countDistinct("hap").alias("uniq_haps")).groupBy("uniq_haps").agg(F.count("*").alias("regions")).orderBy("uniq_haps")


#: Letters of a contig that one row holds.
BLOCK = 10_000


def contig_blocks(genome: DataFrame, size: int = BLOCK) -> DataFrame:
    """chrom, block, piece and length (of the contig): contigs (chrom, seq) in rows of bounded size."""
    n = F.length("seq")
    last = F.greatest(F.ceil(n / size) - 1, F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: S.piece("seq", i * size, F.lit(size)))
    return genome.select("chrom", n.cast("long").alias("length"), F.posexplode(pieces).alias("block", "piece"))


def region_sequences(regions: DataFrame, genome: DataFrame, left: int = 0, right: int = 0, size: int = BLOCK) -> DataFrame:
    """Reference sequence of each region, extended and clipped to the contig; the minus strand is turned.

    A region meets the blocks it lies in, not the contig.  seq is null for a region
    of an unknown contig or beyond its contig's end.
    """
    blocks = contig_blocks(genome, size)
    known = blocks.where("block = 0").select("chrom", "length")
    a = F.greatest(F.col("start") - left, F.lit(0))
    cut = regions.select("uid", "chrom", a.alias("a"), (F.col("end") + right).alias("z")).join(known, "chrom").withColumn("z", F.least("z", "length"))
    inside = cut.where((F.col("a") < F.col("length")) & (F.col("z") > F.col("a")))
    meets = inside.select("uid", "chrom", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("z") - 1) / size))).alias("block"))
    parts = meets.join(blocks.select("chrom", F.col("block").cast("long").alias("block"), "piece"), ["chrom", "block"])
    low, high = F.greatest(F.col("a") - F.col("block") * size, F.lit(0)), F.least(F.col("z") - F.col("block") * size, F.lit(size))
    rows = parts.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("block", S.piece("piece", low, high - low).alias("s")))).alias("p"))
    found = rows.select("uid", F.array_join(F.transform("p", lambda x: x.s), "").alias("seq"))
    out = regions.join(found, "uid", "left")
    return out.withColumn("seq", F.when(F.col("strand") == "-", S.reverse_complement("seq")).otherwise(F.col("seq")))
