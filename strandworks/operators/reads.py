"""Filters, routing and reshaping of reads (table: read_id, pair_id, mate, sample, name, seq, qual)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequence as S
from .staging import staged


def quality_trim(reads: DataFrame, least: int) -> DataFrame:
    """Both ends cut back to the first base of at least ``least``."""
    cut = reads.withColumn("_b", S.quality_bounds("qual", least))
    for c in ("seq", "qual"):
        cut = cut.withColumn(c, S.piece(c, F.col("_b.start"), F.col("_b.end") - F.col("_b.start")))
    return cut.drop("_b")


def entropy_trim(reads: DataFrame, window: int, step: int, cutoff: float) -> DataFrame:
    """Both ends cut back to the first window of enough base entropy."""
    cut = reads.withColumn("_b", S.entropy_bounds("seq", window, step, cutoff))
    for c in ("seq", "qual"):
        cut = cut.withColumn(c, S.piece(c, F.col("_b.start"), F.col("_b.end") - F.col("_b.start")))
    return cut.drop("_b")


def enough_quality(reads: DataFrame, least: int = 30, fraction: float = 0.5) -> DataFrame:
    return reads.where(S.quality_fraction("qual", least) >= fraction)


def enough_entropy(reads: DataFrame, bits: float = 0.75) -> DataFrame:
    return reads.where(S.base_entropy("seq") >= bits)


def filter_tests(reads: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """n and the number of reads that pass each named test, by sample, in one pass."""
    return reads.groupBy("sample").agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in tests.items()])


def unpaired_key(seq: str = "seq") -> Column:
    return F.col(seq)


def pair_key(a: str = "seq1", b: str = "seq2") -> Column:
    """The same for both orders of the mates."""
    return F.array_join(F.array_sort(F.array(a, b)), "-")


def first_of_duplicates(reads: DataFrame, key: Column, order: str, seq: str | None = "seq") -> DataFrame:
    """The first read of every (sample, key), by one aggregate: a hot key is merged before it travels, and columns that
    nobody reads are not carried.  ``seq`` names the column that is the key itself, if one is; ``order`` is unique."""
    others = [c for c in reads.columns if c not in ("sample", order, seq)]
    first = reads.withColumn("_key", key).groupBy("sample", "_key").agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in others])
    return first.select(*[F.col("_key").alias(c) if c == seq else F.col(c) for c in reads.columns])


def pairs(reads: DataFrame) -> DataFrame:
    """One row a pair: the mates' columns side by side, from rows that share pair_id."""
    def side(m):
        return reads.where(F.col("mate") == m).select("pair_id", "sample", F.col("read_id").alias(f"read_id{m}"), F.col("seq").alias(f"seq{m}"), F.col("qual").alias(f"qual{m}"))

    return side(1).join(side(2).drop("sample"), "pair_id")


def route_pairs(pairs: DataFrame, ok1: Column, ok2: Column) -> DataFrame:
    """fate: pair, dup (both pass, seen before in the sample), single1, single2 or off.  Duplicates are tested only where both pass."""
    marked = pairs.withColumns({"_1": ok1, "_2": ok2, "_key": pair_key()})
    first = marked.where("_1 AND _2").groupBy("sample", "_key").agg(F.min("pair_id").alias("_first")).select(F.col("_first").alias("pair_id"), F.lit(True).alias("_new"))
    both = F.col("_1") & F.col("_2")
    fate = F.when(both & F.col("_new").isNotNull(), "pair").when(both, "dup").when(F.col("_1"), "single1").when(F.col("_2"), "single2").otherwise("off")
    return marked.join(first, "pair_id", "left").withColumn("fate", fate).drop("_1", "_2", "_key", "_new")


def filter_counts(pairs: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row with the number of rows each named test is true for."""
    return pairs.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in tests.items()])


def filter_report(pairs: DataFrame, singles: DataFrame, least: int = 30, fraction: float = 0.5, bits: float = 0.75, constant: tuple[DataFrame, int, int] | None = None) -> DataFrame:
    """Reads lost to each filter, one row a sample: total, and for first mates, second mates and singles quality, entropy,
    duplicates and constant k-mers.

    A read is counted by its first fault, quality before entropy.  A mate whose
    partner fails goes on as a single.  Duplicates are later pairs or singles of the
    same sequences; constant k-mers (``constant``: k-mers, k and margin) are looked for in
    what is left, and a pair with them in both mates counts once.
    """
    def fault(seq, qual):
        return F.when(S.quality_fraction(qual, least) < fraction, "quality").when(S.base_entropy(seq) < bits, "entropy")

    p = staged(pairs.withColumns({"f1": fault("seq1", "qual1"), "f2": fault("seq2", "qual2")}))
    s = staged(singles.withColumn("f", fault("seq", "qual")))
    both = p.where("f1 IS NULL AND f2 IS NULL")
    alone = s.where("f IS NULL").select("sample", "read_id", "seq")
    for m, o in ((1, 2), (2, 1)):
        alone = alone.unionByName(p.where(f"f{m} IS NULL AND f{o} IS NOT NULL").select("sample", F.col(f"read_id{m}").alias("read_id"), F.col(f"seq{m}").alias("seq")))
    counts = [
        pairs.groupBy("sample").agg((2 * F.count("*")).alias("n")).withColumn("what", F.lit("total")),
        singles.groupBy("sample").agg(F.count("*").alias("n")).withColumn("what", F.lit("total"))]
    for t, c, name in ((p, "f1", "r1"), (p, "f2", "r2"), (s, "f", "singles")):
        counts.append(t.where(F.col(c).isNotNull()).groupBy("sample", F.concat(F.lit(name + "_"), c).alias("what")).agg(F.count("*").alias("n")))

    def dups(t, key, name):
        per = t.groupBy("sample", key.alias("_key")).agg((F.count("*") - 1).alias("n"))
        counts.append(per.groupBy("sample").agg(F.sum("n").alias("n")).withColumn("what", F.lit(name)))

    dups(both, pair_key(), "pairs_duplicates")
    dups(alone, unpaired_key(), "singles_duplicates")
    if constant is not None:
        bad, k, margin = constant
        kept = both.withColumn("_key", pair_key()).groupBy("sample", "_key").agg(*[F.min_by(c, "pair_id").alias(c) for c in ("read_id1", "seq1", "read_id2", "seq2")])
        once = first_of_duplicates(alone, unpaired_key(), "read_id")
        rows = staged(kept.select("sample", F.col("read_id1").alias("pair"), F.lit("r1").alias("side"), F.col("seq1").alias("seq"), F.col("read_id1").alias("read_id")).unionByName(
            kept.select("sample", F.col("read_id1").alias("pair"), F.lit("r2").alias("side"), F.col("seq2").alias("seq"), F.col("read_id2").alias("read_id"))).unionByName(
            once.select("sample", F.col("read_id").alias("pair"), F.lit("singles").alias("side"), "seq", "read_id")))
        hit = rows.join(drop_constant(rows, bad, k, margin).select("read_id"), "read_id", "left_anti")
        per = hit.groupBy("sample", "pair").agg(F.count("*").alias("sides"), F.min("side").alias("side"))
        name = F.when(F.col("sides") > 1, "pairs").otherwise(F.col("side"))
        counts.append(per.groupBy("sample", F.concat(name, F.lit("_constant")).alias("what")).agg(F.count("*").alias("n")))
    names = ["total"] + [f"{x}_{y}" for y in ("quality", "entropy") for x in ("r1", "r2", "singles")] + ["pairs_duplicates", "singles_duplicates"] + [f"{x}_constant" for x in ("pairs", "r1", "r2", "singles")]
    every = counts[0].select("sample", "what", "n")
    for c in counts[1:]:
        every = every.unionByName(c.select("sample", "what", "n"))
    return every.groupBy("sample").pivot("what", names).agg(F.sum("n")).na.fill(0, names)


def countable(reads: DataFrame, k: int) -> DataFrame:
    """Reads longer than k and free of N."""
    return reads.where((F.length("seq") > k) & (F.instr("seq", "N") == 0))


def countable_without_homopolymer(reads: DataFrame, k: int) -> DataFrame:
    """Also without a run of one base of length k."""
    return countable(reads, k).where(F.size(S.homopolymers("seq", k)) == 0)


def rescue_n(reads: DataFrame, k: int) -> DataFrame:
    """Reads holding N become their longest piece without it, where that is longer than k+1."""
    part = reads.where(F.instr("seq", "N") > 0).withColumn("seq", S.longest_without_n("seq"))
    return part.where(F.length("seq") > k + 1)


def constant_kmers(reads: DataFrame, k: int, least: int = 40, spread: float = 15.0) -> DataFrame:
    """K-mers seen often, always at nearly the same place of the read: kmer, n and the places' standard deviation, from whole sums."""
    at = reads.select(F.posexplode(S.kmers("seq", k)).alias("pos", "kmer"))
    sums = at.groupBy("kmer").agg(F.count("*").alias("n"), F.sum("pos").alias("s"), F.sum((F.col("pos") * F.col("pos")).cast("long")).alias("q")).where(F.col("n") >= least)
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0)))
    return sums.select("kmer", "n", sd.alias("sd")).where(F.col("sd") < spread)


#: Constant k-mers that every read is tested against in its own row; up to FEW they are sent to every task, beyond it joined by shuffle.
LITERALS, FEW = 2_000, 1 << 17


def drop_constant(reads: DataFrame, bad: DataFrame, k: int, margin: int = 200) -> DataFrame:
    """Reads without a constant k-mer within ``margin`` of either end."""
    bad = staged(bad.select("kmer"))
    size = bad.count()
    n = F.length("seq")
    near = F.filter(S.kmers("seq", k), lambda x, i: (i < margin) | (i + k > n - margin))
    if size <= LITERALS:
        known = [r.kmer for r in bad.collect()]
        return reads.where(~F.exists(near, lambda x: x.isin(known))) if known else reads
    few = F.broadcast(bad) if size <= FEW else bad
    at = reads.select("read_id", F.explode(F.array_distinct(near)).alias("kmer"))
    hit = at.join(few, "kmer", "left_semi").select("read_id").distinct()
    return reads.join(hit, "read_id", "left_anti")


def repair_singles(singles: DataFrame) -> DataFrame:
    """Singles that share a name become pairs in order; an odd one out stays single."""
    w = Window.partitionBy("name")
    numbered = singles.withColumns({"_i": F.row_number().over(w.orderBy("read_id")) - 1, "_n": F.count("*").over(w)})
    paired = F.floor(F.col("_i") / 2) * 2 + 1 < F.col("_n")
    return numbered.withColumns({
        "pair_no": F.when(paired, F.floor(F.col("_i") / 2)),
        "mate": F.when(paired, F.col("_i") % 2 + 1).cast("int"),
    }).drop("_i", "_n")


def stitch(pairs: DataFrame, min_overlap: int, max_error: float = 0.0, a: str = "seq1", b: str = "seq2") -> DataFrame:
    """Join mates whose overlap, the longest within the error, is at least ``min_overlap``.

    The second mate is in the first one's orientation.  status: perfect (the mates
    are one another), r1_ends_in_r2, or none.
    """
    x, y = F.col(a), F.col(b)

    def longest(x, y):
        shortest = F.least(F.length(x), F.length(y))
        sizes = F.when(shortest >= min_overlap, F.sequence(F.lit(min_overlap), shortest)).otherwise(F.array().cast("array<int>"))
        if max_error:
            fits = F.filter(sizes, lambda o: S.mismatches(F.right(x, o), F.left(y, o)) / o <= max_error)
        else:  # without errors the texts are compared as a whole, where the second one's first letters come near enough to the first one's end
            fits = F.filter(sizes, lambda o: x.substr(F.length(x) - o + 1, o) == y.substr(F.lit(1), o))
            if min_overlap > 0:
                fits = F.when(F.contains(x, F.left(y, F.lit(min_overlap))), fits).otherwise(F.array().cast("array<int>"))
        return F.array_max(fits)

    # bound once: a derived mate would be derived again for every overlap tried
    out = pairs.withColumn("overlap", S.let(F.struct(x.alias("x"), y.alias("y")), lambda m: longest(m["x"], m["y"])))
    whole = (F.col("overlap") == F.length(x)) & (F.col("overlap") == F.length(y))
    status = F.when(F.col("overlap").isNull(), "none").when(whole, "perfect").otherwise("r1_ends_in_r2")
    return out.withColumns({"status": status, "stitched": F.when(F.col("overlap").isNotNull(), F.concat(x, y.substr(F.col("overlap") + 1, F.length(y))))})


def stitch_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outcomes before and after the second try in the other orientation, and together."""
    both = before.select("status", F.lit("before").alias("pass")).union(after.select("status", F.lit("after").alias("pass")))
    return both.groupBy("status").pivot("pass", ["before", "after"]).count().select(
        "status", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), (F.coalesce("before", F.lit(0)) + F.coalesce("after", F.lit(0))).alias("combined"))


def length_stats(reads: DataFrame) -> DataFrame:
    n = F.length("seq")
    return reads.groupBy("sample").agg(F.avg(n).alias("mean_len"), F.median(n).alias("median_len"), F.max(n).alias("max_len"))


def tandem_candidates(reads: DataFrame, k: int, max_unit: int | None = None) -> DataFrame:
    """Maximal stretches where seq[i] = seq[i+u], of at least 2u and 2k bases: read_id, unit, start, size.

    Units of up to half the read, or up to ``max_unit`` bases.
    """
    seq = F.col("seq")
    half = F.floor(F.length(seq) / 2).cast("int")
    rows = reads.select("read_id", "seq", F.explode(S.upto(half if max_unit is None else F.lit(max_unit))).alias("u")).withColumn("u", F.col("u") + 1)
    same = F.filter(S.upto(F.length(seq) - F.col("u")), lambda i: (seq.substr(i + 1, F.lit(1)) == seq.substr(i + F.col("u") + 1, F.lit(1))) & (seq.substr(i + 1, F.lit(1)) != "N"))
    stretches = S.merge_intervals(F.transform(same, lambda i: F.struct(i.alias("start"), (i + 1).alias("end"))), 1)
    found = rows.where(F.col("u") < F.length(seq)).select("read_id", "seq", "u", F.explode(stretches).alias("s"))
    size = F.col("s.end") - F.col("s.start") + F.col("u")
    kept = found.where((size >= 2 * F.col("u")) & (size >= 2 * k)).select("read_id", S.piece("seq", F.col("s.start"), F.col("u")).alias("unit"), F.col("s.start").alias("start"), size.alias("size"))
    return kept.where(F.col("unit") == S.primitive_unit("unit"))


def choose_tandems(found: DataFrame, k: int, cutoff: int, fold: bool = True) -> DataFrame:
    """Tandems of at least k bases by canonical unit, kept when counted more than the cutoff (halved from 6 on)."""
    unit = S.primitive_unit("unit") if fold else F.col("unit")
    least = cutoff / 2 if cutoff >= 6 else cutoff
    rows = found.where(F.col("size") >= k).withColumn("canon", S.canonical_rotation(unit))
    return rows.groupBy("canon").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.array_sort(F.collect_set("unit")).alias("alternates")).where(F.col("n") > least)


def locate_tandems(reads: DataFrame, units: DataFrame, min_repeats: int, min_size: int) -> DataFrame:
    """Runs of consecutive whole units in reads: read_id, unit, start, end.  ``units`` (unit) is a short chosen list."""
    seq, u = F.col("seq"), F.col("unit")
    # candidate reads share the unit doubled, found by the k-mers of its length
    at = F.filter(S.upto(F.length(seq) - F.length(u) + 1), lambda i: seq.substr(i + 1, F.length(u)) == u)
    sized = units.select("unit", F.length("unit").alias("_len")).where("_len > 0")
    lengths = sized.agg(F.array_sort(F.collect_set("_len")).alias("_lens"))
    spans = reads.crossJoin(F.broadcast(lengths)).select("read_id", "seq", F.explode("_lens").alias("_len"))
    kmers = F.transform(S.upto(F.length(seq) - F.col("_len") + 1), lambda i: seq.substr(i + 1, F.col("_len")))
    probes = spans.select("read_id", "seq", "_len", F.explode(F.array_distinct(kmers)).alias("unit"))
    hits = probes.join(sized, ["unit", "_len"]).select("read_id", "seq", "unit", F.explode(at).alias("pos"))
    n = F.length("unit")
    phase = Window.partitionBy("read_id", "unit", F.col("pos") % n).orderBy("pos")
    islands = hits.withColumn("_g", F.col("pos") - n * F.row_number().over(phase))
    runs = islands.groupBy("read_id", "unit", "_g").agg(F.min("pos").alias("start"), (F.max("pos") + F.max(n)).alias("end"), F.count("*").alias("repeats"))
    return runs.where((F.col("repeats") >= min_repeats) & (F.col("end") - F.col("start") >= min_size)).drop("_g")


def join_tandems(located: DataFrame, reads: DataFrame) -> DataFrame:
    """Intervals grown over partial units at both ends, then joined within a motif where the gap is at most a unit."""
    x = located.join(reads.select("read_id", "seq"), "read_id")
    unit, n, seq = F.col("unit"), F.length("unit"), F.col("seq")
    left = F.array_max(F.filter(S.upto(n), lambda p: (p <= F.col("start")) & (seq.substr(F.col("start") - p + 1, p) == F.right(unit, p))))
    right = F.array_max(F.filter(S.upto(n), lambda p: seq.substr(F.col("end") + 1, p) == F.left(unit, p)))
    grown = x.select("read_id", "unit", (F.col("start") - F.coalesce(left, F.lit(0))).alias("start"), (F.col("end") + F.coalesce(right, F.lit(0))).alias("end"))
    back = Window.partitionBy("read_id", "unit").orderBy("start", "end")
    furthest = F.max("end").over(back.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") - furthest) > n, F.lit(True)).cast("int")
    return grown.withColumn("_g", fresh).withColumn("_g", F.sum("_g").over(back)).groupBy("read_id", "unit", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def expansion_intervals(reads: DataFrame, tandems: DataFrame, k: int) -> DataFrame:
    """read_id and intervals: tandems and homopolymers, merged, of at least k-1 bases."""
    runs = reads.select("read_id", F.explode(S.homopolymers("seq", k - 1)).alias("x")).select("read_id", "x.start", "x.end")
    both = tandems.select("read_id", F.col("start").cast("int"), F.col("end").cast("int")).unionByName(runs)
    merged = both.groupBy("read_id").agg(S.merge_intervals(F.collect_list(F.struct("start", "end")), 1).alias("intervals"))
    return merged.withColumn("intervals", F.filter("intervals", lambda x: x.end - x.start >= k - 1)).where(F.size("intervals") > 0)


def subsample(reads: DataFrame, shares: DataFrame, seed: int = 0) -> DataFrame:
    """Pairs kept with their region's share; mates stay together.  ``shares``: region, share."""
    draw = F.pmod(F.xxhash64("pair_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return reads.join(shares, "region").where(draw < F.col("share")).drop("share")


def sample_name(path: Column, in_name: Column | None = None) -> Column:
    """Sample from the read name's metadata ([...;sample=x;...]), else the file name up to its first dot or _R1/_R2."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    from_file = F.regexp_replace(F.regexp_extract(base, r"^([^.]+)", 1), r"_R[12].*$", "")
    if in_name is None:
        return from_file
    return F.coalesce(F.nullif(F.regexp_extract(in_name, r"[\[;]sample=([^;\]]+)", 1), F.lit("")), from_file)


def split_by_tandem(reads: DataFrame, intervals: DataFrame) -> DataFrame:
    """has_tandem: whether the read holds an interval."""
    return reads.join(intervals.select("read_id").distinct().withColumn("has_tandem", F.lit(True)), "read_id", "left").withColumn("has_tandem", F.coalesce("has_tandem", F.lit(False)))
