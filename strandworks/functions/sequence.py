"""Sequence expressions: Spark built-ins only, null in gives null out.

Positions are 0-based and intervals half-open unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BASES = ("A", "C", "G", "T")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """0 .. n-1, empty when n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def piece(seq, start, length) -> Column:
    """``length`` letters from 0-based ``start``."""
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return _col(seq).substr(start.cast("int") + 1, length.cast("int"))


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def kmers(seq, k: int) -> Column:
    """All k-mers in order; empty for shorter texts."""
    # bound once: the optimizer would put a derived text's expression into every element's lambda
    def letters(s):
        return F.transform(upto(F.length(s) - k + 1), lambda i: s.substr(i + 1, F.lit(k)))

    def single_bytes(s):  # cut at once, where letters would be counted from the start for every k-mer
        return let(s.cast("binary"), lambda b: F.transform(upto(F.octet_length(b) - k + 1), lambda i: b.substr(i + 1, F.lit(k)).cast("string")))

    return let(_col(seq), lambda s: F.when(F.octet_length(s) == F.length(s), single_bytes(s)).otherwise(letters(s)))


def plogp(counts: Column) -> Column:
    """Entropy of an array of counts, in bits."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    entropy = lambda cs, t: F.aggregate(cs, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / t * F.log2(c / t)).otherwise(0.0))
    return let(counts, lambda cs: let(total(cs), lambda t: entropy(cs, t)))


def base_counts(seq) -> Column:
    """Counts of A, C, G, T; N counts as A."""
    seq = _col(seq)
    c, g, t = (F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit(""))) for b in BASES[1:])
    return let(F.array(c, g, t), lambda x: F.transform(F.array(F.length(seq) - x[0] - x[1] - x[2], x[0], x[1], x[2]), lambda v: v.cast("double")))


def base_entropy(seq) -> Column:
    return plogp(base_counts(seq))


def kmer_entropy(seq, k: int = 2) -> Column:
    """Entropy of the k-mers of a sequence, in bits."""
    return let(kmers(seq, k), lambda ks: plogp(F.transform(F.array_distinct(ks), lambda x: F.size(F.filter(ks, lambda y: y == x)).cast("double"))))


def qualities(qual) -> Column:
    """Phred numbers of a quality string (offset 33)."""
    return let(_col(qual), lambda q: F.transform(upto(F.length(q)), lambda i: F.ascii(q.substr(i + 1, F.lit(1))) - 33))


def _good_bases(least: int) -> str:
    """Class of the characters that stand for qualities of at least ``least``."""
    return r"[\x{%x}-\x{10ffff}]" % max(least + 33, 0)


def quality_bounds(qual, least: int) -> Column:
    """struct(start, end) of what stays when both ends are trimmed up to the first base of at least ``least``."""
    good = _good_bases(least)

    def bounds(q):
        n, kept = F.length(q), F.regexp_extract(q, f"(?s){good}.*", 0)
        inner = F.regexp_extract(kept, f"(?s).*{good}", 0)
        start = F.when(F.length(kept) > 0, n - F.length(kept)).otherwise(0)
        return F.struct(start.alias("start"), (start + F.length(inner)).alias("end"))

    return let(_col(qual), lambda q: F.struct(F.coalesce(bounds(q)["start"], F.lit(0)).alias("start"), F.coalesce(bounds(q)["end"], F.lit(0)).alias("end")))


def quality_fraction(qual, least: int = 30) -> Column:
    bad = r"[\x{0}-\x{%x}]" % (least + 32)
    return let(_col(qual), lambda q: F.when(F.length(q) > 0, F.length(F.regexp_replace(q, bad, "")) / F.length(q)).otherwise(0.0))


def entropy_bounds(seq, window: int, step: int, cutoff: float, k: int = 1) -> Column:
    """struct(start, end) between the first and the last window whose entropy reaches ``cutoff``."""
    entropy = (lambda s: base_entropy(s)) if k == 1 else (lambda s: kmer_entropy(s, k))

    def good(seq):
        windows = F.transform(upto(F.floor((F.length(seq) - window) / step).cast("int") + 1), lambda i: i * step)
        return F.filter(windows, lambda i: entropy(seq.substr(i + 1, F.lit(window))) >= cutoff)

    return let(let(_col(seq), good), lambda g: F.struct(F.coalesce(F.array_min(g), F.lit(0)).alias("start"), F.coalesce(F.array_max(g) + window, F.lit(0)).alias("end")))


def runs(seq) -> Column:
    """Run-length code: array of struct(base, start, size)."""
    texts = F.regexp_extract_all(_col(seq), F.lit(r"((.)\2*)"), F.lit(1))
    zero = F.struct(F.array().cast("array<struct<base:string,start:int,size:int>>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        texts, zero,
        lambda a, t: F.struct(F.array_append(a["out"], F.struct(F.left(t, F.lit(1)).alias("base"), a["at"].alias("start"), F.length(t).alias("size"))).alias("out"), (a["at"] + F.length(t)).alias("at")),
        lambda a: a["out"],
    )


def run_bases(seq) -> Column:
    """The sequence with every run shortened to one base."""
    return F.regexp_replace(_col(seq), r"(.)\1+", "$1")


def homopolymers(seq, least: int) -> Column:
    """Intervals of runs of at least ``least``."""
    # short runs are one piece up to the next long one, so the pieces are few and their places are sums of lengths
    long = r"(.)\1{%d,}" % (max(least, 1) - 1)

    def found(s):
        texts = F.regexp_extract_all(s, F.lit(long), F.lit(0))
        between = F.split(s, long, -1)
        zero = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

        def add(a, x):
            start = a["at"] + F.length(x["between"])
            end = start + F.length(x["text"])
            return F.struct(F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"), end.alias("at"))

        pieces = F.arrays_zip(texts.alias("text"), F.slice(between, F.lit(1), F.size(texts)).alias("between"))
        none = F.when(s.isNotNull(), F.array().cast("array<struct<start:int,end:int>>"))
        return F.when(F.size(texts) > 0, F.aggregate(pieces, zero, add, lambda a: a["out"])).otherwise(none)

    return let(_col(seq), found)


def end_homopolymer(seq) -> Column:
    return F.length(F.regexp_extract(_col(seq), r"((.)\2*)$", 1))


def longest_without_n(seq) -> Column:
    """Longest piece free of N, the first on ties."""
    parts = F.split(_col(seq), "N+")
    best = F.array_max(F.transform(parts, lambda p: F.length(p)))
    return let(best, lambda b: F.get(F.filter(parts, lambda p: F.length(p) == b), F.lit(0)))


def mismatches(a: Column, b: Column) -> Column:
    """Differing positions of two equally long texts."""
    return F.size(F.filter(upto(F.length(a)), lambda i: a.substr(i + 1, F.lit(1)) != b.substr(i + 1, F.lit(1))))


def merge_intervals(intervals: Column, expand: int = 1) -> Column:
    """Sorted intervals, joined where the next starts at most ``expand`` behind the end; the end is the largest."""
    typed = F.array().cast("array<struct<start:int,end:int>>")
    rows = F.sort_array(F.transform(intervals, lambda x: F.struct(x.start.cast("int").alias("start"), x.end.cast("int").alias("end"))))

    def add(a, x):
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"))))
        return F.when((F.size(a) > 0) & (x.start <= F.try_element_at(a, F.lit(-1)).end + expand - 1), joined).otherwise(F.array_append(a, x))

    def safe(a, x):
        return F.when(F.size(a) == 0, F.array(x)).otherwise(add(a, x))

    return F.aggregate(rows, typed, safe)


def primitive_unit(unit) -> Column:
    """Shortest unit whose repetition is ``unit``."""
    unit = _col(unit)
    n = F.length(unit)
    sizes = F.filter(F.sequence(F.lit(1), n), lambda p: (n % p == 0) & (F.repeat(unit.substr(F.lit(1), p), (n / p).cast("int")) == unit))
    return unit.substr(F.lit(1), F.get(sizes, F.lit(0)))


def canonical_rotation(unit) -> Column:
    """Least rotation of a tandem's unit."""
    unit = _col(unit)
    n = F.length(unit)
    return F.array_min(F.transform(upto(n), lambda i: F.concat(unit.substr(i + 1, n), unit.substr(F.lit(1), i))))
