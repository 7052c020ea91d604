"""Readers, writers, regions, reads, contigs, population and places on small tables with known answers."""

import random
from os.path import commonprefix

import pytest
from pyspark.sql import functions as F

from strandworks.operators import contigs as C
from strandworks.operators import geography as H
from strandworks.operators import population as P
from strandworks.operators import reads as R
from strandworks.operators import regions as I
from strandworks.sources import readers
from strandworks.sources import writers as W


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# --- sources ----------------------------------------------------------------------


def test_fastq_over_several_files(spark, tmp_path):
    for mate in (1, 2):
        (tmp_path / f"m{mate}").mkdir()
        for part in range(3):
            (tmp_path / f"m{mate}" / f"f{part}.fastq").write_text("".join(f"@r{part}{i}/{mate}\nACG{'ACGT'[i]}\n+\nIII{mate}\n" for i in range(4)))
    one = {r.name: (r.record, r.seq, r.qual) for r in readers.fastq(spark, str(tmp_path / "m1")).collect()}
    assert one["r00/1"] == (0, "ACGA", "III1") and one["r13/1"] == (7, "ACGT", "III1") and len(one) == 12
    two = readers.paired_fastq(spark, str(tmp_path / "m1"), str(tmp_path / "m2"), turn_mate=True).collect()
    assert len(two) == 12 and {(r.seq1, r.seq2) for r in two} == {("ACGA", "TCGT"), ("ACGC", "GCGT"), ("ACGG", "CCGT"), ("ACGT", "ACGT")} and {r.qual2 for r in two} == {"2III"}


def test_tables_and_missing_columns(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("sample\tcountry\tsite\na\tX\tx1\nb\tY\ty1\n")
    some = spark.createDataFrame([("a",), ("c",)], "sample string")
    assert [tuple(r) for r in readers.places(spark, str(tmp_path / "t.tsv"), some).collect()] == [("a", "X", "x1")]
    assert [r.sample for r in readers.sample_meta(spark, str(tmp_path / "t.tsv"), some).collect()] == ["a"]
    with pytest.raises(ValueError, match="missing columns"):
        readers.table(spark, str(tmp_path / "t.tsv"), "sample", "longitude")


def test_fasta_bed_and_sam(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nACG\nTTT\n>two\nGG\n")
    assert {(r.name, r.description, r.seq) for r in readers.fasta(spark, str(tmp_path / "x.fa")).collect()} == {("one", "one first", "ACGTTT"), ("two", "two", "GG")}
    (tmp_path / "x.bed").write_text("# c\nchr1\t5\t9\tn1\t3\t-\textra\n\nchr2\t0\t4\n")
    rows = {r.chrom: r for r in readers.bed(spark, str(tmp_path / "x.bed")).collect()}
    assert (rows["chr1"].start, rows["chr1"].end, rows["chr1"].name) == (5, 9, "n1") and rows["chr2"].name is None
    (tmp_path / "x.sam").write_text("@HD\nr1\t99\tchr1\t11\t60\t2S5M1D3M\t=\t30\t0\tACGTACGTAC\tIIIIIIIIII\n")
    r = readers.sam(spark, str(tmp_path / "x.sam")).first()
    assert (r.pos, r.end_pos, r.soft_clip, r.mate, r.is_proper, r.is_mapped) == (10, 19, 2, 1, True, True)


def test_groups_in_a_bounded_number_of_files(spark, tmp_path):
    nodes = spark.createDataFrame([("s", i, i // 3) for i in range(300)], "assembly_id string, node_id long, group long")
    W.save_by_group(nodes, str(tmp_path / "g"), files=4)
    files = [p for p in (tmp_path / "g" / "nodes").iterdir() if p.name.startswith("part")]
    index = spark.read.parquet(str(tmp_path / "g" / "index")).collect()
    assert len(files) <= 4 and len(index) == 100 and {r.rows for r in index} == {3}
    one = next(r for r in index if r.group == 42)
    assert sorted(r.node_id for r in spark.read.parquet(str(tmp_path / "g" / "nodes" / one.file)).where("group = 42").collect()) == [126, 127, 128]


# --- regions ----------------------------------------------------------------------


def test_region_sequences_over_blocks(spark):
    genome = {"c1": "".join(random.Random(1).choices("ACGT", k=95)), "c2": "ACGTACGT"}
    regions = [(1, "c1", 8, 31, "+"), (2, "c1", 0, 95, "-"), (3, "c1", 90, 200, "+"), (4, "c2", 20, 30, "+"), (5, "c9", 1, 2, "+"), (6, "c2", 2, 2, "+"), (7, "c1", 19, 20, "+")]
    table = spark.createDataFrame(regions, "uid long, chrom string, start long, end long, strand string")
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for left, right in ((0, 0), (3, 5)):
        got = {r.uid: r.seq for r in I.region_sequences(table, spark.createDataFrame(list(genome.items()), "chrom string, seq string"), left, right, size=10).collect()}
        for uid, chrom, start, end, strand in regions:
            g = genome.get(chrom, "")
            s = g[max(start - left, 0) : end + right]
            assert got[uid] == ((turn(s) if strand == "-" else s) or None)


# --- reads ------------------------------------------------------------------------


def read_rows(spark, seqs):
    return spark.createDataFrame([(i, "s", x, "I" * len(x)) for i, x in enumerate(seqs)], "read_id long, sample string, seq string, qual string")


def test_constant_kmers_by_both_ways(spark, monkeypatch):
    rng = random.Random(3)
    tag = "ACGTTGCA"
    seqs = [tag + "".join(rng.choices("ACGT", k=40)) for _ in range(30)] + ["".join(rng.choices("ACGT", k=48)) for _ in range(30)]
    x = read_rows(spark, seqs)
    bad = R.constant_kmers(x, 8, least=20, spread=2.0)
    assert {r.kmer for r in bad.collect()} == {tag}
    kept = {i for i, s in enumerate(seqs) if tag not in (s[:20] + "-" + s[-20:])}
    assert {r.read_id for r in R.drop_constant(x, bad, 8, 20).collect()} == kept
    monkeypatch.setattr(R, "LITERALS", 0)
    assert {r.read_id for r in R.drop_constant(x, bad, 8, 20).collect()} == kept


def test_filter_report(spark):
    good, low, other = "ACGTTGCAGTCA", "AAAAAAAAAAAA", "TTCAGGACTCAT"
    pairs = [("s", 1, 10, 11, good, other, "I" * 12, "I" * 12), ("s", 2, 12, 13, good, other, "I" * 12, "I" * 12), ("s", 3, 14, 15, low, good, "I" * 12, "I" * 12), ("s", 4, 16, 17, good, low, "!" * 12, "I" * 12)]
    p = spark.createDataFrame(pairs, "sample string, pair_id long, read_id1 long, read_id2 long, seq1 string, seq2 string, qual1 string, qual2 string")
    s = spark.createDataFrame([(20, "s", good, "I" * 12), (21, "s", good + "A", "!" * 13), (22, "t", low, "I" * 12)], "read_id long, sample string, seq string, qual string")
    bad = spark.createDataFrame([("ACGTTG",)], "kmer string")
    got = {r["sample"]: r.asDict() for r in R.filter_report(p, s, 20, 0.5, 1.0, (bad, 6, 100)).collect()}
    want = {"total": 10, "r1_entropy": 1, "r2_entropy": 1, "r1_quality": 1, "singles_quality": 1, "pairs_duplicates": 1, "singles_duplicates": 1, "r1_constant": 1, "singles_constant": 1}
    assert {k: v for k, v in got["s"].items() if v and k != "sample"} == want
    assert {k: v for k, v in got["t"].items() if v and k != "sample"} == {"total": 1, "singles_entropy": 1}
    assert len(got["s"]) == 14


# --- contigs ----------------------------------------------------------------------


def test_best_runs_and_early_stop(spark):
    runs = spark.createDataFrame(
        [("x", 11, 1, 2, 5, 0, 3, 0.95), ("x", 11, 2, 2, 2, 1, 4, 0.91), ("x", 11, 3, 2, 2, 0, 4, 0.92), ("x", 11, 4, 2, 0, 0, 1, 0.3), ("x", 11, 5, 2, 0, 0, 1, 0.99)],
        "region string, klen int, kcut int, tip int, open_ends int, short_inner int, contigs int, used_share double")
    assert C.best_runs(runs.where("kcut < 5"), "region").first().kcut == 3
    assert C.best_runs(runs, "region").first().kcut == 5
    again = runs.withColumn("open_ends", F.when(F.col("kcut") < 5, 3).otherwise(0))
    assert {r.kcut for r in C.stop_early(again, "region", 2).collect()} == {1, 2, 3}


def test_references_rescue_contigs_by_an_end(spark):
    rng = random.Random(8)
    ref = "".join(rng.choices("ACGT", k=120))
    half = ref[:75] + "".join(rng.choices("ACGT", k=200))
    rows = [("a", ref), ("b", half), ("c", "".join(rng.choices("ACGT", k=150)))]
    got = {r.id: r.keep for r in C.keep_like_references(spark.createDataFrame(rows, "id string, seq string"), spark.createDataFrame([("r", ref)], "id string, seq string")).collect()}
    assert got == {"a": True, "b": True, "c": False}


# --- population -------------------------------------------------------------------


@pytest.mark.parametrize("distance", [1, 2])
def test_close_pairs(spark, distance):
    rng = random.Random(distance)
    seqs = {""}
    for _ in range(12):
        s = "".join(rng.choices("ACG", k=rng.choice([1, 2, 5, 14])))
        seqs.add(s)
        for _ in range(5):
            i, kind = rng.randrange(len(s) + 1), rng.randrange(3)
            s = s[:i] + ("", rng.choice("ACG"), rng.choice("ACG"))[kind] + s[i + (kind < 2) :]
            seqs.add(s)
    rows = spark.createDataFrame([(t, s) for t in (1, 2) for s in sorted(seqs)], "target long, seq string")
    got = P.close_pairs(rows, ["target"], distance).collect()
    want = {(t, a, b) for t in (1, 2) for a in seqs for b in seqs if a != b and edits(a, b) <= distance}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_chimeras(spark):
    rng = random.Random(4)
    rows = []
    for sample in range(8):
        pool = ["".join(rng.choices("AC", k=12)) for _ in range(4)]
        for _ in range(6):
            a, b = rng.sample(pool, 2)
            i = rng.randrange(13)
            pool.append(a[:i] + b[i:])
        rows += [("t", sample, s, round(rng.random(), 2)) for s in set(pool)]
    got = {(r.sample, r.seq): r.chimera for r in P.mark_chimeras(spark.createDataFrame(rows, "target string, sample long, seq string, frac double"), 2.0).collect()}
    for _, sample, s, f in rows:
        parents = [x for _, o, x, g in rows if o == sample and x != s and g >= 2.0 * f]
        front = {x: len(commonprefix((x, s))) for x in parents}
        back = {x: len(commonprefix((x[::-1], s[::-1]))) for x in parents}
        assert got[sample, s] == any(a != b and front[a] > 0 and back[b] > 0 and front[a] + back[b] >= len(s) for a in parents for b in parents)
    assert any(got.values()) and not all(got.values())


def test_replicates_at_two_levels(spark):
    rows = [("t", "e1", "b", 1, "A", 5, False), ("t", "e1", "b", 2, "C", 9, False), ("t", "e2", "b", 3, "G", 1, True), ("t", "e3", "c", 4, "T", 2, True), ("t", "e3", "c", 5, "T", 1, True)]
    h = spark.createDataFrame(rows, "target string, experiment string, biological string, replicate long, seq string, cnt long, preferred boolean")
    left, failed = P.choose_two_levels(h, "experiment", "biological", "replicate", "preferred")
    assert {r.replicate for r in left.collect()} == {3, 4}
    assert {(r.level, r.group, r.replicates) for r in failed.collect()} == {("experiment", "e1", 2), ("experiment", "e3", 2)}


# --- places -----------------------------------------------------------------------


def test_collapsed_haplotypes_are_ranked_over_all(spark):
    seqs = [(f"S{i:03d}",) for i in range(120) for _ in range(1 + i % 5)]
    refs = spark.createDataFrame([("S004", "wild")], "seq string, name string")
    got = {r.seq: r for r in H.collapse_haplotypes(spark.createDataFrame(seqs, "seq string").repartition(5), refs).collect()}
    order = sorted({s for (s,) in seqs}, key=lambda s: (-seqs.count((s,)), s))
    assert [got[s].rank for s in order] == list(range(120)) and got["S004"].name == "wild" and got[order[1]].name == "hap.001"
    assert abs(sum(r.fraction for r in got.values()) - 1) < 1e-9
    assert H.collapse_haplotypes(spark.createDataFrame([], "seq string"), refs).isEmpty()
