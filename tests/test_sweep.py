"""A sweep of settings in one set of rounds equals separate assemblies."""

import random

from pyspark.sql import functions as F

from strandworks.operators import contigs as C
from strandworks.plans.assemble import Settings, assemble, sweep_graph

R = random.Random(21)
SCHEMA = "read_id long, sample string, name string, seq string, qual string"


def reads(spark):
    rows, base = [], "".join(R.choices("ACGT", k=120))
    other = base[:60] + "ACGT"[("ACGT".index(base[60]) + 1) % 4] + base[61:]
    for sample, haps in (("x", [base, other]), ("y|1", [other, base[:50]])):
        for h in haps:
            for i in range(0, max(1, len(h) - 44), 3):
                for length in (44, 45):
                    rows.append((len(rows), sample, "n", h[i : i + length], "I" * length))
    return spark.createDataFrame(rows, SCHEMA)


def test_sweep_equals_single_runs(spark):
    x = reads(spark)
    settings = [(15, 2, 3), (21, 1, 10)]
    g = sweep_graph(x, spark.createDataFrame(settings, "klen int, kcut int, tip int"))
    rows = C.long_enough(g.nodes.withColumns({"headless": F.lit(False), "tailless": F.lit(False)}), F.element_at(F.split("assembly_id", r"\|"), -3).cast("int")).collect()
    for k, c, t in settings:
        alone = assemble(x, Settings(k=k, cutoff=c, tip=t)).collect()
        want = sorted((r.assembly_id, r.seq, r.cnt) for r in alone)
        got = sorted((r.assembly_id.removesuffix(f"|{k}|{c}|{t}"), r.seq, r.cnt) for r in rows if r.assembly_id.endswith(f"|{k}|{c}|{t}"))
        assert got == want and want


def test_pairs_are_assembled(spark):
    base = "".join(R.choices("ACGT", k=150))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = []
    for i in range(0, 71, 2):
        rows += [(2 * i, "s", i, 1, base[i : i + 40]), (2 * i + 1, "s", i, 2, turn(base[i + 38 : i + 80]))]
    x = spark.createDataFrame(rows, "read_id long, sample string, pair_id long, mate int, seq string")
    # mates that overlap by two bases or more are joined; the others go on as pairs
    got = assemble(x, Settings(k=15, cutoff=1, min_overlap=2)).collect()
    assert len(got) == 1 and got[0].seq in base and len(got[0].seq) > 130


def test_recruitment_equals_a_plain_loop(spark):
    """Reads and contigs by round, against a loop over everything; the assembly joins what overlaps by 12 bases at one end."""
    from strandworks.operators import regions as I

    base = "".join(R.choices("ACGT", k=300))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    pool = {i: (base[a : a + 40] if i % 3 else turn(base[a : a + 40])) for i, a in enumerate(range(0, 261, 13))}
    pool |= {100 + i: "".join(R.choices("ACGT", k=40)) for i in range(5)}
    seeds = [("a", base[100:160]), ("b", base[:50]), ("b", base[250:])]

    def longest(reads):
        """The read that sorts first, extended; small stand-in for an assembly."""
        return sorted(reads)[-3:]

    def plain():
        have, met, contigs, out_reads, out_contigs = {"a": {}, "b": {}}, set(seeds), list(seeds), set(), set()
        for i in range(20):
            known = {}
            for asm, s in contigs:
                known.setdefault(asm, set()).update(s[j : j + 19] for j in range(len(s) - 18))
            grown = set()
            for asm, ks in known.items():
                for r, s in pool.items():
                    shared = {x: len({x2[j : j + 19] for j in range(22)} & ks) for x, x2 in (("+", s), ("-", turn(s)))}
                    best = min(shared, key=lambda x: (-shared[x], x))
                    if r not in have[asm] and shared[best] >= 3:
                        have[asm][r] = s if best == "+" else turn(s)
                        out_reads.add((asm, r, i))
                        grown.add(asm)
            if not grown:
                break
            contigs = [(asm, s) for asm in grown for s in longest(have[asm].values()) if (asm, s) not in met]
            met |= set(contigs)
            out_contigs |= {(*c, i) for c in contigs}
        return out_reads, out_contigs

    def assembly(reads, i):
        top = reads.groupBy("assembly").agg(F.slice(F.sort_array(F.collect_list("seq"), asc=False), 1, 3).alias("s"))
        return top.select("assembly", F.explode("s").alias("seq"))

    have, contigs = I.recruit_rounds(
        spark.createDataFrame(list(pool.items()), "read_id long, seq string"), spark.createDataFrame(seeds, "assembly string, seq string"), assembly, k=19, least=3, length=20)
    reads, made = plain()
    assert {(r.assembly, r.read_id, r.round) for r in have.collect()} == reads and max(x[2] for x in reads) > 0
    assert {(r.assembly, r.seq, r.round) for r in contigs.collect()} == made


def test_recruit_and_assemble(spark):
    from strandworks.plans.assemble import recruit_and_assemble

    base = "".join(R.choices("ACGT", k=200))
    pool = spark.createDataFrame([(i, base[a : a + 50]) for i, a in enumerate(range(0, 151, 3))], "read_id long, seq string")
    seeds = spark.createDataFrame([("z", base[80:140])], "assembly string, seq string")
    have, contigs, best = recruit_and_assemble(pool, seeds, spark.createDataFrame([(15, 1, 3), (21, 1, 3)], "klen int, kcut int, tip int"), rounds=2, k=19, least=5, length=40)
    rounds = {r.round for r in have.collect()}
    assert rounds == {0, 1} and have.where("round = 1").count() > 5
    assert max(len(r.seq) for r in contigs.collect()) > 100
    chosen = best.first()
    assert best.count() == 1 and (chosen.klen, chosen.kcut, chosen.tip) in {(15, 1, 3), (21, 1, 3)}
