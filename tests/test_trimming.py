"""Trimming to linear and circular references."""

import random
from itertools import combinations

from strandworks.operators import trimming as T

R = random.Random(12)
SCHEMA = "id long, seq string"


def letters(n):
    return "".join(R.choices("ACGT", k=n))


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_longest_chain():
    assert T.longest_chain([], []) is None
    for _ in range(200):
        n = R.randint(1, 8)
        ps, qs = sorted(R.sample(range(20), n)), R.sample(range(20), n)
        rising = [c for m in range(1, n + 1) for c in combinations(list(zip(ps, qs)), m) if all(a[1] < b[1] for a, b in zip(c, c[1:]))]
        best = min(rising, key=lambda c: (-len(c), c[0][0], c[-1][0]))
        assert T.longest_chain(ps, qs) == (*best[0], *best[-1], len(best))


def test_linear_references(spark):
    refs = {1: letters(120), 2: letters(90)}
    a = refs[1]
    changed = a[:2] + turned(a[2])[0].replace(a[2], "N") + a[3:60] + a[61:116] + turned(a[116]) + a[117:]
    swapped = "GGCC" + a[70:] + a[:70]  # anchors that do not rise in both
    contigs = {1: "TTACG" + a + "CCATT", 2: "AC" + changed + "GGA", 3: a[30:], 4: refs[2][:80], 5: "N" * 40, 6: swapped, 7: "ACG" + refs[2]}
    got = {r.id: r for r in T.trim_to_reference(spark.createDataFrame(list(contigs.items()), SCHEMA), spark.createDataFrame(list(refs.items()), SCHEMA)).collect()}
    assert got[1].seq == a and got[1].trim_status and (got[1].trim_start, got[1].trim_end, got[1].ref_id) == (5, 125, 1)
    assert got[2].seq == changed and got[2].trim_status
    assert got[3].seq == a[30:] and not got[3].trim_status and got[4].seq == refs[2][:80] and not got[4].trim_status
    assert got[5].seq == contigs[5] and got[5].ref_id is None and not got[5].trim_status
    assert not got[6].trim_status
    assert got[7].seq == refs[2] and got[7].trim_status and got[7].ref_id == 2
    assert T.trim_to_reference(spark.createDataFrame([], SCHEMA), spark.createDataFrame(list(refs.items()), SCHEMA)).isEmpty()


def test_circular_references(spark):
    ring, other = letters(200), letters(150)
    rot = ring[77:] + ring[:77]
    longer = ring[:100] + "ACGTTGCA" + ring[100:]  # an insertion: the circle is longer than the reference
    own = longer[50:] + longer[:50]
    contigs = {1: rot, 2: turned(rot), 3: rot + rot, 4: rot + rot[:30], 5: rot[:90], 6: turned(own + own[:25]), 7: "A" * 60, 8: rot + rot + rot, 9: other[9:] + other[:9]}
    refs = spark.createDataFrame([(1, ring), (2, other)], SCHEMA)
    got = {r.id: r for r in T.trim_to_circle(spark.createDataFrame(list(contigs.items()), SCHEMA), refs, 11).collect()}
    for i in (1, 2, 3, 4, 8):
        assert got[i].seq == ring and got[i].trim_status, i
    assert got[2].rev and not got[1].rev and got[3].closed and got[4].closed and not got[1].closed
    assert got[5].seq == rot[:90] and not got[5].trim_status
    assert got[6].closed and got[6].trim_status and sorted(got[6].seq) == sorted(longer) and got[6].seq in longer + longer
    assert got[7].seq == "A" * 60 and got[7].ref_id is None and not got[7].trim_status
    assert got[9].seq == other and got[9].ref_id == 2
