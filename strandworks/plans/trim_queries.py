"""Queries of trimming to linear and circular references, over contigs derived from the benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import trimming as T
from . import fixtures as X
from .registry import query

_JUNK = "ACGTTGCAACTTAGC"


def _mutants(spark, d):
    """Every reference between other bases, with a changed base near both ends and a lost one in the middle of every fourth; some lack their start."""
    n = F.length("seq")
    turn = lambda p: F.translate(F.substr("seq", p, F.lit(1)), "ACGT", "CGTA")
    gap = F.when(F.col("id") % 4 == 1, 1).otherwise(0)
    half = F.floor(n / 2).cast("int")
    body = F.concat(F.left("seq", F.lit(3)), turn(F.lit(4)), F.substr("seq", F.lit(5), half - 4), F.substr("seq", half + 1 + gap, n - half - gap - 5), turn(n - 4), F.right("seq", F.lit(4)))
    front = F.when(F.col("id") % 5 == 0, F.substr(body, F.lit(21))).otherwise(F.concat(F.left(F.lit(_JUNK), (F.col("id") % 9).cast("int")), body))
    return X.references(spark, d).select("id", F.concat(front, F.right(F.lit(_JUNK), (F.col("id") % 7).cast("int"))).alias("seq"))


_MUTANTS = f"""{X.REFERENCES_SQL}, body AS (SELECT id, left(seq, 3) || translate(substr(seq, 4, 1), 'ACGT', 'CGTA') || substr(seq, 5, len(seq) // 2 - 4) || substr(seq, len(seq) // 2 + 1 + g, len(seq) - len(seq) // 2 - g - 5) || translate(substr(seq, len(seq) - 4, 1), 'ACGT', 'CGTA') || right(seq, 4) AS b
  FROM (SELECT *, CASE WHEN id % 4 = 1 THEN 1 ELSE 0 END AS g FROM refs)),
cs AS (SELECT id, CASE WHEN id % 5 = 0 THEN substr(b, 21) ELSE left('{_JUNK}', CAST(id % 9 AS INT)) || b END || right('{_JUNK}', CAST(id % 7 AS INT)) AS seq FROM body)"""
_CHAINS = """ck AS (SELECT id, p, substr(seq, p + 1, 7) AS kmer FROM (SELECT *, unnest(range(0, len(seq) - 6)) AS p FROM cs)), rk AS (SELECT id, q, substr(seq, q + 1, 7) AS kmer FROM (SELECT *, unnest(range(0, len(seq) - 6)) AS q FROM refs)),
cc AS (SELECT id, kmer, count(*) AS c, min(p) AS p FROM ck GROUP BY ALL), rc AS (SELECT id, kmer, count(*) AS c, min(q) AS q FROM rk GROUP BY ALL),
sim AS (SELECT a.id, b.id AS ref, sum(least(a.c, b.c)) AS sh FROM cc a JOIN rc b USING (kmer) GROUP BY ALL),
best AS (SELECT id, arg_max(ref, {'s': sh / (least(n, m) - 6), 'r': -ref}) AS ref_id FROM sim JOIN (SELECT id, len(seq) AS n FROM cs) USING (id) JOIN (SELECT id AS ref, len(seq) AS m FROM refs) USING (ref) GROUP BY id),
anc AS (SELECT a.id, ref_id, list({'p': a.p, 'q': b.q} ORDER BY a.p) AS a FROM best JOIN cc a USING (id) JOIN rc b ON b.id = ref_id AND b.kmer = a.kmer WHERE a.c = 1 AND b.c = 1 GROUP BY ALL),
dp AS (SELECT id, ref_id, list_max(list_transform(list_reduce(a, lambda acc, x: list_append(acc, list_transform([list_max(list_transform(list_filter(acc, lambda y: y.q < x.q), lambda y: {'l': y.l, 'nf': y.nf, 'nq': y.nq}))],
  lambda b: {'l': coalesce(b.l, 0) + 1, 'nf': coalesce(b.nf, -x.p), 'nq': coalesce(b.nq, -x.q), 'np': -x.p, 'q': x.q})[1]), []::STRUCT(l BIGINT, nf BIGINT, nq BIGINT, np BIGINT, q BIGINT)[]), lambda z: {'l': z.l, 'nf': z.nf, 'np': z.np, 'nq': z.nq, 'q': z.q})) AS c FROM anc),
ch AS (SELECT cs.id, cs.seq, ref_id, r.seq AS ref, -c.nf AS fp, -c.nq AS fq, -c.np AS lp, c.q AS lq, len(r.seq) - c.q - 7 AS bh FROM cs LEFT JOIN dp ON dp.id = cs.id LEFT JOIN refs r ON r.id = ref_id),
en AS (SELECT *, list_min(list_filter(list_transform(range(-3, 4), lambda i: CASE WHEN fp - fq + i BETWEEN 0 AND fp THEN {'e': levenshtein(substr(seq, fp - fq + i + 1, fq - i), left(ref, fq)), 'o': abs(i), 'at': fp - fq + i} END), lambda t: t.e <= 3)) AS s,
  list_min(list_filter(list_transform(range(-3, 4), lambda i: CASE WHEN lp + 7 + bh + i BETWEEN lp + 7 AND len(seq) THEN {'e': levenshtein(substr(seq, lp + 8, bh + i), substr(ref, lq + 8, bh)), 'o': abs(i), 'at': lp + 7 + bh + i} END), lambda t: t.e <= 3)) AS z FROM ch)"""


@query(f"WITH {_MUTANTS}, {_CHAINS} SELECT id, ref_id, CAST(coalesce(s.at, 0) AS BIGINT) AS trim_start, CAST(coalesce(z.at, len(seq)) AS BIGINT) AS trim_end, s IS NOT NULL AND z IS NOT NULL AS trim_status, substr(seq, coalesce(s.at, 0) + 1, coalesce(z.at, len(seq)) - coalesce(s.at, 0)) AS trimmed FROM en")
def c15_trimmed_to_references(spark, d):
    x = T.trim_to_reference(_mutants(spark, d), X.references(spark, d))
    return x.select("id", "ref_id", F.col("trim_start").cast("long").alias("trim_start"), F.col("trim_end").cast("long").alias("trim_end"), "trim_status", F.col("seq").alias("trimmed"))


def _rings(spark, d):
    """Of every reference as a circle: a round from elsewhere, the same on the other strand, two rounds, a round and some, and half a round."""
    n = F.length("seq")
    turn = (1 + F.col("id") * 7 % n).cast("int")
    three = F.concat("seq", "seq", "seq")
    sizes = F.array(n, n, 2 * n, n + 14, F.floor(n / 2).cast("int"))
    x = X.references(spark, d).select("id", three.alias("three"), turn.alias("turn"), F.posexplode(sizes).alias("v", "size"))
    cut = F.substr("three", F.col("turn") + 1, F.col("size"))
    return x.select((F.col("id") * 10 + F.col("v")).alias("id"), F.when(F.col("v") == 1, S.reverse_complement(cut)).otherwise(cut).alias("seq"))


_RINGS = f"""{X.REFERENCES_SQL}, ri AS (SELECT id * 10 + v AS id, CASE WHEN v = 1 THEN reverse(translate(c, 'ACGT', 'TGCA')) ELSE c END AS seq FROM (SELECT id, v, substr(seq || seq || seq, CAST(2 + id * 7 % len(seq) AS BIGINT), CASE v WHEN 2 THEN 2 * len(seq) WHEN 3 THEN len(seq) + 14 WHEN 4 THEN len(seq) // 2 ELSE len(seq) END) AS c FROM refs, (SELECT unnest(range(0, 5)) AS v))),
st AS (SELECT id, FALSE AS rev, seq FROM ri UNION ALL SELECT id, TRUE, reverse(translate(seq, 'ACGT', 'TGCA')) FROM ri), sk AS (SELECT id, rev, p, substr(seq, p + 1, 11) AS kmer FROM (SELECT *, unnest(range(0, len(seq) - 10)) AS p FROM st)),
rk AS (SELECT id AS ref_id, n, min(q) AS q, kmer FROM (SELECT id, len(seq) AS n, q, substr(seq || left(seq, 10), q + 1, 11) AS kmer FROM (SELECT *, unnest(range(0, len(seq))) AS q FROM refs)) GROUP BY ALL HAVING count(*) = 1),
vo AS (SELECT id, ref_id, rev, n, ((q - p) % n + n) % n AS o, count(*) AS votes FROM sk JOIN rk USING (kmer) GROUP BY ALL), bv AS (SELECT * FROM vo QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, ref_id, rev, o) = 1),
ro AS (SELECT ri.id, ref_id, rev, n, (n - o) % n AS zero, CASE WHEN coalesce(rev, FALSE) THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS s FROM ri LEFT JOIN bv USING (id)),
bo AS (SELECT *, list_max(list_filter(range(11, len(s)), lambda x: left(s, x) = right(s, x))) AS b FROM ro),
cl AS (SELECT *, b IS NOT NULL AND ref_id IS NOT NULL AS closed, left(s, len(s) - b) AS w, CASE WHEN zero < len(s) - b THEN zero ELSE 0 END AS t FROM bo)"""


@query(f"WITH {_RINGS}, fi AS (SELECT id, ref_id, rev, closed, s, CASE WHEN closed THEN substr(w, t + 1) || left(w, t) WHEN zero + n <= len(s) THEN substr(s, zero + 1, n) WHEN len(s) >= n THEN substr(s, zero + 1) || substr(s, len(s) - n + 1, zero - len(s) + n) END AS r FROM cl) SELECT id, ref_id, rev, closed, r IS NOT NULL AS trim_status, coalesce(r, s) AS round FROM fi")
def c16_trimmed_to_circles(spark, d):
    return T.trim_to_circle(_rings(spark, d), X.references(spark, d), 11).select("id", "ref_id", "rev", "closed", "trim_status", F.col("seq").alias("round"))
